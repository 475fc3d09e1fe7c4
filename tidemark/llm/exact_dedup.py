"""Exact duplicate removal by Grace hash deduplication.

1. Each scan task keeps an open-addressing table of the contents it has met and emits, for
   every row, the number of its local group, and for every local group one representative
   with the whole content. A group of copies that holds a third of all rows so shrinks to a
   few rows a task before anything is shuffled.
2. Representatives are dealt out by content hash. A task whose share does not fit in memory
   splits it by the next digit of the hash into spill files, again and again, until a bucket
   fits an open-addressing table, which compares complete contents.
3. Rows find the result of their local group by its number; no text is shuffled for that.

The output of step 1 is a table in the shared folder, so a lost executor costs a re-read.
Spill files are private to one task attempt: they have no name, vanish with the process, and
a repeated task writes its own.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BLANK, digest, few_rows_at_once, free_names, rows_of, small, texts
from tidemark.llm.groups import may_hold, sieve
from tidemark.session import stage

FAN_OUT_BITS = 4  # sixteen spill files a level
LEVELS = 64 // FAN_OUT_BITS  # digits of a 64-bit hash
LAST_ID = (1 << 63) - 1  # stands for a null id, which loses every tie

NUMBERS = ("group", "row", "doc_id", "points", "rows", "hash")
LOCAL = ", ".join(f"{n} long" for n in NUMBERS) + ", sha binary, content binary"
LOCAL_ARROW = pa.schema([(n, pa.int64()) for n in NUMBERS] + [("sha", pa.binary()), ("content", pa.binary())])
SETTLED = "group long, keep_row long, keep_id long, group_size long, sha binary"
SETTLED_ARROW = pa.schema([(n, pa.int64()) for n in ("group", "keep_row", "keep_id", "group_size")] + [("sha", pa.binary())])


class ContentTable:
    """Open addressing with linear probing; equal hashes are told apart by complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def number(self, key: int, content: bytes) -> int:
        """The number of this content; a new one if it was not met before."""
        mask = len(self.slots) - 1
        at = key & mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == key and self.contents[found] == content:
                return found
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(key)
        self.contents.append(content)
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return len(self.hashes) - 1

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for found, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = found


def _better(mine: tuple[int, int, int], other: tuple[int, int, int]) -> bool:
    """(code points, doc_id, row): the longest text stays, then the smallest id, then the first row."""
    return (-mine[0], *mine[1:]) < (-other[0], *other[1:])


def local_groups(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their local group, then a representative of each group."""
    base = TaskContext.get().partitionId() << 40
    made = row = 0

    def flush(table: ContentTable, shas: list, best: list, rows: list, first: int) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        for a in range(0, n, 2000):
            part = range(a, min(n, a + 2000))
            yield from rows_of(
                LOCAL_ARROW,
                [
                    [base + first + i for i in part],
                    [best[i][2] for i in part],
                    [best[i][1] for i in part],
                    [best[i][0] for i in part],
                    [rows[i] for i in part],
                    [table.hashes[i] for i in part],
                    [shas[i] for i in part],
                    [table.contents[i] for i in part],
                ],
            )

    table, shas, best, rows, held = ContentTable(), [], [], [], 0
    for batch in small(batches):
        groups, ids, lengths, first_row = [], [], [], row
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
            content = text.translate(None, BLANK)
            points = len(text.decode())
            sha = digest(content)
            number = table.number(int.from_bytes(sha[:8], "big", signed=True), content)
            mine = (points, LAST_ID if doc_id is None else doc_id, base + row)
            row += 1
            if number == len(rows):
                shas.append(sha)
                rows.append(1)
                best.append(mine)
                held += len(content)
            else:
                rows[number] += 1
                if _better(mine, best[number]):
                    best[number] = mine
            groups.append(base + made + number)
            ids.append(doc_id)
            lengths.append(points)
            if held > budget:
                yield from flush(table, shas, best, rows, made)
                made += len(rows)
                table, shas, best, rows, held = ContentTable(), [], [], [], 0
        nothing = [None] * len(ids)
        yield from rows_of(
            LOCAL_ARROW, [groups, range(base + first_row, base + row), ids, lengths, nothing, nothing, nothing, nothing]
        )
    yield from flush(table, shas, best, rows, made)


def _scratch_dir() -> str | None:
    """Where Spark's own tasks spill on this machine; else the process's temporary folder."""
    folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return folders[os.getpid() % len(folders)] if folders else None


def settle(batches: Iterable[pa.RecordBatch], budget: int, level: int = 0) -> Iterator[pa.RecordBatch]:
    """The row that stays and the size of the group, for each representative of one bucket."""
    held, size, batches = [], 0, iter(batches)
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > budget and level < LEVELS:
            yield from _split(held, batches, budget, level)
            return
    table, best, rows, shas, members = ContentTable(), [], [], [], []
    for batch in held:
        columns = [batch.column(n).to_pylist() for n in LOCAL_ARROW.names]
        for group, row, doc_id, points, n, key, sha, content in zip(*columns, strict=True):
            number, mine = table.number(key, content), (points, doc_id, row)
            if number == len(rows):
                best.append(mine)
                rows.append(0)
                shas.append(sha)
            elif _better(mine, best[number]):
                best[number] = mine
            rows[number] += n
            members.append((group, number))
    for a in range(0, len(members), 50_000):
        part = members[a : a + 50_000]
        yield from rows_of(
            SETTLED_ARROW,
            [
                [g for g, _ in part],
                [best[i][2] for _, i in part],
                [None if best[i][1] == LAST_ID else best[i][1] for _, i in part],
                [rows[i] for _, i in part],
                [shas[i] for _, i in part],
            ],
        )


def _split(held: list, rest: Iterator[pa.RecordBatch], budget: int, level: int) -> Iterator[pa.RecordBatch]:
    fan_out, shift = 1 << FAN_OUT_BITS, np.uint64(64 - FAN_OUT_BITS * (level + 1))
    schema = held[0].schema
    with ExitStack() as stack:
        files = [stack.enter_context(tempfile.TemporaryFile(dir=_scratch_dir())) for _ in range(fan_out)]
        writers = [pa.ipc.new_stream(f, schema) for f in files]

        def put(batch: pa.RecordBatch) -> None:
            keys = batch.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            digits = (keys >> shift) & np.uint64(fan_out - 1)
            for d in np.unique(digits):
                writers[int(d)].write_batch(batch.take(pa.array(np.flatnonzero(digits == d))))

        while held:
            put(held.pop())
        for batch in rest:
            put(batch)
        for writer, file in zip(writers, files, strict=True):
            writer.close()
            file.seek(0)
            with pa.ipc.open_stream(file) as reader:
                yield from settle(iter(reader), budget, level + 1)


def _flagged(docs: DataFrame, budget: int) -> DataFrame:
    rows = few_rows_at_once(docs).select("doc_id", "text").mapInArrow(partial(local_groups, budget=budget), LOCAL)
    local = stage(rows, "exact-dedup")
    members = local.where(F.col("content").isNull()).select("group", "row", "doc_id", "points")
    settled = (
        local.where(F.col("content").isNotNull())
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "hash")
        .mapInArrow(partial(settle, budget=budget), SETTLED)
    )
    return members.join(settled, "group").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "points",
    )


def duplicate_groups(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs(doc_id, text)``.

    Texts are equal when they are after deleting ASCII white space; null counts as empty. Of
    equal texts the row with the most code points stays, then the smallest doc_id; a null
    doc_id loses ties. Rows that repeat whole each count in group_size, and one of them
    stays. Other columns, whatever their names, are ignored; an empty table gives an empty
    result. ``budget`` bounds the bytes of content a task holds at a time.
    """
    return _flagged(docs, budget).drop("points")


def _named(batches: Iterable[pa.RecordBatch], shared: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with the digest and length of their text, and whether others may share it."""
    for batch in small(batches):
        raw = texts(batch.column("text"))
        digests = [digest(t.translate(None, BLANK)) for t in raw]
        yield (
            batch.append_column(names[0], pa.array(digests, pa.binary()))
            .append_column(names[1], pa.array([len(t.decode()) for t in raw], pa.int64()))
            .append_column(names[2], pa.array(may_hold(shared, digests)))
        )


def without_copies(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of whole repeats, one.

    Rows whose text no other row shares stay without a join; only the others meet the list
    of rows that stay. Nulls count as in ``duplicate_groups``; an empty table stays empty.
    Columns may have any names: inner ones are made to differ from them.
    """
    flagged = stage(_flagged(docs, budget), "exact-dedup-rows")
    shared = sieve(flagged.where("group_size > 1").select(F.unhex("text_sha256")).distinct())
    names = free_names(docs, "_sha", "_points", "_sifted")
    sha, points, sifted = names
    added = [T.StructField(n, t) for n, t in zip(names, (T.BinaryType(), T.LongType(), T.BooleanType()), strict=True)]
    keyed = docs.mapInArrow(partial(_named, shared=shared, names=names), T.StructType([*docs.schema.fields, *added]))
    stay = flagged.where("kept").select(
        F.col("doc_id").alias("keep_id"), F.unhex("text_sha256").alias("keep_sha"), F.col("points").alias("keep_points")
    )
    rest = keyed.where(F.col(sifted))
    same = rest["doc_id"].eqNullSafe(stay["keep_id"]) & (rest[sha] == stay["keep_sha"]) & (rest[points] == stay["keep_points"])
    first = rest.join(stay, same, "left_semi").dropDuplicates(["doc_id", sha, points])
    return keyed.where(~F.col(sifted)).drop(*names).unionByName(first.drop(*names))
