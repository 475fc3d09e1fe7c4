"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Of keys
with at least ``least`` code points, all lines go except those in the smallest document id
that holds the key.

The index has two tables. *Blocks* hold documents with the distinct keys of each block, how
many of its documents hold a key, and the smallest of their ids. *Shards* hold, for a range
of key digests, the exact table (digest, number of documents, smallest id) and a cuckoo
filter over its digests.

* Insertion: the blocks of new documents send one entry a key to its shard, however many of
  their documents hold it. What the filter does not know is new and needs no look-up; the
  rest is looked up exactly and counted up.
* Deletion: blocks that hold the documents are written anew, and their references are
  taken back. Keys without references leave table and filter; a key that lost its smallest
  holder gets the next one from the entries of the remaining blocks. The index then equals one
  that never saw the documents.

Shards are ranges of uniform digests, so a line that a third of all documents hold is one
entry a block. Digests have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, rows_of, small, texts
from tidemark.llm.cuckoo import CuckooFilter
from tidemark.session import stage

FOLLOWS = bytes(range(0x80, 0xC0))  # bytes inside a code point
LAST = np.iinfo(np.int64).max  # stands for a null id

BLOCK = "block long, n_keys long, keys binary, refs binary, firsts binary, docs binary, lines binary"
BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("n_keys", pa.int64())]
    + [(n, pa.binary()) for n in ("keys", "refs", "firsts", "docs", "lines")]
)
ENTRY = "shard long, block long, start long, keys binary, refs binary, firsts binary"
ENTRY_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("shard", "block", "start")] + [(n, pa.binary()) for n in ("keys", "refs", "firsts")]
)
SHARD = "shard long, n_keys long, keys binary, refs binary, firsts binary, filter binary"
SHARD_ARROW = pa.schema(
    [("shard", pa.int64()), ("n_keys", pa.int64())] + [(n, pa.binary()) for n in ("keys", "refs", "firsts", "filter")]
)
ANSWER = "block long, at binary, firsts binary"
ANSWER_ARROW = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("firsts", pa.binary())])
RESULT = "doc_id long, n_lines long, n_dropped long, text string"
RESULT_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_lines", "n_dropped")] + [("text", pa.string())])


class LineIndex(NamedTuple):
    """Blocks and shards, both written; ``shards`` is a power of two. An insertion or deletion gives a new index."""

    blocks: DataFrame
    counts: DataFrame
    shards: int


def line_key(line: bytes, least: int) -> bytes | None:
    """What lines are compared by; None if it is shorter than ``least`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < least or len(key) < 4 * least and len(key.translate(None, FOLLOWS)) < least:
        return None
    return key


def _packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _blob(**columns: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table(columns)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _keys(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "S16")


def _hashes(keys: np.ndarray) -> np.ndarray:
    """What the filter goes by: the half of a digest that does not choose the shard."""
    return np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)[:, 1].astype(np.uint64)


def _least_per(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, LAST, np.int64)
    np.minimum.at(out, at, values)
    return out


def _block_row(block: int, keys: np.ndarray, docs: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block: ``keys`` are sorted digests, ``at`` the place of each line's key, -1 for none."""
    sizes = docs.column("n_lines").to_numpy()
    ids = docs.column("doc_id").fill_null(LAST).to_numpy()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    held = np.unique(doc[at >= 0] * (len(keys) + 1) + at[at >= 0])  # a document counts once
    doc, at_once = np.divmod(held, len(keys) + 1)
    refs = np.bincount(at_once, minlength=len(keys))
    firsts = _least_per(at_once, ids[doc], len(keys))
    body = _blob(**{n: docs.column(n) for n in docs.column_names})
    columns = [keys.tobytes(), _packed(refs, "<i8"), _packed(firsts, "<i8"), body, _blob(at=pa.array(at, pa.int32()))]
    yield from rows_of(BLOCK_ARROW, [[block], [len(keys)], *([c] for c in columns)])


class _Block:
    """Documents and the keys of their lines, until there are enough for a block."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.docs: list[tuple[int | None, int, bytes]] = []
        self.at: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes, least: int) -> None:
        known, lines = self.known, text.split(b"\n")
        for line in lines:
            key = line_key(line, least)
            self.at.append(-1 if key is None else known.setdefault(key, len(known)))
        self.docs.append((doc_id, len(lines), text))
        self.size += len(text) + 16 * len(lines) + 64

    def row(self, block: int) -> Iterator[pa.RecordBatch]:
        digests = b"".join(hashlib.blake2b(key, digest_size=16).digest() for key in self.known)
        keys = np.frombuffer(digests, "S16")
        order = np.argsort(keys, kind="stable")
        place = np.full(len(keys) + 1, -1, np.int64)  # the last one is for lines without a key
        place[order] = np.arange(len(keys))
        ids, n_lines, texts_ = zip(*self.docs, strict=True)
        docs = pa.table(
            {"doc_id": pa.array(ids, pa.int64()), "n_lines": pa.array(n_lines, pa.int64()), "text": pa.array(texts_, pa.binary())}
        )
        yield from _block_row(block, keys[order], docs, place[np.array(self.at, np.int64)])


def scan(batches: Iterable[pa.RecordBatch], least: int, most_bytes: int, job: int) -> Iterator[pa.RecordBatch]:
    number, held = job << 43 | TaskContext.get().partitionId() << 22, _Block()
    for batch in small(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
            held.add(doc_id, text, least)
            if held.size >= most_bytes:
                yield from held.row(number)
                number, held = number + 1, _Block()
    if held.docs:
        yield from held.row(number)


def _slices(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """Shard, start and end of the runs of sorted digests that belong to one shard."""
    if not len(keys):
        return
    high = keys.view(">u8").reshape(-1, 2)[:, 0]
    shard = (high >> np.uint64(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    yield from zip(shard[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)


def entries(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A block's keys, cut by shard."""
    for batch in batches:
        for row in batch.to_pylist():
            out = [[], [], [], [], [], []]
            for shard, a, b in _slices(_keys(row["keys"]), shards):
                cut = [row["keys"][16 * a : 16 * b], row["refs"][8 * a : 8 * b], row["firsts"][8 * a : 8 * b]]
                for column, value in zip(out, [shard, row["block"], a, *cut], strict=True):
                    column.append(value)
            yield from rows_of(ENTRY_ARROW, out)


def recut(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Shards cut into more of them; their filters are made anew."""
    for batch in batches:
        for row in batch.to_pylist():
            keys, refs, firsts = _keys(row["keys"]), np.frombuffer(row["refs"], "<i8"), np.frombuffer(row["firsts"], "<i8")
            for shard, a, b in _slices(keys, shards):
                yield from _shard_row(shard, keys[a:b], refs[a:b], firsts[a:b], CuckooFilter.of(_hashes(keys[a:b])))


def _shard_row(
    shard: int, keys: np.ndarray, refs: np.ndarray, firsts: np.ndarray, filter_: CuckooFilter
) -> Iterator[pa.RecordBatch]:
    values = [keys.tobytes(), _packed(refs, "<i8"), _packed(firsts, "<i8"), filter_.write()]
    yield from rows_of(SHARD_ARROW, [[shard], [len(keys)], *([v] for v in values)])


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _read_shard(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, CuckooFilter]:
    """Digests (sorted), references, smallest ids, filter; a shard that is not there yet is empty."""
    filters = table.column("filter").to_pylist()
    filter_ = CuckooFilter.read(filters[0]) if filters else CuckooFilter.of(np.empty(0, np.uint64))
    return _joined(table, "keys", "S16"), _joined(table, "refs", "<i8").copy(), _joined(table, "firsts", "<i8").copy(), filter_


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted digest stands in sorted ``keys``; -1 where it does not."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


def _as_table(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema=schema)


def add(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
    """One shard with the entries of new blocks counted in."""
    keys, refs, firsts, filter_ = _read_shard(old)
    came, at = np.unique(_joined(new, "keys", "S16"), return_inverse=True)
    more = np.zeros(len(came), np.int64)
    np.add.at(more, at, _joined(new, "refs", "<i8"))
    least = _least_per(at, _joined(new, "firsts", "<i8"), len(came))
    place = np.full(len(came), -1)
    known = filter_.has(_hashes(came))  # the others are new for certain
    place[known] = _place(keys, came[known])
    there = place >= 0
    refs[place[there]] += more[there]
    firsts[place[there]] = np.minimum(firsts[place[there]], least[there])
    fresh = ~there
    keys = np.concatenate([keys, came[fresh]])
    order = np.argsort(keys, kind="stable")
    if not filter_.add(_hashes(came[fresh])):
        filter_ = CuckooFilter.of(_hashes(keys))
    values = keys[order], np.concatenate([refs, more[fresh]])[order], np.concatenate([firsts, least[fresh]])[order]
    return _as_table(_shard_row(key[0].as_py(), *values, filter_), SHARD_ARROW)


def take_back(key: tuple, old: pa.Table, gone: pa.Table) -> pa.Table:
    """One shard without the references in ``gone``; its rows say which, or what remains elsewhere (refs null)."""
    keys, refs, firsts, filter_ = _read_shard(old)
    remains = gone.filter(gone.column("refs").is_null())
    gone = gone.filter(gone.column("refs").is_valid())
    place = _place(keys, _joined(gone, "keys", "S16"))
    np.subtract.at(refs, place, _joined(gone, "refs", "<i8"))
    lost = np.zeros(len(keys), bool)  # keys whose smallest holder may be among the deleted
    lost[place] = True
    place = _place(keys, _joined(remains, "keys", "S16"))
    least = _joined(remains, "firsts", "<i8")[place >= 0]
    place = place[place >= 0]
    firsts[lost] = LAST
    np.minimum.at(firsts, place[lost[place]], least[lost[place]])
    stays = refs > 0
    filter_.remove(_hashes(keys[~stays]))
    return _as_table(_shard_row(key[0].as_py(), keys[stays], refs[stays], firsts[stays], filter_), SHARD_ARROW)


def look_up(_key: tuple, asked: pa.Table, shard: pa.Table) -> pa.Table:
    """For each block the keys that more than one document holds, with their smallest holder."""
    keys, refs, firsts, _ = _read_shard(shard)
    out = [[], [], []]
    for row in asked.select(["block", "start", "keys"]).to_pylist():
        place = _place(keys, _keys(row["keys"]))
        shared = np.flatnonzero(refs[place] > 1)
        if len(shared):
            values = row["block"], _packed(shared + row["start"], "<i8"), _packed(firsts[place[shared]], "<i8")
            for column, value in zip(out, values, strict=True):
                column.append(value)
    return _as_table(rows_of(ANSWER_ARROW, out), ANSWER_ARROW)


def finish(_key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one block without the lines that a smaller document id holds."""
    out = {n: [] for n in RESULT_ARROW.names}
    for row in block.to_pylist():
        docs, at = _read(row["docs"]), _read(row["lines"]).column("at").to_numpy()
        first = np.full(row["n_keys"] + 1, LAST, np.int64)  # the last one is for lines without a key
        first[_joined(answers, "at", "<i8")] = _joined(answers, "firsts", "<i8")
        sizes = docs.column("n_lines").to_numpy()
        goes = first[at] < np.repeat(docs.column("doc_id").fill_null(LAST).to_numpy(), sizes)
        ends = np.cumsum(sizes)
        before = np.concatenate([[0], np.cumsum(goes)])
        dropped = before[ends] - before[ends - sizes]
        for text, end, size, n in zip(docs.column("text").to_pylist(), ends, sizes, dropped, strict=True):
            if n:
                flags = goes[end - size : end].tolist()
                text = b"\n".join(line for line, flag in zip(text.split(b"\n"), flags, strict=True) if not flag)
            out["text"].append(text)
        out["doc_id"] += docs.column("doc_id").to_pylist()
        out["n_lines"] += sizes.tolist()
        out["n_dropped"] += dropped.tolist()
    out["text"] = pa.array(out["text"], pa.binary()).cast(pa.string())
    return pa.table(out, schema=RESULT_ARROW)


def _entries(blocks: DataFrame, shards: int) -> DataFrame:
    return blocks.select("block", "n_keys", "keys", "refs", "firsts").mapInArrow(partial(entries, shards=shards), ENTRY)


def insert(
    docs: DataFrame, index: LineIndex | None = None, least: int = 10, most_bytes: int = 8 << 20, most_keys: int = 500_000
) -> LineIndex:
    """``index`` (None: an empty one) with the rows of ``docs(doc_id, text)`` added.

    A null text counts as empty, which is one empty line; a null id ranks after all others;
    rows with one id are one document as far as its own lines are concerned, and each counts
    as a reference. Other columns are ignored. ``most_bytes`` bounds a block and ``most_keys``
    the entries a shard has on average; shards are cut further as the index grows.
    """
    spark = docs.sparkSession
    last = -1 if index is None else index.blocks.agg(F.max("block")).first()[0]
    job = 0 if last is None else (last >> 43) + 1
    new = stage(docs.select("doc_id", "text").mapInArrow(partial(scan, least=least, most_bytes=most_bytes, job=job), BLOCK), "line-blocks")
    n = new.agg(F.sum("n_keys")).first()[0] or 0
    first = index is None
    if first:
        index = LineIndex(new, spark.createDataFrame([], SHARD), 1)
        n_old, shards = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    else:
        n_old, shards = index.counts.agg(F.sum("n_keys")).first()[0] or 0, index.shards
    shards = 1 << (max(shards, -(-(n + n_old) // most_keys)) - 1).bit_length()
    old = index.counts if shards == index.shards else index.counts.mapInArrow(partial(recut, shards=shards), SHARD)
    counts = old.groupBy("shard").cogroup(_entries(new, shards).groupBy("shard")).applyInArrow(add, SHARD)
    return LineIndex(new if first else index.blocks.unionByName(new), stage(counts, "line-counts"), shards)


def _without(_key: tuple, block: pa.Table, ids: pa.Table) -> pa.Table:
    """Two rows of a block: what remains of it, and the references its deleted documents held (docs null)."""
    out = []
    dead = set(ids.column("doc_id").to_pylist())
    for row in block.to_pylist():
        docs, at = _read(row["docs"]), _read(row["lines"]).column("at").to_numpy().astype(np.int64)
        sizes, keys = docs.column("n_lines").to_numpy(), _keys(row["keys"])
        goes = np.array([i in dead for i in docs.column("doc_id").to_pylist()], bool)
        for part, is_gone in ((~goes, False), (goes, True)):
            if part.any():
                own = at[np.repeat(part, sizes)]
                used = np.unique(own[own >= 0])
                place = np.full(len(keys) + 1, -1, np.int64)
                place[used] = np.arange(len(used))
                made = _as_table(_block_row(row["block"], keys[used], docs.filter(pa.array(part)), place[own]), BLOCK_ARROW)
                if is_gone:
                    made = made.set_column(5, "docs", pa.nulls(1, pa.binary()))
                out.append(made)
    return pa.concat_tables(out) if out else BLOCK_ARROW.empty_table()


def _ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = _read(row["docs"]).column("doc_id").drop_null().unique()
            yield pa.record_batch([pa.array([row["block"]] * len(ids), pa.int64()), ids], names=["block", "doc_id"])


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """``index`` without the documents whose id is in ``ids(doc_id)``: as if they had never been inserted.

    Unknown, null and repeated ids change nothing. Texts are read only in blocks that hold
    one of the documents; keys that lose a holder find their next smallest one in the
    entries of all blocks, which hold no texts.
    """
    wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    found = stage(index.blocks.select("block", "docs").mapInArrow(_ids, "block long, doc_id long").join(wanted, "doc_id", "left_semi"), "line-deleted")
    hit = index.blocks.join(found.select("block").distinct(), "block", "left_semi")
    cut = stage(hit.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_without, BLOCK), "line-blocks")
    rest = index.blocks.join(found.select("block").distinct(), "block", "left_anti")
    blocks = stage(rest.unionByName(cut.where(F.col("docs").isNotNull())), "line-blocks")
    gone = _entries(cut.where(F.col("docs").isNull()), index.shards)
    remains = _entries(blocks, index.shards).withColumn("refs", F.lit(None).cast("binary"))
    back = gone.unionByName(remains)
    counts = index.counts.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(take_back, SHARD)
    return LineIndex(blocks, stage(counts, "line-counts"), index.shards)


def kept_texts(index: LineIndex) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every row in the index: lines held by a smaller id are dropped."""
    answers = _entries(index.blocks, index.shards).groupBy("shard").cogroup(index.counts.groupBy("shard")).applyInArrow(look_up, ANSWER)
    return index.blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, RESULT)


def line_counts(index: LineIndex) -> DataFrame:
    """key (128-bit digest), refs, first: the exact reference counts."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("refs", pa.int64()), ("first", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                raw = row["keys"]
                keys = [raw[i : i + 16] for i in range(0, len(raw), 16)]
                yield from rows_of(schema, [keys, np.frombuffer(row["refs"], "<i8"), np.frombuffer(row["firsts"], "<i8")])

    return index.counts.mapInArrow(rows, "key binary, refs long, first long")


def without_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every row of ``docs``: a new index, and what it keeps.

    Nulls, repeated ids and other columns are treated as ``insert`` says; an empty table
    gives an empty result.
    """
    return kept_texts(insert(docs, least=least))
