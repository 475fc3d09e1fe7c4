"""Vector codes by member-resident Lloyd rounds.

Vectors become integers and are cut into equal parts; each position has a codebook, and a
part is named by its nearest entry. Parts live with their owner: the partition that
(position, entry, salt) hashes to. A round has two steps:

* Update: each partition sums its resident members by (position, entry); the sums, whose size
  is that of the codebooks, are added up and give the new entries.
* Move: each partition assigns its residents anew. Those that keep their entry stay where they
  are; only the others are shuffled to their new owners, and both halves are united
  partition by partition.

The salt spreads the members of one entry over all partitions, so an entry that a third of all
vectors share is no task of its own. What reaches the driver are the codebooks. The residents
are kept on the executors; a lost one is made again from the written vectors and the shuffled
moves of the rounds so far.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of
from tidemark.llm.topk_search import quantised
from tidemark.session import stage

LONGEST = (1 << 63) - 1
EXACT = 1 << 53  # whole numbers below this are exact as doubles
CHUNK = 4096  # vectors compared with a codebook at a time
FEW = 32  # entries that are summed under one key

PACKED = "rows binary, vectors binary"
PACKED_ARROW = pa.schema([("rows", pa.binary()), ("vectors", pa.binary())])
NAMED = "rows binary, positions binary, entries binary, errors binary"
PART = "row long, position int, entry int, error long"
PART_ARROW = pa.schema([("row", pa.int64()), ("position", pa.int32()), ("entry", pa.int32()), ("error", pa.int64())])

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # rows, positions, entries, parts


class Codes(NamedTuple):
    """``rows(vec_id, label, entries array<int>, error long)`` and the codebooks, one array (entries x width) a position."""

    rows: DataFrame
    codebooks: list[np.ndarray]


class Shape(NamedTuple):
    """What all tasks know: positions, width of a part, number of entries, whether doubles are exact, partitions."""

    n_parts: int
    width: int
    n_entries: int
    exact: bool
    kind: str
    partitions: int


def place(key: int) -> int:
    """The partition of a key: keys are partition numbers already."""
    return key


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(33))


def owners(rows: np.ndarray, positions: np.ndarray, entries: np.ndarray, shape: Shape) -> np.ndarray:
    """The partition of (position, entry, salt); there are as many salts as partitions."""
    salt = _mixed(rows) % np.uint64(shape.partitions)
    entry = positions.astype(np.uint64) * np.uint64(shape.n_entries) + entries.astype(np.uint64)
    return (_mixed(entry * np.uint64(shape.partitions) + salt) % np.uint64(shape.partitions)).astype(np.int64)


def nearest(parts: np.ndarray, codebook: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of equally near ones) and squared distance of each part, both exact."""
    entries, errors = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if exact:
        book = codebook.astype(np.float64)
        squares = (book**2).sum(axis=1)
    for start in range(0, len(parts), CHUNK if exact else 16):
        part = parts[start : start + (CHUNK if exact else 16)]
        if exact:
            part = part.astype(np.float64)
            far = squares - 2 * (part @ book.T)
            best = far.argmin(axis=1)
            error = far[np.arange(len(part)), best] + (part**2).sum(axis=1)
        else:  # too large for doubles: whole numbers of any size
            far = ((part.astype(object)[:, None, :] - codebook.astype(object)[None]) ** 2).sum(axis=2)
            best = np.array([min(range(len(f)), key=f.__getitem__) for f in far], np.int64)
            error = np.array([min(int(f[i]), LONGEST) for f, i in zip(far, best, strict=True)], np.int64)
        entries.append(best)
        errors.append(error.astype(np.int64))
    return np.concatenate(entries), np.concatenate(errors)


def _by_owner(block: Block, shape: Shape) -> Iterator[tuple[int, Block]]:
    rows, positions, entries, _ = block
    owner = owners(rows, positions, entries, shape)
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(order)], strict=False):  # no start: nothing to deal out
        yield int(owner[order[a]]), tuple(x[order[a:b]] for x in block)


def _one(elements: Iterable[tuple[int, Block]], shape: Shape) -> Block:
    """All members of a partition."""
    blocks = [block for _, block in elements]
    if not blocks:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint8), none.astype(np.uint16), np.empty((0, shape.width), shape.kind)
    return tuple(np.concatenate(x) for x in zip(*blocks, strict=True))


def _assigned(block: Block, books: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    rows, positions, _, parts = block
    entries, errors = np.empty(len(rows), np.uint16), np.empty(len(rows), np.int64)
    for position, book in enumerate(books):
        own = positions == position
        entries[own], errors[own] = nearest(parts[own], book, shape.exact)
    return entries, errors


def settle(packed: Iterable, books, shape: Shape) -> Iterator[tuple[int, Block]]:
    """The first assignment: every part goes to its owner."""
    for row in packed:
        rows = np.frombuffer(row["rows"], "<i8")
        vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(rows), -1).astype(shape.kind)
        for position, book in enumerate(books.value):
            parts = vectors[:, position * shape.width : (position + 1) * shape.width]
            entries, _ = nearest(parts, book, shape.exact)
            yield from _by_owner((rows, np.full(len(rows), position, np.uint8), entries.astype(np.uint16), parts), shape)


def sums(elements: Iterable[tuple[int, Block]], shape: Shape) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Count and componentwise sum of a partition's members by position and entry, a few entries a key."""
    _, positions, entries, parts = _one(elements, shape)
    for position in range(shape.n_parts):
        own = positions == position
        if own.any():
            held = np.zeros((-(-shape.n_entries // FEW) * FEW, shape.width + 1), np.int64 if shape.exact else object)
            np.add.at(held, entries[own], np.column_stack([np.ones(own.sum(), held.dtype), parts[own].astype(held.dtype)]))
            for first in range(0, len(held), FEW):
                if held[first : first + FEW, 0].any():
                    yield (position, first), held[first : first + FEW]


def move(index: int, elements: Iterable[tuple[int, Block]], books, shape: Shape) -> Iterator[tuple[int, Block]]:
    """Members that keep their entry, under this partition's number, and the others under their new owner's."""
    block = _one(elements, shape)
    rows, positions, old, parts = block
    entries, _ = _assigned(block, books.value, shape)
    stays = entries == old
    if stays.any():
        yield index, tuple(x[stays] for x in block)
    gone = ~stays
    for owner, part in _by_owner((rows[gone], positions[gone], entries[gone], parts[gone]), shape):
        yield owner, part


def name(elements: Iterable[tuple[int, Block]], books, shape: Shape) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
    """The last assignment: rows, positions, entries and squared distances of a partition's members."""
    block = _one(elements, shape)
    entries, errors = _assigned(block, books.value, shape)
    for a in range(0, len(entries), 1 << 18):
        some = slice(a, a + (1 << 18))
        yield tuple(x[some].astype(k).tobytes() for x, k in zip((block[0], block[1], entries, errors), ("<i8", "u1", "<u2", "<i8"), strict=True))


def _packed(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Vectors as rows of integers, shorter ones filled up with zeros."""
    for batch in batches:
        lists = batch.column("vector")
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(sizes), width), np.int64)
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(sizes)), sizes), inner] = lists.flatten().to_numpy(zero_copy_only=False)
        yield from rows_of(PACKED_ARROW, [[batch.column("row").to_numpy().astype("<i8").tobytes()], [out.astype("<i8").tobytes()]])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            kinds = (("rows", "<i8"), ("positions", "u1"), ("entries", "<u2"), ("errors", "<i8"))
            yield from rows_of(PART_ARROW, [pa.array(np.frombuffer(row[n], k)).cast(f.type) for (n, k), f in zip(kinds, PART_ARROW, strict=True)])


def _least_ids(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    held = pa.array([], pa.int64())
    for batch in batches:
        held = pa.concat_arrays([held, batch.column("vec_id")]).unique()
        held = held.take(pa.compute.sort_indices(held, null_placement="at_end")[:n])
    yield pa.record_batch([held], names=["vec_id"])


def _usable(vector: Column) -> Column:
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return vector.isNotNull() & F.forall(vector, finite)


def _first_books(used: DataFrame, shape: Shape) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids."""
    ids = used.select("vec_id").mapInArrow(partial(_least_ids, n=shape.n_entries), "vec_id long").distinct()
    ids = [r[0] for r in ids.orderBy(F.asc_nulls_last("vec_id")).limit(shape.n_entries).collect()]
    known = [i for i in ids if i is not None]
    wanted = F.col("vec_id") <= max(known) if known else F.lit(False)
    if None in ids:
        wanted = wanted | F.col("vec_id").isNull()
    found = used.where(wanted).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("vec_id"))
    whole = np.zeros((len(ids), shape.n_parts * shape.width), np.int64)
    for row, r in zip(whole, found.collect(), strict=True):
        row[: len(r["vector"])] = r["vector"]
    return [whole[:, p * shape.width : (p + 1) * shape.width].copy() for p in range(shape.n_parts)]


def _renewed(books: list[np.ndarray], totals: Iterable[tuple[tuple[int, int], np.ndarray]]) -> list[np.ndarray]:
    """Each used entry becomes the floor of its members' mean; unused ones stay."""
    books = [b.copy() for b in books]
    for (position, first), held in totals:
        for i, row in enumerate(held):
            if row[0]:
                books[position][first + i] = row[1:] // row[0]
    return books


def compress(
    vectors: DataFrame,
    n_parts: int = 4,
    n_entries: int = 256,
    rounds: int = 4,
    scale: float = 1024.0,
    most_bytes: int = 64 << 20,
) -> Codes:
    """Codes of ``vectors(vec_id, embedding, label)`` after ``rounds`` rounds, and the codebooks.

    Components become floor(scale * x). The codebooks start as the parts of the vectors with
    the ``n_entries`` smallest ids (null ids last; of vectors with one id the smallest vector
    counts); fewer ids give fewer entries. Null vectors and those with null or non-finite
    components are left out. All other rows come out, repeated ones each; vectors of unequal
    length, or of a length that does not divide, count as filled up with zeros. Distances too
    large for a long are the largest long. Other columns are ignored; an empty table gives an
    empty result. ``most_bytes`` bounds a partition of residents on average.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), quantised(F.col("embedding"), scale).alias("vector")]
    used = stage(vectors.where(_usable(F.col("embedding"))).select(*columns).withColumn("row", F.monotonically_increasing_id()), "vector-parts")
    largest = F.aggregate("vector", F.lit(0).cast("long"), lambda m, x: F.greatest(m, x, -x - 1))
    facts = used.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(largest).alias("largest")).first()
    if not facts["n"]:
        none = used.select("vec_id", "label", F.lit(None).cast("array<int>").alias("entries"), F.lit(None).cast("long").alias("error"))
        return Codes(none, [])
    width, top = -(-facts["width"] // n_parts), facts["largest"] + 1
    exact = n_parts * max(width, 1) * (2 * top) ** 2 < EXACT and facts["n"] * top < LONGEST
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, -(-facts["n"] * n_parts * (width * np.dtype(kind).itemsize + 11) // most_bytes))
    shape = Shape(n_parts, width, n_entries, exact, kind, partitions)
    books = _first_books(used, shape)
    shape = shape._replace(n_entries=len(books[0]))

    packed = used.select("row", "vector").mapInArrow(partial(_packed, width=n_parts * width), PACKED).rdd
    told = sc.broadcast(books)
    state = packed.mapPartitions(partial(settle, books=told, shape=shape)).partitionBy(partitions, place)
    kept = []
    for step in range(rounds):
        totals = state.mapPartitions(partial(sums, shape=shape)).reduceByKey(np.add).collect()
        books = _renewed(books, totals)
        told = sc.broadcast(books)
        if step + 1 < rounds:
            after = state.mapPartitionsWithIndex(partial(move, books=told, shape=shape), preservesPartitioning=True)
            kept.append(after.persist(StorageLevel.MEMORY_AND_DISK))
            stay = after.mapPartitionsWithIndex(partial(_own, own=True), preservesPartitioning=True)
            state = stay.union(after.mapPartitionsWithIndex(partial(_own, own=False)).partitionBy(partitions, place))
    parts = spark.createDataFrame(state.mapPartitions(partial(name, books=told, shape=shape)), NAMED, verifySchema=False)
    parts = stage(parts.mapInArrow(_unpacked, PART), "vector-names")
    for rdd in kept:
        rdd.unpersist()
    by_row = parts.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("position", "entry"))).alias("held"), F.try_sum("error").alias("error")
    )
    rows = used.select("row", "vec_id", "label").join(by_row, "row").select(
        "vec_id", "label", F.col("held.entry").alias("entries"), F.coalesce("error", F.lit(LONGEST)).alias("error")
    )
    return Codes(stage(rows, "vector-codes"), books)


def _own(index: int, elements: Iterable[tuple[int, Block]], own: bool) -> Iterator[tuple[int, Block]]:
    return (x for x in elements if (x[0] == index) == own)


def with_label_errors(rows: DataFrame, salts: int = 16) -> DataFrame:
    """``rows`` with ``label_error``, the errors of all rows of a label summed (null labels together).

    A label that most rows have is dealt over ``salts`` keys on its way back to them.
    """
    total = rows.groupBy("label").agg(F.coalesce(F.try_sum("error"), F.lit(LONGEST)).alias("label_error"))
    total = total.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "entries", "error"), F.lit(salts)).cast("int"))
    return salted.join(total, salted["label"].eqNullSafe(total["of"]) & (salted["salt"] == total["part"])).drop("of", "part", "salt")


def duckdb_sql(n_parts: int = 4, n_entries: int = 256, rounds: int = 4) -> str:
    """The same in SQL, for tables on which all distances are exact as doubles."""
    assign = """
a{i} AS MATERIALIZED (
  SELECT r, pos, min({{'d': list_inner_product(b.part, b.part) - 2 * list_inner_product(p.part, b.part), 'entry': entry}}) AS best
  FROM p JOIN b{i} b USING (pos) GROUP BY r, pos)"""
    renew = """
m{i} AS MATERIALIZED (
  SELECT pos, entry, list(mean ORDER BY i) AS part
  FROM (SELECT pos, best.entry AS entry, i, floor(sum(part[i]) / count(*)) AS mean
        FROM a{i} JOIN p USING (r, pos), (SELECT unnest(range(1, (SELECT max(len(part)) FROM p) + 1)) AS i) GROUP BY ALL)
  GROUP BY pos, entry),
b{j} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM b{i} b LEFT JOIN m{i} m USING (pos, entry))"""
    steps = ",".join(assign.format(i=i) + "," + renew.format(i=i, j=i + 1) for i in range(rounds)) + "," + assign.format(i=rounds)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, vec_id, pos, vector[pos * (len(vector) // {n_parts}) + 1 : (pos + 1) * (len(vector) // {n_parts})] AS part
  FROM v, (SELECT unnest(range({n_parts})) AS pos)),
b0 AS MATERIALIZED (
  SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part FROM p
  QUALIFY row_number() OVER (PARTITION BY pos ORDER BY vec_id) <= {n_entries}),{steps},
e AS (
  SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY pos) AS code,
         sum(best.d + list_inner_product(part, part))::BIGINT AS error
  FROM a{rounds} JOIN p USING (r, pos) GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY pos, entry, i))
        FROM (SELECT pos, entry, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM b{rounds})) AS codebooks_sha256
FROM e JOIN v USING (r)
"""
