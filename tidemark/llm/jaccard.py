"""Near-duplicate documents by an exact n-gram Jaccard join: a grouped prefix join.

1. A document is its set of hashed word n-grams. Equal word sequences are one text (digest).
2. N-grams have one global order: by a count sketch of fixed size over all texts, rare first,
   then by hash. Any order gives the same result; this one keeps passages that many documents
   share out of the prefixes. The prefix of a set are its first n - ceil(t n) + 1 members; two
   sets as similar as t share a member of their prefixes, which for the smaller set is even
   among the first n - ceil(2t / (1 + t) n) + 1.
3. Texts with the same prefix and size are one group (of one scan task; groups of several
   tasks that are alike meet in every list of theirs). For each n-gram the groups that hold it
   in their prefix are put in order of size, and a group is linked to the next smaller one
   that passes the size and prefix filters: no list is multiplied out. The components of these
   links are clusters that no similar pair leaves.
4. In a large corpus n-grams that a few texts share by chance get into prefixes, and links
   over them put most texts into one cluster. A cluster larger than a task's share of the texts
   is therefore split first, by n-grams that are shared many at a time: sets are cut by hash
   into more parts than similar ones can differ in members, so that parts of them are equal,
   and equal parts are linked in the same way. What step 3 or this one separates is not similar.
5. Clusters are expanded to their texts, whose whole sets are compared. A cluster that is still
   larger is cut into blocks and every pair of blocks is a task of its own. A task returns
   which texts hang together, never the pairs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import digest, few_rows_at_once, free_names, rows_of, small, texts
from tidemark.llm.groups import components, gathered, local_components, may_hold, runs, sieve, sliced
from tidemark.llm.token_counts import _packed, _unpacked
from tidemark.session import stage

SKETCH_BITS = 22  # counters of the sketch: 16 MB in a task, 8 MB sent to tasks, whatever the input
MOST_COUNTED = (1 << 16) - 1

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTES = np.random.default_rng(1).integers(0, 1 << 63, 256).astype(np.uint64)


class Powers:
    """Powers of the odd base and of its inverse modulo 2^64, extended as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.up):
            n = max(2 * n, 1 << 16)
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n, _ODD, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)


_powers = Powers()


def mixed(value: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers, so that any of their bits can be used."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def joined_words(text: bytes) -> bytes:
    """Words between ASCII white space, A-Z lowered, joined by single spaces."""
    return b" ".join(text.lower().split())


def shingles(words: bytes, n: int) -> np.ndarray:
    """Distinct hashes of the n-word sequences of a joined text; fewer words are one sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(words, np.uint8)
    _powers.reach(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[raw] * _powers.up[: len(raw)], out=sums[1:])
    blanks = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(raw)]])
    k = min(n, len(starts))
    first = starts[: len(starts) - k + 1]
    return np.unique(mixed((sums[ends[k - 1 :]] - sums[first]) * _powers.down[first] + np.uint64(k)))


# ------------------------------------------------------------------- rows and the sketch

SEEN = "doc_id long, digest binary, n long, slice int, part binary"
SEEN_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("slice", pa.int32()), ("part", pa.binary())]
)


def seen_rows(batches: Iterable[pa.RecordBatch], n_words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, digest and size of every row; then this task's counts of hashed n-grams."""
    known: dict[bytes, int] = {}
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in small(batches):
        digests, sizes, places = [], [], []
        for text in texts(batch.column("text")):
            words = joined_words(text)
            name = digest(words)[:16]
            if name not in known:
                found = shingles(words, n_words)
                known[name] = len(found)
                places.append(found >> np.uint64(64 - SKETCH_BITS))
            digests.append(name)
            sizes.append(known[name])
        if places:
            hit, times = np.unique(np.concatenate(places), return_counts=True)
            counts[hit.astype(np.int64)] += times.astype(np.uint32)
        none = [None] * len(digests)
        yield from rows_of(SEEN_ARROW, [batch.column("doc_id").cast(pa.int64()), digests, sizes, none, none])
    for batch in sliced(counts):
        none = [None] * batch.num_rows
        yield from rows_of(SEEN_ARROW, [none, none, none, *batch.columns])


# ------------------------------------------------------------------- groups and candidates

POSTED = "digest binary, gid long, bucket int, tokens binary, numbers binary"
POSTED_ARROW = pa.schema(
    [("digest", pa.binary()), ("gid", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("numbers", pa.binary())]
)


def prefix(found: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The first members in the global order, and how many of them a smaller set is found by."""
    n = len(found)
    order = np.lexsort((found, counts[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
    probe = n - -(-num * n // den) + 1
    index = n - -(-2 * num * n // (num + den)) + 1
    return found[order[:probe]], index


_lows: dict[tuple[int, int], list[int]] = {}


def size_classes(n: int, num: int, den: int) -> list[int]:
    """Smallest sizes of classes, past n; similar sets are of one class or of neighbouring ones."""
    lows = _lows.setdefault((num, den), [1])
    while lows[-1] <= n:
        low = lows[-1]
        lows.append(max(low + 1, low * den // num, low * 17 // 16))
    return lows


def parts_of(found: np.ndarray, weights: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """Hashes of parts of a set, of which any two similar sets share one; all find smaller sets.

    Where the smaller set of a pair is of a class, the sets differ in at most ``differ``
    members. Cut into ``total`` parts, ``total - differ`` parts at least are equal, and one of
    these is among the first ``differ + 1`` in any order of part contents: heavy ones first.
    """
    n = len(found)
    lows = size_classes(n, num, den)
    own = bisect_right(lows, n) - 1
    spread, weight = mixed(found), weights[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    out = []
    for k in range(max(own - 1, 0), own + 1):  # as the larger set of a pair, and as the smaller
        largest = lows[k + 1] - 1
        if num * n > den * largest:
            continue
        differ = (den - num) * (largest + largest * den // num) // (den + num)
        total = differ + 1 + (differ + 1) // 2
        part = (found % np.uint64(total)).astype(np.int64)
        sums = np.arange(total, dtype=np.uint64) + np.uint64((k + 1) << 40)
        np.add.at(sums, part, spread)
        sums = mixed(sums)
        heavy = np.bincount(part, weights=weight, minlength=total)  # whole numbers, so exact
        out.append(sums[np.lexsort((sums, -heavy))[: differ + 1]])
    out = np.concatenate(out)
    return out, len(out)


def posted(
    batches: Iterable[pa.RecordBatch],
    n_words: int,
    keys: Callable[[np.ndarray], tuple[np.ndarray, int]],
    buckets: int,
    most: int,
    wanted: np.ndarray | None = None,
) -> Iterator[pa.RecordBatch]:
    """Group of each text (that may be wanted), and the groups' keys dealt into buckets.

    Keys are n-grams of a prefix or hashes of parts. A group has a number; its postings in a
    bucket are keys, and the group's distance from the one before, its size and whether a
    smaller set is found by the key.
    """
    known: set[bytes] = set()
    groups: dict[bytes, int] = {}
    base = TaskContext.get().partitionId() << 36
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        token, group, size2 = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        numbers, starts = np.unique(bucket[order], return_index=True)
        rows = []
        for number, part in zip(numbers.tolist(), np.split(order, starts[1:]), strict=True):
            first = int(group[part[0]])
            steps = np.diff(group[part], prepend=first)
            rows.append((None, base + first, number, token[part].tobytes(), _packed(np.concatenate([steps, size2[part]]))))
        yield from rows_of(POSTED_ARROW, list(zip(*rows, strict=True)), 64)

    for batch in small(batches):
        names, gids = [], []
        joined = [joined_words(text) for text in texts(batch.column("text"))]
        digests = [digest(words)[:16] for words in joined]
        may = [True] * len(joined) if wanted is None else may_hold(wanted, digests)
        for words, name, asked in zip(joined, digests, may, strict=True):
            if not words or not asked or name in known:
                continue
            known.add(name)
            found = shingles(words, n_words)
            first, index = keys(found)
            key = digest(len(found).to_bytes(8, "big") + first.tobytes())[:16]
            if key not in groups:
                groups[key] = len(groups)
                size2 = np.full(len(first), 2 * len(found))
                size2[:index] += 1
                held.append((first, np.full(len(first), groups[key]), size2))
                size += len(first)
            names.append(name)
            gids.append(base + groups[key])
            if size > most:
                yield from flush()
                held, size = [], 0
        none = [None] * len(names)
        yield from rows_of(POSTED_ARROW, [names, gids, none, none, none])
    if held:
        yield from flush()


def _postings(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for first, tokens, numbers in zip(*(batch.column(n).to_pylist() for n in ("gid", "tokens", "numbers")), strict=True):
        steps, size2 = np.split(_unpacked(numbers), 2)
        rows = np.empty(len(steps), _POSTING)
        rows["token"], rows["gid"] = np.frombuffer(tokens, "<u8"), first + np.cumsum(steps)
        rows["n"], rows["indexed"] = size2 >> 1, size2 & 1
        yield rows


_POSTING = np.dtype([("token", "<u8"), ("gid", "<i8"), ("n", "<i8"), ("indexed", "<i4")])


def candidate_links(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Which groups of a bucket hang together: each with the smallest of its component."""
    parts = [rows for batch in batches for rows in _postings(batch)]
    if not parts:
        return
    rows = np.concatenate(parts)
    del parts
    order = np.lexsort((rows["gid"], -rows["indexed"], rows["n"], rows["token"]))
    rows = rows[order]
    same = rows["token"][1:] == rows["token"][:-1]
    again = np.concatenate([[False], same & (rows["gid"][1:] == rows["gid"][:-1])])  # copies of one group
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    rows = rows[shared & ~again]
    if not len(rows):
        return
    # the nearest indexed row before each row, if it stands in the same list
    at = np.arange(len(rows))
    indexed = rows["indexed"] == 1
    last = np.maximum.accumulate(np.where(indexed, at, -1))
    last = np.concatenate([[-1], last[:-1]])
    smaller = rows[np.maximum(last, 0)]
    good = (last >= 0) & (smaller["token"] == rows["token"]) & (den * smaller["n"] >= num * rows["n"])
    names, place = np.unique(np.concatenate([rows["gid"][good], smaller["gid"][good]]), return_inverse=True)
    a, b = np.split(place, 2)
    label = local_components(len(names), a, b)
    linked = np.flatnonzero(label != np.arange(len(names)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    yield from rows_of(schema, [names[linked], names[label[linked]]])


# ------------------------------------------------------------------- comparing whole sets

WORDS = "digest binary, words binary"
WORDS_ARROW = pa.schema([("digest", pa.binary()), ("words", pa.binary())])


def joined_texts(batches: Iterable[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Digest and words of the texts that may be wanted."""
    known: set[bytes] = set()
    for batch in small(batches):
        found = [joined_words(text) for text in texts(batch.column("text"))]
        names = [digest(words)[:16] for words in found]
        rows = []
        for name, words, may in zip(names, found, may_hold(wanted, names), strict=True):
            if may and name not in known:
                known.add(name)
                rows.append((name, zlib.compress(words, 6)))  # shuffled twice
        if rows:
            yield from rows_of(WORDS_ARROW, list(zip(*rows, strict=True)), 2000)


def similar(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets whose intersection is at least num/den of their union.

    Counts common members of all pairs at once: a member that few sets hold adds to its
    pairs, the members that many sets hold are multiplied out as 0/1 columns.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    members = np.concatenate(sets)
    order = np.lexsort((owner, members))
    owner, members = owner[order], members[order]
    starts = np.flatnonzero(np.concatenate([[True], members[1:] != members[:-1]]))
    held = np.diff(np.append(starts, len(members)))
    common = np.zeros((m, m), np.float32)
    for few in range(2, min(17, m + 1)):
        rows = owner[starts[held == few][:, None] + np.arange(few)]
        if len(rows):
            for i in range(few):
                for j in range(i + 1, few):
                    common += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m).reshape(m, m)
    many = np.flatnonzero(held > 16)
    for a in range(0, len(many), 2048):
        part = many[a : a + 2048]
        flags = np.zeros((m, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), held[part])
        inside = np.arange(held[part].sum()) - np.repeat(np.cumsum(held[part]) - held[part], held[part])
        flags[owner[np.repeat(starts[part], held[part]) + inside], column] = 1
        common += np.triu(flags @ flags.T, 1)
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu((den * common >= num * union) & (common > 0), 1))


def verified(batches: Iterable[pa.RecordBatch], n_words: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Texts of a cluster (or of two of its blocks) that hang together, as stars."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    for table in runs(batches, ["cluster", "piece", "low", "high"]):
        words = dict(zip(table.column("digest").to_pylist(), table.column("words").to_pylist(), strict=True))
        names = sorted(words)
        if len(names) > 1:
            a, b = similar([shingles(zlib.decompress(words[name]), n_words) for name in names], num, den)
            label = local_components(len(names), a, b)
            linked = np.flatnonzero(label != np.arange(len(names))).tolist()
            if linked:
                yield from rows_of(schema, [[names[i] for i in linked], [names[label[i]] for i in linked]])


def jaccard_components(
    docs: DataFrame, n_words: int = 5, num: int = 80, den: int = 100, block: int = 128, most: int = 1_000_000
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``.

    Two rows are linked when ``den * |intersection| >= num * |union|`` of their n-gram sets;
    component_id is the smallest doc_id that links lead to. Words lie between ASCII white
    space, A-Z lowered; a text of fewer words is one n-gram; null and blank texts are empty
    and linked with nothing. Repeated rows each come out, linked with each other; a row
    without doc_id comes out and never names a component unless none of it has one (null).
    Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    return _components(docs, n_words, num, den, block, most).select("doc_id", "n_shingles", "component_id")


def _clustered(post: DataFrame, parts: int, num: int, den: int, name: str) -> DataFrame:
    """digest, cluster of the texts in ``post``: similar ones are in one cluster."""
    links = (
        post.where(F.col("bucket").isNotNull())
        .select("bucket", "gid", "tokens", "numbers")
        .repartition(parts, "bucket")
        .mapInArrow(partial(candidate_links, num=num, den=den), "a long, b long")
    )
    clusters = components(links, name)
    members = post.where(F.col("digest").isNotNull()).select("digest", "gid")
    return members.join(clusters, members["gid"] == clusters["node"], "left").select(
        "digest", F.coalesce("label", "gid").alias("cluster")
    ).distinct()


def _components(docs: DataFrame, n_words: int, num: int, den: int, block: int, most: int) -> DataFrame:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = few_rows_at_once(docs).select("doc_id", "text")
    seen = stage(source.mapInArrow(partial(seen_rows, n_words=n_words), SEEN), "jaccard-rows")
    sketched = seen.where(F.col("slice").isNotNull()).select("slice", "part")
    # larger counts are told apart by hash only; any order is right
    counts = np.minimum(gathered(sketched, "<u4", np.add, 1 << SKETCH_BITS), MOST_COUNTED).astype(np.uint16)
    step = partial(posted, n_words=n_words, buckets=parts, most=most)
    first = partial(step, keys=partial(prefix, counts=counts, num=num, den=den))
    post = stage(source.select("text").mapInArrow(first, POSTED), "jaccard-prefixes")
    clustered = _clustered(post, parts, num, den, "jaccard-clusters").withColumn("piece", F.lit(0).cast("long"))
    sizes = stage(clustered.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1"), "jaccard-sizes")
    total, largest = sizes.agg(F.sum("size"), F.max("size")).first()
    share = (total or 0) // (2 * parts)  # half of what each task would get
    at_once = min(max(block, share), 8 * block)
    clustered = clustered.join(sizes, "cluster")
    if (largest or 0) > at_once and 2 * num > den:  # else parts have next to no members
        clustered = stage(clustered, "jaccard-unsplit")
        large = clustered.where(F.col("size") > at_once).drop("piece", "size")
        weights = np.rint(8 * (17 - np.log2(counts + 1.0))).astype(np.uint8)
        keys = partial(parts_of, weights=weights, num=num, den=den)
        again = partial(step, keys=keys, wanted=sieve(large.select("digest")))
        post = stage(source.select("text").mapInArrow(again, POSTED), "jaccard-parts")
        pieces = _clustered(post, parts, num, den, "jaccard-pieces").withColumnRenamed("cluster", "piece")
        split = stage(large.join(pieces, "digest"), "jaccard-split")
        sizes = split.groupBy("cluster", "piece").agg(F.count("*").alias("size")).where("size > 1")
        clustered = clustered.where(F.col("size") <= at_once).unionByName(split.join(sizes, ["cluster", "piece"]))
    blocks = F.ceil(F.col("size") / at_once)
    mine = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda b: b != mine)
    to_verify = stage(
        clustered.withColumn("blocks", blocks)
        .withColumn("others", F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(others))
        .select("digest", "cluster", "piece", "others", mine.alias("mine")),
        "jaccard-clustered",
    )
    wanted = sieve(to_verify.select("digest"))
    compared = (
        source.select("text")
        .mapInArrow(partial(joined_texts, wanted=wanted), WORDS)
        .join(to_verify, "digest")
        .select("cluster", "piece", "mine", "others", "digest", "words")
        .select("cluster", "piece", "mine", "digest", "words", F.explode("others").alias("other"))
        .select(
            "cluster", "piece", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "digest", "words"
        )
        .repartition(parts, "cluster", "piece", "low", "high")
        .sortWithinPartitions("cluster", "piece", "low", "high")
        .mapInArrow(partial(verified, n_words=n_words, num=num, den=den), "a binary, b binary")
    )
    linked = components(compared, "jaccard-links")
    rows = seen.where(F.col("digest").isNotNull()).select("doc_id", "digest", "n")
    each = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    labelled = each.join(linked, each["digest"] == linked["node"], "left").select(
        "digest", "least", F.coalesce("label", "digest").alias("label")
    )
    smallest = labelled.groupBy("label").agg(
        F.min("least").alias("component"), F.min(F.struct(F.col("least").isNull(), "least", "digest")).alias("first")
    )
    named = labelled.join(smallest, "label").select("digest", "component", F.col("first.digest").alias("keep_digest"))
    return rows.join(named, "digest").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        "digest",
        "keep_digest",
    )


# ------------------------------------------------------------------- dropping near copies


def _digested(batches: Iterable[pa.RecordBatch], dropped: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        digests = [digest(joined_words(t))[:16] for t in texts(batch.column("text"))]
        yield batch.append_column(names[0], pa.array(digests, pa.binary())).append_column(
            names[1], pa.array(may_hold(dropped, digests))
        )


def without_near_copies(
    docs: DataFrame, n_words: int = 5, num: int = 80, den: int = 100, block: int = 128, most: int = 1_000_000
) -> DataFrame:
    """The rows of ``docs`` with one row of each component, all their columns.

    The row with the smallest doc_id stays (a null id only where there is no other). Rows
    whose text is empty or blank (or null) are in no component and all stay; an empty table
    stays empty. Columns may have any names: inner ones are made to differ from them.
    """
    found = stage(_components(docs, n_words, num, den, block, most).where("n_shingles > 0"), "jaccard-components")
    # rows of one component alone stay without a join; `shared` names the texts of the others
    stays = (F.col("digest") == F.col("keep_digest")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    multiple = found.groupBy("component_id", "keep_digest").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = found.join(
        multiple.select(F.col("keep_digest").alias("m_digest")), F.col("keep_digest") == F.col("m_digest"), "left_semi"
    )
    sifted = sieve(shared.select("digest").distinct())
    named, maybe = names = free_names(docs, "_digest", "_sifted")
    added = [T.StructField(named, T.BinaryType()), T.StructField(maybe, T.BooleanType())]
    keyed = docs.mapInArrow(partial(_digested, dropped=sifted, names=names), T.StructType([*docs.schema.fields, *added]))
    alone = keyed.where(~F.col(maybe)).drop(*names)
    kept = found.where(stays).select(F.col("doc_id").alias("keep_id"), F.col("digest").alias("keep_digest")).distinct()
    rest = keyed.where(F.col(maybe)).drop(maybe)
    blank = F.col(named) == F.lit(digest(b"")[:16])
    same = rest["doc_id"].eqNullSafe(kept["keep_id"]) & (rest[named] == kept["keep_digest"])
    # equal ids with equal words are one row; blank texts are not compared
    first = rest.where(~blank).join(kept, same, "left_semi").dropDuplicates(["doc_id", named])
    return alone.unionByName(first.drop(named)).unionByName(rest.where(blank).drop(named))
