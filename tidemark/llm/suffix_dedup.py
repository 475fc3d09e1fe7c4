"""Removing byte strings that occur more than once: a sparse suffix array by deep-shallow sorting.

Every ``width``-byte window holds an anchor: the position of the smallest hash among its
``gram``-byte strings. Equal windows have equal anchors at equal places, so only suffixes that
begin near anchors with equal grams need sorting.

1. Tasks find the anchors of their distinct texts and name each by its gram and by its whole
   context, that is all the windows it can stand in. A context that occurs twice is duplicate
   throughout; copies and the inside of shared passages end here, by counting.
2. Anchors whose gram has several contexts lie at edges: of passages, or next to edits. Their
   suffixes are dealt out by the core that a quarter of their windows share, and each bucket is
   sorted: all groups at once by eight bytes, twice, with a library sort in place of multikey
   quicksort; groups with a longer common prefix go to blind tries. The order of suffixes that begin further left is
   induced from it by the byte in front. Neighbours with ``width`` common bytes are duplicates.
3. A gram with more than ``many`` contexts would be a large bucket; its windows are counted one
   by one by their hashes instead, which adds up before it is shuffled.
4. Intervals come together per text, are merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import digest, few_rows_at_once, rows_of, small, texts
from tidemark.llm.groups import may_hold, sieve
from tidemark.llm.jaccard import _BYTES, _powers, mixed
from tidemark.session import stage

WIDTH = 200
CLASSES, SLACK = 4, 33  # a window may begin at CLASSES * (SLACK + 1) places before its anchor
LEFT = CLASSES * (SLACK + 1) - 1
GRAM = WIDTH - LEFT
CORE = WIDTH - SLACK
SEGMENT = 1 << 18
MOST = np.uint64((1 << 64) - 1)

# ------------------------------------------------------------------- anchors

FOUND = "doc_id long, digest binary, n long, tid long, h long, c long, pos int, left short, right short"
FOUND_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("tid", pa.int64()), ("h", pa.int64())]
    + [("c", pa.int64()), ("pos", pa.int32()), ("left", pa.int16()), ("right", pa.int16())]
)


def _sliding(values: np.ndarray, count: int, least: bool) -> np.ndarray:
    """Smallest (largest) of the ``count`` values from each place on; shorter by count - 1."""
    join = np.minimum if least else np.maximum
    power, out = 1, values
    while 2 * power <= count:
        out = join(out[:-power], out[power:])
        power *= 2
    rest = count - power
    return join(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(segments: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Place in ``segments``, position, gram and context hash, context reach to either side.

    A segment is (length of its text, first byte, first window, bytes); it answers for the
    windows from its first window to as far as its bytes reach, ``SEGMENT`` at most.
    """
    raw = np.frombuffer(b"".join(s[3] for s in segments), np.uint8)
    _powers.reach(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[raw] * _powers.up[: len(raw)], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * _powers.down[: len(raw) - GRAM + 1])
    base, windows = 0, []
    for length, first, start, part in segments:
        grams[max(base + len(part) - GRAM + 1, 0) : base + len(part)] = MOST  # these reach into the next
        last = min(start + SEGMENT, length - WIDTH + 1)
        windows.append((base + start - first, base + last - first))
        base += len(part)
    least = _sliding(grams, LEFT + 1, True)
    valid = np.zeros(len(least), bool)
    for a, b in windows:
        valid[a:b] = True
    least[~valid] = 0
    padded = np.concatenate([np.zeros(LEFT, np.uint64), least, np.zeros(len(grams) - len(least), np.uint64)])
    at = np.flatnonzero((_sliding(padded, LEFT + 1, False) == grams) & (grams != MOST))
    starts = np.cumsum([0] + [len(s[3]) for s in segments[:-1]])
    which = np.searchsorted(starts, at, side="right") - 1
    lengths, firsts = (np.array([s[i] for s in segments], np.int64) for i in (0, 1))
    pos = at - starts[which] + firsts[which]
    left, right = np.minimum(pos, LEFT), np.minimum(lengths[which] - pos, WIDTH)
    context = (sums[at + right] - sums[at - left]) * _powers.down[at - left]
    context = mixed(context + left.astype(np.uint64) * np.uint64(0x9E3779B1) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return which, pos, grams[at], context, left, right


def found_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row; each distinct text of this task under a number; its anchors."""
    known: set[bytes] = set()
    tid = TaskContext.get().partitionId() << 36
    segments: list[tuple[int, int, int, bytes]] = []
    owners: list[int] = []
    size = 0
    seen = (-1, np.zeros(0, np.int64))  # the last text and its anchors beyond its segments so far

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seen
        which, pos, h, c, left, right = _anchors(segments)
        owner = np.array(owners, np.int64)[which]
        # neighbouring segments of a text may find the same anchor
        order = np.lexsort((pos, owner))
        again = np.concatenate([[False], (np.diff(owner[order]) == 0) & (np.diff(pos[order]) == 0)])
        once = order[~again]
        once = once[(owner[once] != seen[0]) | ~np.isin(pos[once], seen[1])]
        reached = segments[-1][2] + SEGMENT
        seen = (owners[-1], pos[(owner == owners[-1]) & (pos >= reached)])
        columns = [owner, h.view(np.int64), c.view(np.int64), pos.astype(np.int32), left.astype(np.int16), right.astype(np.int16)]
        columns = [pa.array(x[once]) for x in columns]
        none = pa.nulls(len(columns[0]), pa.int64())
        yield from rows_of(FOUND_ARROW, [none, pa.nulls(len(none), pa.binary()), none, *columns])

    for batch in small(batches):
        raw = texts(batch.column("text"))
        names = [digest(t) for t in raw]
        count = len(raw)
        none = [None] * count
        yield from rows_of(
            FOUND_ARROW, [batch.column("doc_id").cast(pa.int64()), names, [len(t) for t in raw], *[none] * 6]
        )
        new = []
        for name, text in zip(names, raw, strict=True):
            if len(text) < WIDTH or name in known:
                continue
            known.add(name)
            new.append((name, tid))
            for start in range(0, len(text) - WIDTH + 1, SEGMENT):
                first = max(0, start - LEFT)
                part = text[first : start + SEGMENT + LEFT + WIDTH]
                segments.append((len(text), first, start, part))
                owners.append(tid)
                size += len(part)
                if size > SEGMENT:
                    yield from flush()
                    segments, owners, size = [], [], 0
            tid += 1
        if new:
            none = [None] * len(new)
            yield from rows_of(
                FOUND_ARROW, [none, [n for n, _ in new], none, [t for _, t in new], none, none, none, none, none]
            )
    if segments:
        yield from flush()


# ------------------------------------------------------------------- edges

SUFFIXES = "hot boolean, key long, key2 long, tid long, at int, left binary, right binary, reach_left int, reach_right int"
SUFFIXES_ARROW = pa.schema(
    [("hot", pa.bool_()), ("key", pa.int64()), ("key2", pa.int64()), ("tid", pa.int64()), ("at", pa.int32())]
    + [("left", pa.binary()), ("right", pa.binary()), ("reach_left", pa.int32()), ("reach_right", pa.int32())]
)
_WEIGHTS = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
_WEIGHTS2 = mixed(np.arange(1001, WIDTH + 1001, dtype=np.uint64)) | np.uint64(1)


def _hash(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return mixed((_BYTES[rows] * weights[: rows.shape[1]]).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column, without an object for each."""
    n, size = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _class_rows(tid: int, raw: np.ndarray, length: int, pos: np.ndarray) -> Iterator[tuple]:
    """Suffixes of each class around the anchors ``pos``; ``raw`` is the text with margins."""
    around = raw[pos[:, None] + np.arange(LEFT + WIDTH)]  # from LEFT before the anchor on
    for j in range(CLASSES):
        core, at = LEFT - j * (SLACK + 1), pos - j * (SLACK + 1)
        inside = (at >= 0) & (at + CORE <= length)
        rows, at = around[inside], at[inside]
        yield (
            np.zeros(len(at), bool),
            _hash(rows[:, core : core + CORE], _WEIGHTS),
            np.zeros(len(at), np.int64),
            np.full(len(at), tid),
            at.astype(np.int32),
            rows[:, core - SLACK : core][:, ::-1],
            rows[:, core + CORE : core + WIDTH],
            np.minimum(at, SLACK).astype(np.int32),
            np.minimum(length - at - CORE, SLACK).astype(np.int32),
        )


def _window_rows(tid: int, raw: np.ndarray, length: int, pos: np.ndarray) -> Iterator[tuple]:
    """Every window around the anchors ``pos``, by two hashes."""
    start = np.unique((pos[:, None] - np.arange(LEFT + 1)).reshape(-1))
    start = start[(start >= 0) & (start + WIDTH <= length)]
    for a in range(0, len(start), 4000):
        at = start[a : a + 4000]
        rows = raw[at[:, None] + LEFT + np.arange(WIDTH)]
        n, none = len(at), np.zeros((len(at), 0), np.uint8)
        reach = np.zeros(n, np.int32)
        yield np.ones(n, bool), _hash(rows, _WEIGHTS), _hash(rows, _WEIGHTS2), np.full(n, tid), at.astype(np.int32), none, none, reach, reach


def edge_suffixes(batches: Iterable[pa.RecordBatch], at_once: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Suffixes near the listed anchors: one row a class; for hot ones a row a window."""
    held: dict[bool, list[tuple]] = {False: [], True: []}
    counts = {False: 0, True: 0}

    def flush(hot: bool) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held[hot], strict=True)]
        held[hot], counts[hot] = [], 0
        return pa.RecordBatch.from_arrays(
            [_strings(c) if c.ndim == 2 else pa.array(c) for c in columns], schema=SUFFIXES_ARROW
        )

    for batch in small(batches, 64):
        columns = (batch.column(n).to_pylist() for n in ("tid", "text", "places", "hot_places"))
        for tid, text, places, hot_places in zip(*columns, strict=True):
            raw = np.frombuffer(b"\0" * LEFT + text + b"\0" * WIDTH, np.uint8)
            for hot, make, listed in ((False, _class_rows, places), (True, _window_rows, hot_places)):
                for a in range(0, len(listed), 1000):
                    for rows in make(tid, raw, len(text), np.array(listed[a : a + 1000], np.int64)):
                        if len(rows[0]):
                            held[hot].append(rows)
                            counts[hot] += len(rows[0])
                        if counts[hot] >= at_once:
                            yield flush(hot)
    for hot in (False, True):
        if held[hot]:
            yield flush(hot)


# ------------------------------------------------------------------- deep-shallow sorting

CHARACTER = 8  # bytes compared at once
SHALLOW = 2  # characters sorted in passes over all rows; what is still equal is deep


def blind_trie_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of equally long strings, and the common prefix of each with the one before.

    The trie keeps only branching depths and branching bytes. A string is first led down
    blindly to some leaf, compared with that one string, and then put in where they differ.
    """
    root: list = [strings[0], [0]]  # a leaf: its string and who has it; a node: depth, children, a string below
    size = len(strings[0])
    for i in range(1, len(strings)):
        text, node = strings[i], root
        while len(node) == 3:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == text:
            node[1].append(i)
            continue
        depth = next(k for k in range(size) if other[k] != text[k])
        above, byte, node = None, None, root
        while len(node) == 3 and node[0] < depth:
            above, byte = node, text[node[0]]
            node = node[1][byte]
        leaf = [text, [i]]
        if len(node) == 3 and node[0] == depth:
            node[1][text[depth]] = leaf
        else:
            split = [depth, {other[depth]: node, text[depth]: leaf}, text]
            if above is None:
                root = split
            else:
                above[1][byte] = split
    order: list[int] = []
    common: list[int] = []
    pending: list[tuple[list, int]] = [(root, 0)]
    while pending:
        node, before = pending.pop()
        if len(node) == 3:
            children = [node[1][b] for b in sorted(node[1])]
            pending += [(child, node[0]) for child in reversed(children[1:])]
            pending.append((children[0], before))
        else:
            order += node[1]
            common += [before] + [size] * (len(node[1]) - 1)
    return order, common


def deep_shallow_order(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, string), and common bytes with the row before (0 across groups)."""
    n, size = strings.shape
    words = -(-size // CHARACTER)
    padded = np.zeros((n, words * CHARACTER), np.uint8)
    padded[:, :size] = strings
    characters = padded.view(">u8").astype(np.uint64).reshape(n, words)
    order, segment = np.argsort(group, kind="stable"), None
    segment = group[order]
    for k in range(min(SHALLOW, words)):  # all groups a character deeper at once
        inner = np.lexsort((characters[order, k], segment))
        order = order[inner]
        segment = segment[inner]
        character = characters[order, k]
        fresh = np.concatenate([[True], (segment[1:] != segment[:-1]) | (character[1:] != character[:-1])])
        segment = np.cumsum(fresh)
    common = _common_bytes(strings[order[1:]], strings[order[:-1]])
    common = np.concatenate([[0], np.where(group[order[1:]] == group[order[:-1]], common, 0)])
    shallow = SHALLOW * CHARACTER
    if shallow < size:
        bounds = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                rows = order[a:b]
                inner, shared = blind_trie_order([r.tobytes() for r in strings[rows, shallow:]])
                order[a:b] = rows[inner]
                common[a + 1 : b] = shallow + np.array(shared[1:])
    return order, common


def _common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class RangeLeast:
    """Smallest value between two places, from a table of power-of-two spans."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first..last, both included."""
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            values = self.levels[k]
            out[at] = np.minimum(values[first[at]], values[last[at] - (1 << int(k)) + 1])
        return out


def duplicate_starts(
    group: np.ndarray, left: np.ndarray, right: np.ndarray, reach_left: np.ndarray, reach_right: np.ndarray
) -> np.ndarray:
    """Flags [row, t]: the window that begins t bytes before the row's core occurs in another row.

    ``left`` runs away from the core, ``right`` too; rows of one group have equal cores. Windows
    that run beyond the text of either row are no windows.
    """
    n = len(group)
    flags = np.zeros((n, SLACK + 1), bool)
    order, common = deep_shallow_order(group, right)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least = RangeLeast(common)
    rows, inside = order, group[order]  # in order of (what stands left, right rank)
    for t in range(SLACK + 1):
        if t:  # induced: one more byte to the left, stable in the order so far
            far = reach_left[rows] >= t
            rows, inside = rows[far], inside[far]
            if not len(rows):
                break
            step = np.lexsort((left[rows, t - 1], inside))
            rows, inside, byte = rows[step], inside[step], left[rows[step], t - 1]
            fresh = np.concatenate([[True], (inside[1:] != inside[:-1]) | (byte[1:] != byte[:-1])])
            inside = np.cumsum(fresh)
        same = inside[1:] == inside[:-1]
        alike = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        rows, inside = rows[alike], inside[alike]  # what stands alone stays alone
        if not len(rows):
            break
        whole = reach_right[rows] >= SLACK - t  # padding equals real NULs, so it may meet no comparison
        own, of = rows[whole], inside[whole]
        near = np.flatnonzero(of[1:] == of[:-1])
        a, b = own[near], own[near + 1]
        equal = least.between(rank[a] + 1, rank[b]) >= SLACK - t
        flags[a[equal], t] = True
        flags[b[equal], t] = True
    return flags


INTERVALS = "tid long, start long, stop long"
INTERVALS_ARROW = pa.schema([("tid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def sorted_edges(batches: Iterable[pa.RecordBatch], at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Duplicate intervals of suffix rows that arrive in order of key; whole keys at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= at_once:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield from _edge_intervals(table.slice(0, cut))
            rest = table.slice(cut).to_batches()
            held, count = rest, len(keys) - cut
            at_once = max(at_once, 2 * count)
    if count:
        yield from _edge_intervals(pa.Table.from_batches(held))


def _edge_intervals(table: pa.Table) -> Iterator[pa.RecordBatch]:
    # two anchors of a text may name the same suffix
    key, tid, at = (table.column(n).to_numpy() for n in ("key", "tid", "at"))
    order = np.lexsort((at, tid, key))
    again = (np.diff(key[order]) == 0) & (np.diff(tid[order]) == 0) & (np.diff(at[order]) == 0)
    table = table.take(pa.array(order[np.concatenate([[True], ~again])]))
    keys = table.column("key").to_numpy()
    same = keys[1:] == keys[:-1]
    table = table.filter(pa.array(np.concatenate([[False], same]) | np.concatenate([same, [False]])))
    if not table.num_rows:
        return
    left, right = (
        np.frombuffer(b"".join(table.column(n).to_pylist()), np.uint8).reshape(-1, SLACK) for n in ("left", "right")
    )
    reach_left, reach_right = (table.column(n).to_numpy().astype(np.int64) for n in ("reach_left", "reach_right"))
    flags = duplicate_starts(table.column("key").to_numpy(), left, right, reach_left, reach_right)
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    at, tid = table.column("at").to_numpy().astype(np.int64), table.column("tid").to_numpy()
    yield from rows_of(INTERVALS_ARROW, [tid[row], at[row] - (after - 1), at[row] - first + WIDTH])


# ------------------------------------------------------------------- cutting

CUT = "digest binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
CUT_ARROW = pa.schema(
    [("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[fresh], reach[np.concatenate([fresh[1:], [True]])]


def cut_texts(batches: Iterable[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = []
        columns = (batch.column(n).to_pylist() for n in ("digest", "text", "starts", "stops"))
        for name, text, starts, stops in zip(*columns, strict=True):
            starts, stops = merged(np.array(starts), np.array(stops))
            begin = [0, *stops.tolist()]
            kept = b"".join(text[a:b] for a, b in zip(begin, [*starts.tolist(), len(text)], strict=True))
            sha = hashlib.sha256(kept).hexdigest()
            rows.append((name, len(text) - len(kept), len(starts), sha, kept if with_text else None))
        if rows:
            yield from rows_of(CUT_ARROW, list(zip(*rows, strict=True)), 2000)


def _texts_of(batches: Iterable[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Digest and text of the texts that may be wanted, once a task."""
    known: set[bytes] = set()
    schema = pa.schema([("digest", pa.binary()), ("text", pa.binary())])
    for batch in small(batches):
        raw = texts(batch.column("text"))
        names = [digest(t) for t in raw]
        rows = []
        for name, text, may in zip(names, raw, may_hold(wanted, names), strict=True):
            if may and name not in known:
                known.add(name)
                rows.append((name, text))
        if rows:
            yield from rows_of(schema, list(zip(*rows, strict=True)), 2000)


def remove_repeats(docs: DataFrame, many: int = 200_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row.

    From each text of ``docs(doc_id, text)`` the bytes go that are covered by a 200-byte
    string which also begins anywhere else, in any row. Null counts as empty; texts under 200
    bytes lose nothing; repeated rows lose all if they have 200 bytes. Rows without doc_id
    take part. Other columns, whatever their names, are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = few_rows_at_once(docs).select("doc_id", "text")
    found = stage(source.mapInArrow(found_rows, FOUND), "repeats-anchors")
    rows = found.where(F.col("n").isNotNull()).select("doc_id", "digest", "n")
    tids = found.where(F.col("digest").isNotNull() & F.col("tid").isNotNull()).select("tid", "digest")
    anchors = found.where(F.col("h").isNotNull()).select("h", "c", "tid", "pos", "left", "right")

    # a gram that stands alone is in no duplicate; most do
    by_gram = anchors.groupBy("h").agg(F.count("*").alias("all"), (F.min("c") != F.max("c")).alias("varied"))
    repeated = stage(anchors.join(by_gram.where("all > 1").select("h", "varied"), "h"), "repeats-grams")
    # contexts that occur twice are duplicate throughout
    contexts = repeated.groupBy("h", "c").agg(
        F.count("*").alias("times"), F.first("tid").alias("tid"), F.first("pos").alias("pos"), F.first("varied").alias("varied")
    )
    whole = (
        repeated.join(contexts.where("times > 1").select("h", "c"), ["h", "c"])
        .select(
            "tid",
            (F.col("pos") - F.col("left")).cast("long").alias("start"),
            (F.col("pos") + F.col("right")).cast("long").alias("stop"),
        )
        .where(F.col("stop") - F.col("start") >= WIDTH)
    )

    # grams with several contexts: one anchor of each context stands at an edge
    edges = contexts.where("varied").select("h", "tid", "pos")
    crowded = edges.groupBy("h").agg(F.count("*").alias("contexts")).where(F.col("contexts") > many)
    edges = edges.join(crowded, "h", "left").select("tid", "pos", F.col("contexts").isNotNull().alias("hot"))
    places = stage(
        edges.groupBy("tid")
        .agg(
            F.collect_list(F.when(~F.col("hot"), F.col("pos"))).alias("places"),
            F.collect_list(F.when(F.col("hot"), F.col("pos"))).alias("hot_places"),
        )
        .join(tids, "tid"),
        "repeats-edges",
    )
    near = (
        source.mapInArrow(partial(_texts_of, wanted=sieve(places.select("digest"))), "digest binary, text binary")
        .dropDuplicates(["digest"])
        .join(places, "digest")
        .select("tid", "text", "places", "hot_places")
        .mapInArrow(edge_suffixes, SUFFIXES)
    )
    suffixes = stage(near, "repeats-suffixes")
    edge = (
        suffixes.where(~F.col("hot"))
        .select("key", "tid", "at", "left", "right", "reach_left", "reach_right")
        .repartition(parts, "key")
        .sortWithinPartitions("key")
        .mapInArrow(sorted_edges, INTERVALS)
    )
    windows = suffixes.where("hot").select("key", "key2", "tid", "at").distinct()
    twice = windows.groupBy("key", "key2").agg(F.count("*").alias("times")).where("times > 1").select("key", "key2")
    hot = windows.join(twice, ["key", "key2"], "left_semi").select(
        "tid", F.col("at").cast("long").alias("start"), (F.col("at") + WIDTH).cast("long").alias("stop")
    )

    spans = (
        whole.unionByName(edge)
        .unionByName(hot)
        .join(tids, "tid")
        .groupBy("digest")
        .agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    )
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    single = stage(
        spans.join(copies.where("copies = 1"), "digest").select("digest", "starts", "stops"), "repeats-spans"
    )
    cut = (
        source.mapInArrow(partial(_texts_of, wanted=sieve(single.select("digest"))), "digest binary, text binary")
        .join(single, "digest")
        .mapInArrow(partial(cut_texts, with_text=with_text), CUT)
    )
    return _results(rows, copies, cut, source, with_text)


def _results(rows: DataFrame, copies: DataFrame, cut: DataFrame, source: DataFrame, with_text: bool) -> DataFrame:
    gone = (F.col("copies") > 1) & (F.col("n") >= WIDTH)  # copies lose all
    untouched = F.lower(F.hex("digest"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    each = copies.join(cut, "digest", "left").select(
        "digest",
        F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("kept_sha256", untouched)).alias("kept_sha256"),
        *(["kept", gone.alias("gone")] if with_text else []),
    )
    out = rows.join(each, "digest")
    columns = ["doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"]
    if not with_text:
        return out.select(*columns)
    original = source.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).select(
        F.unhex(F.sha2("_text", 256)).alias("_digest"), F.encode("_text", "UTF-8").alias("_bytes")
    ).dropDuplicates(["_digest"])
    kept = F.when(F.col("gone"), F.lit(b"")).otherwise(F.coalesce("kept", "_bytes"))
    return out.join(original, out["digest"] == original["_digest"]).select(*columns, kept.alias("kept"))
