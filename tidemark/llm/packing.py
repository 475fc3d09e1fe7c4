"""Packing token sequences into bins by a configuration linear program.

The program lives on the histogram of lengths, which has at most ``capacity`` entries however
many documents there are: a variable is a configuration (how many pieces of each length share
a bin), a constraint asks that every length is covered. Multiplicative weights solve it: each
length carries a weight that falls as it gets covered, and a knapsack dynamic program prices
the best configuration for the weights. The fractional solution is rounded to whole bins, and
what rounding leaves over is placed by best fit, also on counts.

The solution is a list of bin patterns with multiplicities. Spark numbers the pieces of each
length (by hash buckets, so that a length shared by a third of all rows is many tasks) and
looks the number up in the runs of the patterns: no piece passes through the driver.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import few_rows_at_once, rows_of, small, texts
from tidemark.llm.token_counts import PUNCTUATION, byte_letters, tokenizer
from tidemark.session import stage

Pattern = tuple[tuple[int, ...], int]  # lengths in one bin, number of such bins

# ---------------------------------------------------------------- configuration program


def best_configuration(weights: np.ndarray, sizes: np.ndarray, capacity: int) -> list[int]:
    """Knapsack pricing: the indexes, with repeats, of a heaviest set of sizes that fits."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int64)
    ends = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if end := ends[room]:
            value = best[room - sizes[:end]] + weights[:end]
            if value[at := int(value.argmax())] > best[room]:
                best[room], took[room] = value[at], at
    chosen, room = [], capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            chosen.append(int(took[room]))
            room -= int(sizes[took[room]])
    return chosen


def fractional_solution(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int, step: float = 0.5, rate: float = 4.0
) -> dict[tuple[tuple[int, int], ...], float]:
    """Multiplicative weights for the covering program; amounts by configuration.

    Each step buys so much of the best-priced configuration that its scarcest size is
    covered by a further share ``step``; covered sizes lose weight exponentially.
    """
    covered = np.zeros(len(sizes))
    bought: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(steps):
        share = covered / demand
        open_ = share < 1
        if not open_.any():
            break
        weights = np.where(open_, np.exp(-rate * share), 0.0) * sizes
        chosen = best_configuration(weights, sizes, capacity)
        index, times = np.unique(chosen, return_counts=True)
        amount = step * float((demand[index] / times).min())
        configuration = tuple(zip(index.tolist(), times.tolist(), strict=True))
        bought[configuration] = bought.get(configuration, 0.0) + amount
        covered[index] += amount * times
    return bought


class Stock:
    """The pieces left, as counts by exact length in classes of similar length."""

    def __init__(self, histogram: dict[int, int], grid: int) -> None:
        self.classes: dict[int, list[list[int]]] = {}
        for length in sorted(histogram):
            self.classes.setdefault(-(-length // grid), []).append([length, histogram[length]])

    def left(self, size: int) -> int:
        return sum(n for _, n in self.classes.get(size, ()))

    def take(self, size: int, n: int) -> list[tuple[int, int]]:
        """Runs (length, count) of n pieces of a class, the longest first."""
        held, runs = self.classes[size], []
        while n:
            length, there = held[-1]
            got = min(n, there)
            runs.append((length, got))
            n -= got
            if got == there:
                held.pop()
            else:
                held[-1][1] -= got
        return runs

    def rest(self) -> list[tuple[int, int]]:
        return sorted(((length, n) for held in self.classes.values() for length, n in held), reverse=True)


def _aligned(slots: list[list[tuple[int, int]]]) -> Iterator[Pattern]:
    """Bins from one run list per slot: cut where any slot goes on to another length."""
    at = [0] * len(slots)
    left = [runs[0][1] for runs in slots]
    while True:
        n = min(left)
        yield tuple(runs[i][0] for runs, i in zip(slots, at, strict=True)), n
        for k, runs in enumerate(slots):
            left[k] -= n
            if not left[k]:
                at[k] += 1
                if at[k] == len(runs):
                    return
                left[k] = runs[at[k]][1]


def rounded(bought: dict, sizes: np.ndarray, stock: Stock) -> list[Pattern]:
    """Whole bins from fractional amounts, the largest first, as far as the pieces last."""
    bins: list[Pattern] = []
    for configuration, amount in sorted(bought.items(), key=lambda c: (-c[1], c[0])):
        size_times = [(int(sizes[i]), t) for i, t in configuration]
        n = min(max(1, round(amount)), *(stock.left(s) // t for s, t in size_times))
        if n:
            slots = [stock.take(s, n) for s, t in size_times for _ in range(t)]
            bins.extend(_aligned(slots))
    return bins


def best_fit(bins: list[Pattern], rest: list[tuple[int, int]], capacity: int) -> list[Pattern]:
    """The rest, longest first, each into the fullest bin with room; bins are counted groups."""
    groups: dict[int, list[Pattern]] = {}
    for lengths, n in bins:
        groups.setdefault(capacity - sum(lengths), []).append((lengths, n))
    rooms = sorted(groups)

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((lengths, n))

    for length, n in rest:
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                lengths, there = (), n  # new bins
            else:
                room = rooms[at]
                lengths, there = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            fit = min((capacity - sum(lengths)) // length, n)
            used = min(there, n // fit)
            if lengths and used < there:
                put(lengths, there - used)
            put(lengths + (length,) * fit, used)
            n -= used * fit
    return [group for room in sorted(groups) for group in groups[room]]


def pack_histogram(
    histogram: dict[int, int], capacity: int = 4096, grid: int = 8, small: int = 64, steps: int = 600, rounds: int = 3
) -> list[Pattern]:
    """Bin patterns with multiplicities that hold exactly the pieces of the histogram.

    Lengths are priced in steps of ``grid`` (rounded up, so every priced configuration
    fits); the room this leaves, and pieces of at most ``small``, go to best fit.
    """
    stock = Stock({l: n for l, n in histogram.items() if l > small}, grid)
    bins: list[Pattern] = []
    for _ in range(rounds):
        sizes = np.array(sorted(s for s in stock.classes if stock.left(s)), np.int64)
        if not len(sizes):
            break
        demand = np.array([stock.left(s) for s in sizes.tolist()], float)
        bins += rounded(fractional_solution(sizes, demand, capacity // grid, steps), sizes, stock)
    rest = stock.rest() + sorted(((l, n) for l, n in histogram.items() if l <= small), reverse=True)
    return best_fit(bins, rest, capacity)


def runs_of(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces a bin, first sequence, first offset) in rank order."""
    runs: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            times = lengths.count(length)
            first = ranks.get(length, 0)
            runs.setdefault(length, []).append((first, times, sequence, offset))
            ranks[length] = first + n * times
            offset += times * length
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in runs.items()}


# ------------------------------------------------------------------------- the pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
IDS = pa.field("ids", pa.list_(pa.int32()))
_ENDS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
_PUNCTUATION = PUNCTUATION.encode()
_PLAIN = re.compile("[a-zß-öø-ÿ]+")  # lower-case letters that no normaliser changes


class WordIds(dict):
    """Little-endian 32-bit ids of white-space separated words, remembered while they keep coming.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words. It folds case, and a word and the punctuation after it are encoded apart, so
    both are remembered once. Words of plain lower-case letters go straight to the library's
    BPE model, as nothing else of the tokenizer changes them; all others through all of it.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = tokenizer(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(_PUNCTUATION)
            if len(stem) < len(word) and stem and stem[-1] in _ENDS:
                ids = self[stem] + self[word[len(stem) :]]
            else:
                text = word.decode()
                if _PLAIN.fullmatch(text):
                    found = [t.id for t in self.model.tokenize(text.translate(self.letters))]
                else:
                    found = self.tokenizer.encode(text, add_special_tokens=False).ids
                ids = np.array(found, "<u4").tobytes()
        self[word] = ids
        return ids

    def forget(self) -> None:
        """What did not come up since the last time goes; the rest stays within reach."""
        self.old = dict(self)
        self.clear()


_word_ids: dict[str, WordIds] = {}


def encoded(texts: Iterable[bytes], path: str, most: int) -> Iterator[bytes]:
    """Ids of each text; the memory of words is the worker's and lasts over its tasks."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    words = _word_ids[path]
    specials = [t.content.encode() for t in words.tokenizer.get_added_tokens_decoder().values()]
    for text in texts:
        if any(s in text for s in specials):  # these are cut out before anything else
            yield np.array(words.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        else:
            # folding case must not make a special string
            split = text.split() if b"<|" in text else text.lower().split()
            yield b"".join(map(words.__getitem__, split))
        if len(words) > most:
            words.forget()


def pieces(
    batches: Iterable[pa.RecordBatch], path: str, capacity: int, end_id: int, most_words: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    schema = PIECES_ARROW.append(IDS) if with_ids else PIECES_ARROW
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
    for batch in small(batches):
        ids, column = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
        rows = []
        for doc_id, raw in zip(ids, encoded(column, path, most_words), strict=True):
            raw += end
            for piece, a in enumerate(range(0, len(raw), width)):
                part = raw[a : a + width]
                row = (doc_id, piece, a // 4, len(part) // 4, zlib.crc32(part))
                rows.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
            if len(rows) >= 5000:
                yield from rows_of(schema, list(zip(*rows, strict=True)))
                rows = []
        if rows:
            yield from rows_of(schema, list(zip(*rows, strict=True)))


def _placed(runs: dict[int, np.ndarray]) -> Callable:
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                run = runs[int(one)]
                held = run[np.searchsorted(run[:, 0], rank[at], side="right") - 1]
                bin_, place_ = np.divmod(rank[at] - held[:, 0], held[:, 1])
                sequence[at] = held[:, 2] + bin_
                offset[at] = held[:, 3] + place_ * one
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(sequence))
            yield out.append_column("offset", pa.array(offset))

    return place


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = 4096,
    end_id: int = 1,
    most_words: int = 150_000,
    with_ids: bool = False,
) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` as pieces placed in sequences of ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked
    for. A document is its text's ids (null counts as empty) and ``end_id``; only a longer one
    is cut, into pieces of ``capacity``. Repeated rows are packed each; rows without doc_id
    too. Other columns, whatever their names, are ignored; an empty table gives an empty
    result. ``most_words`` bounds what a worker remembers.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    schema = PIECES + (", ids array<int>" if with_ids else "")
    cut = few_rows_at_once(docs).select("doc_id", "text").mapInArrow(
        partial(pieces, path=path, capacity=capacity, end_id=end_id, most_words=most_words, with_ids=with_ids), schema
    )
    held = stage(cut, "packing-pieces")
    histogram = held.groupBy("length").agg(F.count("*").alias("lengths"))
    # at most `capacity` rows, however many pieces there are
    patterns = pack_histogram({r["length"]: r["lengths"] for r in histogram.collect()}, capacity)
    ranked = _ranked(held, histogram)
    columns = [*held.columns]
    out = f"{schema}, sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInArrow(_placed(runs_of(patterns)), out)


def _ranked(held: DataFrame, histogram: DataFrame) -> DataFrame:
    """Pieces numbered from 0 within their length.

    A length with n pieces is cut into about sqrt(n) hash buckets: rows are numbered within a
    bucket, and the buckets' counts, summed up in order, give where each bucket starts.
    """
    buckets = F.ceil(F.sqrt("lengths"))
    keyed = held.join(F.broadcast(histogram), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), buckets)
    )
    keys = ["length", "bucket"]
    starts = (
        keyed.groupBy(*keys)
        .agg(F.count("*").alias("rows"))
        .withColumn("first", F.sum("rows").over(Window.partitionBy("length").orderBy("bucket")) - F.col("rows"))
        .drop("rows")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "piece", "ids_crc32"))
    return keyed.withColumn("inside", inside).join(starts, keys).withColumn("rank", F.col("first") + F.col("inside") - 1)
