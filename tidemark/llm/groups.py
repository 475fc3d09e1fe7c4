"""Streaming over sorted batches, and connected components in a task and across tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches in which these stand together."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        names = list(zip(*columns, strict=True))
        start = 0
        for at in range(len(names)):
            if names[at] != last:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], at, names[at]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected to by the edges a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (shorter := label[label]).tobytes() != label.tobytes():
            label = shorter
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, label (the smallest node of its component) of the graph ``edges(a, b)``.

    Rounds of large star and small star: every node points its neighbours to the smallest
    node it knows, until all point to the smallest of the component. A table is written in
    each round; nothing is gathered in one place.
    """
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        pairs = F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        small = joined.select(F.inline(pairs)).where("a <> b").distinct()
        current, before = stage(small, name), state
        state = _state(current)
        if state == before:
            break
    labelled = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labelled.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


# ------------------------------------------------------------------- arrays of a fixed size

SLICES = 16
SLICE = "slice int, part binary"
SLICE_ARROW = pa.schema([("slice", pa.int32()), ("part", pa.binary())])


def sliced(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An array as rows that ``gathered`` puts together with those of other tasks."""
    parts = [zlib.compress(p.tobytes(), 1) for p in np.split(values, SLICES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], schema=SLICE_ARROW)


def _together(batches: Iterable[pa.RecordBatch], dtype: str, join: Callable) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, value in zip(batch.column("slice").to_pylist(), batch.column("part").to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(value), dtype)
            total[k] = join(total[k], part) if k in total else part
    for k, part in total.items():
        value = zlib.compress(part.tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([value], pa.binary())], schema=SLICE_ARROW)


def gathered(parts: DataFrame, dtype: str, join: Callable, length: int) -> np.ndarray:
    """One array from the slices of all tasks, joined element by element; its size is fixed."""
    step = partial(_together, dtype=dtype, join=join)
    rows = parts.mapInArrow(step, SLICE).repartition(SLICES, "slice").mapInArrow(step, SLICE).collect()
    out = np.zeros((SLICES, length // SLICES), dtype)
    for row in rows:
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["part"]), dtype)
    return out.reshape(-1)


# ------------------------------------------------------------------- a sieve before joins

SIEVE_BITS = 24  # places of the sieve: 2 MB, whatever the input


def _places(digests: list[bytes]) -> np.ndarray:
    halves = np.frombuffer(b"".join(d[:16] for d in digests), "<u8").reshape(-1, 2)
    return (halves >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(1 << SIEVE_BITS, np.uint8)
    for batch in batches:
        if digests := batch.column(0).to_pylist():
            flags[_places(digests).reshape(-1)] = 1
    yield from sliced(np.packbits(flags))


def sieve(digests: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of digests.

    It only spares rows the way through a join that would drop them: a digest that passes
    may still be absent, and the more digests there are, the more pass.
    """
    return gathered(digests.mapInArrow(_marked, SLICE), "u1", np.bitwise_or, (1 << SIEVE_BITS) // 8)


def may_hold(filter_: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Which of the digests may have been put into the sieve."""
    if not digests:
        return np.zeros(0, bool)
    places = _places(digests)
    return ((filter_[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)
