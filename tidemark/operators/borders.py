"""Buckets bounded by rows: borders of a key's order, from a sample, splitting inside one instant.

A scan over (key, bucket) holds one bucket in a task, so a bucket should hold about as many
rows everywhere, however dense a key is and even if all its rows share one instant. Every
``most_rows / 8``-th row of the order, chosen by hash, is a sample, and every eighth sample of a
key a border. What is collected is some 8 rows in ``most_rows``, spread over the keys; keys
with fewer rows have no border and stay whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage

MOST_ROWS = 1_000_000
OVER = 8  # samples a bucket: its size then varies by about a third
STEPS = [1 << i for i in range(20, -1, -1)]  # of the binary search: up to two million buckets a key


def row_buckets(
    frames: Sequence[DataFrame], *, keys: Sequence[str], order: str, most_rows: int = MOST_ROWS, name: str = "__rb",
    split: str | None = None,
) -> list[DataFrame]:
    """``frames`` with ``name``, a bucket number that does not decrease along ``order`` within a key.

    All frames have the ``keys`` and a struct column ``order`` of one type; null keys and
    null fields are values like others (null first). Buckets hold about ``most_rows`` rows of
    all frames together; only rows equal in the whole struct cannot be parted. The borders
    are written and read back, so the optimizer knows their size when it chooses how to join.
    ``split`` names a column that tells whether the row's key has more than one bucket.
    """
    return dealt(frames, border_table(frames, keys=keys, order=order, most_rows=most_rows), keys=keys, order=order, name=name, split=split)


def border_table(frames: Sequence[DataFrame], *, keys: Sequence[str], order: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """The written borders of :func:`row_buckets`: one row for each key that has any."""
    groups = [f"__g{i}" for i in range(len(keys))]
    rate = max(1, most_rows // OVER)
    samples = []
    for df in frames:
        chosen = F.pmod(F.xxhash64(*keys, order), F.lit(rate)) == 0
        samples.append(df.where(chosen).select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.col(order).alias("__at")))
    sample = reduce(DataFrame.unionByName, samples)
    every = lambda _, i: i % OVER == OVER - 1
    cuts = sample.groupBy(*groups).agg(F.array_sort(F.collect_set("__at")).alias("__all"))
    cuts = cuts.select(*groups, F.filter("__all", every).alias("__cuts")).where(F.size("__cuts") > 0)
    if not groups:
        cuts = cuts.withColumn("__one", F.lit(0))
    return stage(cuts, "borders")


def dealt(
    frames: Sequence[DataFrame], cuts: DataFrame, *, keys: Sequence[str], order: str, name: str = "__rb", split: str | None = None
) -> list[DataFrame]:
    """``frames`` with the bucket that the written borders ``cuts`` give each row."""
    groups = [f"__g{i}" for i in range(len(keys))]
    out = []
    for df in frames:
        if groups:
            on = reduce(Column.__and__, [df[k].eqNullSafe(cuts[g]) for k, g in zip(keys, groups)])
            joined = df.join(cuts, on, "left").drop(*groups)
        else:
            joined = df.withColumn("__one", F.lit(0)).join(cuts, "__one", "left").drop("__one")
        if split:
            joined = joined.withColumn(split, F.col("__cuts").isNotNull())
        out.append(joined.withColumn(name, _position(order)).drop("__cuts"))
    return out


def _position(order: str) -> Column:
    """How many borders are not after the row, by binary search."""
    steps = F.array(*[F.lit(s) for s in STEPS])

    def step(at: Column, size: Column) -> Column:
        return F.when(F.get("__cuts", at + size - 1) <= F.col(order), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step).cast("bigint")


def salt_of(df: DataFrame) -> Column:
    """A hash of a row's columns, to part rows whose order is equal."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("bigint")
