"""Ordered scans that stay parallel inside one key.

A window over a whole key is one task per key, which fails when one key holds a
third of the table. Every scan here works on (key, bucket) instead, where the
bucket is a monotone function of the order:

1. each (key, bucket) is reduced to one row (combined map-side),
2. a window over that small table gives what earlier buckets carry in,
3. the carry enters its bucket as one extra row in front, so the wide rows are
   shuffled once, by (key, bucket), and no join is needed.

Step 2 sees one row per bucket of a key: it grows with the time span (or the
chosen number of value buckets), never with the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.borders import MOST_ROWS, row_buckets

_AGG = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
}


def micros(col: str | Column) -> Column:
    """Epoch microseconds of a timestamp (with or without zone)."""
    column = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(column.cast("timestamp"))


def bucket_start(order: Column, width: int) -> Column:
    """Start of the ``width`` wide bucket of an integer order value (also below zero)."""
    return order - F.pmod(order, F.lit(width).cast("bigint"))


def time_bucket(ts: str | Column, seconds: int) -> Column:
    return bucket_start(micros(ts), seconds * 1_000_000)


def fitted_seconds(
    df: DataFrame, *, keys: Sequence[str], ts: str, most_rows: int, seconds: int = 86_400, least: int = 1, rounds: int = 6
) -> int:
    """A bucket width at which no key has more than ``most_rows`` rows in a bucket.

    For the ``bucket_seconds`` of scans and as-of joins over keys that are dense in time. Each
    round counts rows per (key, bucket), adds up before it shuffles, and narrows the width by
    what the fullest bucket has too many; it stops at ``least`` seconds.
    """
    width = seconds
    for _ in range(rounds):
        counts = df.groupBy(*keys, time_bucket(ts, width).alias("__b")).agg(F.count("*").alias("__n"))
        fullest = counts.agg(F.max("__n")).first()[0] or 0
        if fullest <= most_rows or width <= least:
            break
        width = max(least, min(width - 1, width * most_rows // fullest))
    return width


def _partition(keys: Sequence[str]) -> list:
    return list(keys) if keys else [F.lit(0)]


def prefix_scan(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column | None = None,
    most_rows: int = MOST_ROWS,
    sums: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running aggregates (rows from the first up to this one) to ``df``.

    Buckets hold about ``most_rows`` rows; a ``bucket`` of the caller's must not decrease
    along ``order`` within a key. ``lasts`` is the last non-null value, i.e. a forward fill.
    ``order`` must be a total order.
    """
    specs: list[tuple[str, str, Column]] = []
    for kind, group in (("sum", sums), ("max", maxs), ("min", mins), ("last", lasts)):
        specs += [(name, kind, expr) for name, expr in (group or {}).items()]
    orders = [F.col(o) if isinstance(o, str) else o for o in order]
    ocols = [f"__o{i}" for i in range(len(orders))]

    rows = df.select(
        "*",
        *([] if bucket is None else [bucket.alias("__bucket")]),
        *[expr.alias(f"__in_{name}") for name, _, expr in specs],
        *[expr.alias(o) for expr, o in zip(orders, ocols)],
    )
    if bucket is None:
        ordered = rows.withColumn("__order", F.struct(*ocols))
        rows = row_buckets([ordered], keys=keys, order="__order", most_rows=most_rows, name="__bucket")[0].drop("__order")
    by = [*keys, "__bucket"]
    reduced = rows.groupBy(*by).agg(
        *[
            F.max_by(
                f"__in_{name}",
                F.when(F.col(f"__in_{name}").isNotNull(), F.struct(*ocols)),
            ).alias(f"__in_{name}")
            if kind == "last"
            else _AGG[kind](f"__in_{name}").alias(f"__in_{name}")
            for name, kind, _ in specs
        ]
    )
    before = (
        Window.partitionBy(*_partition(keys))
        .orderBy("__bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = reduced.select(
        *by,
        *[
            (
                F.last(f"__in_{name}", ignorenulls=True)
                if kind == "last"
                else _AGG[kind](f"__in_{name}")
            )
            .over(before)
            .alias(f"__in_{name}")
            for name, kind, _ in specs
        ],
    )
    has_carry = reduce(or_, [F.col(f"__in_{name}").isNotNull() for name, _, _ in specs])
    carried = carried.where(has_carry).withColumn("__side", F.lit(0))

    upto = (
        Window.partitionBy(*by)
        .orderBy("__side", *ocols)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    both = rows.withColumn("__side", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    scanned = both.select(
        *df.columns,
        "__side",
        *[
            (
                F.last(f"__in_{name}", ignorenulls=True)
                if kind == "last"
                else _AGG[kind](f"__in_{name}")
            )
            .over(upto)
            .alias(name)
            for name, kind, _ in specs
        ],
    )
    return scanned.where("__side = 1").drop("__side")


def forward_fill(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str | Column] = (),
    fills: Mapping[str, Column],
    bucket_seconds: int | None = None,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Last non-null value of each expression up to the row, per key in time order."""
    return prefix_scan(
        df,
        keys=keys,
        bucket=None if bucket_seconds is None else time_bucket(ts, bucket_seconds),
        most_rows=most_rows,
        order=[micros(ts), *tie],
        lasts=fills,
    )


def row_index(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column | None = None,
    most_rows: int = MOST_ROWS,
    name: str = "row_idx",
) -> DataFrame:
    """Zero-based position of the row in its key's order."""
    out = prefix_scan(
        df, keys=keys, bucket=bucket, most_rows=most_rows, order=order, sums={name: F.lit(1).cast("bigint")}
    )
    return out.withColumn(name, F.col(name) - 1)


def value_buckets(
    df: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    tie: str | None = None,
    n: int = 64,
) -> DataFrame:
    """Add ``__vb`` (and ``__tb``): buckets monotone in (value, tie) of about equal size.

    Cut points are approximate quantiles per key (mergeable sketches). They only
    steer the balance: results built on the buckets are exact. A value that spans
    several cuts gets a bucket of its own, split further along ``tie``.
    """
    fractions = [i / n for i in range(1, n)]
    aggs = [F.percentile_approx(value, fractions, 10 * n).alias("__cuts")]
    if tie:
        aggs.append(F.percentile_approx(tie, fractions, 10 * n).alias("__tie_cuts"))
    if keys:
        named = [F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]
        cuts = df.groupBy(*named).agg(*aggs)
        cond = None
        for i, k in enumerate(keys):
            c = df[k].eqNullSafe(cuts[f"__g{i}"])
            cond = c if cond is None else cond & c
        joined = df.join(cuts, cond, "left").drop(*[f"__g{i}" for i in range(len(keys))])
    else:
        # one row, joined on a constant key
        cuts = df.groupBy(F.lit(0).alias("__one")).agg(*aggs)
        joined = df.withColumn("__one", F.lit(0)).join(F.broadcast(cuts), "__one", "left").drop("__one")
    below = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    heavy = F.size(F.filter("__cuts", lambda c: c == F.col(value))) >= 2
    out = joined.withColumn("__heavy", heavy).withColumn(
        "__vb", below * 2 + F.col("__heavy").cast("int")
    )
    if tie:
        out = out.withColumn(
            "__tb",
            F.when(F.col("__heavy"), F.size(F.filter("__tie_cuts", lambda c: c < F.col(tie)))).otherwise(0),
        ).drop("__tie_cuts")
    return out.drop("__cuts", "__heavy")


def value_index(
    df: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    tie: str,
    name: str = "row_idx",
    n: int = 64,
) -> DataFrame:
    """Zero-based position of the row in its key, ordered by (value, tie)."""
    spread = value_buckets(df, keys=keys, value=value, tie=tie, n=n)
    # (__vb, __tb) is one monotone integer
    code = F.col("__vb").cast("bigint") * (n + 1) + F.col("__tb")
    return row_index(spread, keys=keys, bucket=code, order=[value, tie], name=name).drop("__vb", "__tb")
