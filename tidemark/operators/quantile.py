"""Exact quantiles and distribution summaries per group, without collecting a group.

Equal values are counted first (map-side), the distinct values are spread over
value buckets, and only the values that cover a wanted rank survive to the last
aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import prefix_scan, value_buckets


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join where null group keys match each other."""
    if not keys:
        # the right side is a total: exactly one row, so it is safe to send to every task
        one = F.broadcast(right.withColumn("__one", F.lit(0)))
        return left.withColumn("__one", F.lit(0)).join(one, "__one", how).drop("__one")
    names = {k: f"__j{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    cond = reduce(and_, [left[k].eqNullSafe(other[a]) for k, a in names.items()])
    return left.join(other, cond, how).drop(*names.values())


def group_quantiles(
    df: DataFrame,
    *,
    keys: Sequence[str],
    value: str | Column,
    quantiles: Mapping[str, float],
    method: str = "linear",
    weight: str | None = None,
) -> DataFrame:
    """One row per group with the named quantiles of the non-null values.

    ``linear`` interpolates between neighbours; ``nearest`` takes the value at rank
    ``floor((n - 1) q + 0.5)``.
    """
    if method not in ("linear", "nearest"):
        raise ValueError("method must be 'linear' or 'nearest'")
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if weight else F.lit(1)
    counted = (
        df.select(*keys, v.cast("double").alias("__v"), w.cast("bigint").alias("__w"))
        .where(F.col("__v").isNotNull())
        .groupBy(*keys, "__v")
        .agg(F.sum("__w").alias("__c"))
    )
    spread = value_buckets(counted, keys=keys, value="__v")
    ranked = prefix_scan(
        spread, keys=keys, bucket=F.col("__vb").cast("bigint"), order=["__v"], sums={"__upto": F.col("__c")}
    )
    total = counted.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    full = null_safe_join(ranked, total, keys)
    first, last = F.col("__upto") - F.col("__c"), F.col("__upto")

    def covers(rank: Column) -> Column:
        return (rank >= first) & (rank < last)

    picks: dict[str, Column] = {}
    needed: list[Column] = []
    for name, q in quantiles.items():
        pos = (F.col("__n") - 1) * F.lit(float(q))
        ranks = (
            {"lo": F.floor(pos), "hi": F.ceil(pos)} if method == "linear" else {"lo": F.floor(pos + 0.5)}
        )
        for side, rank in ranks.items():
            cond = covers(rank)
            needed.append(cond)
            picks[f"__{name}_{side}"] = F.max(F.when(cond, F.col("__v")))
    agg = (
        full.where(reduce(or_, needed))
        .groupBy(*keys)
        .agg(F.max("__n").alias("__n"), *[expr.alias(name) for name, expr in picks.items()])
    )
    out = []
    for name, q in quantiles.items():
        lo = F.col(f"__{name}_lo")
        if method == "nearest":
            out.append(lo.alias(name))
        else:
            pos = (F.col("__n") - 1) * F.lit(float(q))
            out.append((lo + (F.col(f"__{name}_hi") - lo) * (pos - F.floor(pos))).alias(name))
    return agg.select(*keys, *out)


# The quantiles of a distribution row.
DISTRIBUTION_QUANTILES = {
    "p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99,
}


def count_distinct_nulls(c: str) -> Column:
    """Distinct values where null counts as one value."""
    return F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))


def unpivot_fields(df: DataFrame, *, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Long form (keys, field, value) of several numeric columns."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]
    )
    return df.select(*keys, F.explode(pairs).alias("__p")).select(*keys, "__p.field", "__p.value")


def distribution(
    df: DataFrame,
    *,
    fields: Sequence[str],
    keys: Sequence[str] = (),
    quantiles: Mapping[str, float] = DISTRIBUTION_QUANTILES,
    method: str = "nearest",
) -> DataFrame:
    """Count, nulls, distinct, min, max, mean, std and quantiles per group and field."""
    long = unpivot_fields(df, keys=keys, fields=fields)
    by = [*keys, "field"]
    # distinct values first, so the distinct count and the moments share one shuffle
    counted = long.groupBy(*by, "value").agg(F.count("*").alias("__c"))
    v, c = F.col("value"), F.col("__c")
    n = F.sum(F.when(v.isNotNull(), c).otherwise(0))
    base = counted.groupBy(*by).agg(
        F.sum(c).alias("count"),
        F.sum(F.when(v.isNull(), c).otherwise(0)).alias("null_count"),
        F.count("*").alias("unique_count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.sum(v * c) / F.when(n > 0, n)).alias("mean"),
    )
    spread = long.groupBy(*by).agg(F.stddev_samp("value").alias("std"))
    qs = group_quantiles(counted, keys=by, value="value", quantiles=quantiles, method=method, weight="__c")
    return null_safe_join(null_safe_join(base, spread, by), qs, by)
