"""First, last, top-k and sampled rows, reduced before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group by a total order: a combined aggregate, not a window."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return picked.select("__row.*")


def last_per_group(df: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return picked.select("__row.*")


def top_per_group(
    df: DataFrame,
    *,
    keys: Sequence[str],
    score: str,
    tie: Sequence[str],
    k: int,
    descending: bool = True,
    salts: int = 32,
) -> DataFrame:
    """The k best rows of each group: best k of each salt first, then of the survivors."""

    def order() -> list:
        main = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
        return [main, *[F.col(t).asc() for t in tie]]

    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*tie), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order())
    few = salted.withColumn("__rn", F.row_number().over(w1)).where(F.col("__rn") <= k)
    w2 = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(*order())
    return (
        few.drop("__rn", "__salt").withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
    )


def top_rows(df: DataFrame, *, score: str, tie: Sequence[str], k: int) -> DataFrame:
    """The k best rows of a table, nulls last: each task sends its own k best."""
    return df.orderBy(F.col(score).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]).limit(k)


def balanced_examples(
    df: DataFrame,
    *,
    label: str,
    entity: str,
    spread: str,
    disagreement: str,
    n: int,
) -> DataFrame:
    """n examples: half per class by (spread asc, disagreement desc), then filled by disagreement.

    Input has one row per entity. Each pool is cut to n rows before the pools meet.
    """
    half = max(1, n // 2)
    ranked = df.withColumn("__neg", -F.col(disagreement))
    per_class = top_per_group(
        ranked.where(F.col(label).isin(0, 1)), keys=[label], score=spread, tie=["__neg", entity], k=half, descending=False
    ).withColumn("__pool", F.when(F.col(label) == 1, 0).otherwise(1))
    fill = top_per_group(ranked, keys=[], score=disagreement, tie=[entity], k=2 * n).withColumn("__pool", F.lit(2))
    pool = per_class.unionByName(fill)
    # an entity counts once, at its first place
    once = first_per_group(pool, keys=[entity], order=["__pool", "rank"])
    w = Window.orderBy("__pool", "rank")
    return (
        once.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).drop("__neg", "__pool", "rank")
    )


def seeded_sample(
    df: DataFrame, *, keys: Sequence[str], id_col: str, k: int, seed: int
) -> DataFrame:
    """k rows per group in an order fixed by (seed, id): the same at any parallelism."""
    drawn = df.withColumn("__draw", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))))
    out = top_per_group(drawn, keys=keys, score="__draw", tie=[id_col], k=k, descending=False)
    return out.drop("__draw", "rank")


def active_at(
    markets: DataFrame, *, now, lookback_seconds: float, lookahead_seconds: float, limit: int | None = None
) -> DataFrame:
    """Markets that ended at most ``lookback`` ago and start within ``lookahead``, earliest first."""
    t = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    us = F.unix_micros(t)
    start, end = F.unix_micros("market_start_ts"), F.unix_micros("market_end_ts")
    picked = markets.where(
        (end >= us - int(lookback_seconds * 1e6)) & (start <= us + int(lookahead_seconds * 1e6))
    )
    ordered = picked.orderBy("market_start_ts", "market_end_ts", "market_id")
    return ordered.limit(limit) if limit else ordered
