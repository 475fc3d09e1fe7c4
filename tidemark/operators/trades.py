"""Trade selection modes and trade metrics over any grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.borders import MOST_ROWS, row_buckets
from tidemark.operators.cooldown import cooldown_thin
from tidemark.operators.pick import first_per_group
from tidemark.operators.quantile import group_quantiles, null_safe_join
from tidemark.operators.scan import bucket_start, micros, prefix_scan, row_index, time_bucket

# Selection modes and their cooldown in seconds (None = first only).
MODES = {
    "all_signals": 0,
    "first_signal_per_market_side": None,
    "cooldown_5s": 5,
    "cooldown_10s": 10,
    "cooldown_30s": 30,
}


def select_modes(
    signals: DataFrame,
    *,
    params: Sequence[str],
    side_keys: Sequence[str] = ("market_id", "direction"),
    ts: str = "sample_ts",
    tie: str = "event_id",
    modes: Mapping[str, float | None] = MODES,
) -> DataFrame:
    """Signals as each selection mode would trade them, with a ``mode`` column.

    All cooldowns run in one pass, as one more key.
    """
    by = list(dict.fromkeys([*params, *side_keys]))
    parts = []
    cooldowns = {}
    for mode, seconds in modes.items():
        if seconds is None:
            parts.append(first_per_group(signals, keys=by, order=[ts, tie]).withColumn("mode", F.lit(mode)))
        elif seconds == 0:
            parts.append(signals.withColumn("mode", F.lit(mode)))
        else:
            cooldowns[mode] = float(seconds)
    if cooldowns:
        options = F.array(
            *[F.struct(F.lit(m).alias("mode"), F.lit(s).alias("__cool")) for m, s in cooldowns.items()]
        )
        fanned = signals.select("*", F.explode(options).alias("__m")).select(*signals.columns, "__m.mode", "__m.__cool")
        thinned = cooldown_thin(
            fanned, keys=[*by, "mode"], ts=ts, tie=tie, seconds="__cool"
        )
        parts.append(thinned.drop("__cool"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _chain(blocks: DataFrame, *, group: Sequence[str], order: str) -> DataFrame:
    """Combine (sum, peak, trough, drawdown) of consecutive blocks into one per group."""
    before = Window.partitionBy(*(list(group) or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("__off", F.coalesce(F.sum("__s").over(before), F.lit(0.0)))
    placed = placed.withColumn("__peak", F.max(F.col("__off") + F.col("__p")).over(before))
    fall = F.greatest(F.col("__d"), F.col("__peak") - (F.col("__off") + F.col("__m")))
    return placed.groupBy(*group).agg(
        F.sum("__s").alias("__s"),
        F.max(F.col("__off") + F.col("__p")).alias("__p"),
        F.min(F.col("__off") + F.col("__m")).alias("__m"),
        F.max(fall).alias("__d"),
    )


def max_drawdown(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    value: str,
    within: str | None = None,
    bucket_seconds: int | None = None,
    most_rows: int = MOST_ROWS,
    name: str = "max_drawdown",
) -> DataFrame:
    """Largest fall of the running sum below its running peak, per group (≥ 0).

    The peak starts at the first running sum, not at zero. Rows run in time order, or
    with ``within`` entity by entity (in entity order) and in time order inside one.
    Each bucket (about ``most_rows`` rows, or a fixed time) is reduced to (sum, peak, trough, own drawdown); these four
    combine in order, so no task sees a whole group.
    """
    group = [*keys, *([within] if within else [])]
    by = [*group, "__b"]
    ties = [f"__t{i}" for i in range(len(tie))]
    rows = df.where(F.col(value).isNotNull()).select(
        *group,
        F.col(value).cast("double").alias("__v"),
        micros(ts).alias("__us"),
        *[F.col(t).alias(a) for t, a in zip(tie, ties)],
    )
    if bucket_seconds is None:
        ordered = rows.withColumn("__order", F.struct("__us", *ties))
        rows = row_buckets([ordered], keys=group, order="__order", most_rows=most_rows, name="__b")[0].drop("__order")
    else:
        rows = rows.withColumn("__b", bucket_start(F.col("__us"), bucket_seconds * 1_000_000))
    inside = Window.partitionBy(*by).orderBy("__us", *ties).rowsBetween(Window.unboundedPreceding, 0)
    walked = rows.withColumn("__eq", F.sum("__v").over(inside)).withColumn(
        "__dd", F.max("__eq").over(inside) - F.col("__eq")
    )
    blocks = walked.groupBy(*by).agg(
        F.sum("__v").alias("__s"), F.max("__eq").alias("__p"), F.min("__eq").alias("__m"), F.max("__dd").alias("__d")
    )
    out = _chain(blocks, group=group, order="__b")
    if within:
        out = _chain(out, group=list(keys), order=within)
    return out.select(*keys, F.col("__d").alias(name))


def equity_curve(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    value: str,
    points: int = 200,
    bucket_seconds: int | None = None,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Running sum and drawdown at every ⌊n / points⌋-th row and the last one."""
    order = [micros(ts), *tie]
    if bucket_seconds is None:
        ordered = df.withColumn("__order", F.struct(micros(ts), *tie))
        df = row_buckets([ordered], keys=keys, order="__order", most_rows=most_rows)[0].drop("__order")
        bucket = F.col("__rb")
    else:
        bucket = time_bucket(ts, bucket_seconds)
    eq = prefix_scan(
        df, keys=keys, bucket=bucket, order=order,
        sums={"cum_pnl": F.col(value), "__pos": F.lit(1).cast("bigint")},
    )
    peaked = prefix_scan(eq, keys=keys, bucket=bucket, order=order, maxs={"__peak": F.col("cum_pnl")})
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    full = null_safe_join(peaked, n, keys).withColumn("__i", F.col("__pos") - 1)
    every = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("__n") / points))
    picked = full.where((F.pmod(F.col("__i"), every) == 0) | (F.col("__i") == F.col("__n") - 1))
    return picked.select(
        *keys, ts, *tie, value, "cum_pnl", (F.col("__peak") - F.col("cum_pnl")).alias("drawdown")
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.when(F.abs(den) > 1e-12, num / den)


def trade_metrics(
    trades: DataFrame,
    *,
    keys: Sequence[str],
    ts: str = "sample_ts",
    tie: Sequence[str] = ("event_id",),
    pnl: str = "pnl",
    means: Mapping[str, str] | None = None,
    quartiles: bool = False,
    within: str | None = None,
    bucket_seconds: int | None = 86_400,
) -> DataFrame:
    """One row per group: trades, win rate, total / avg / median / std of pnl, drawdown.

    ``means`` maps output names to columns that are averaged as well. The standard
    deviation of a single trade is 0; ``sharpe_like`` is null when it is 0.
    """
    means = means if means is not None else {
        "avg_entry_price": "entry_price",
        "avg_exit_price": "exit_price",
        "avg_time_to_expiry": "time_to_expiry_seconds",
    }
    p = F.col(pnl)
    base = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        *[F.avg(col).alias(name) for name, col in means.items()],
        F.avg((p > 0).cast("double")).alias("win_rate"),
        F.sum(p).alias("total_pnl"),
        F.avg(p).alias("avg_pnl"),
        F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("pnl_std"),
    )
    base = base.withColumn("sharpe_like", _ratio(F.col("avg_pnl"), F.col("pnl_std")))
    wanted = {"median_pnl": 0.5} | ({"pnl_p25": 0.25, "pnl_p75": 0.75} if quartiles else {})
    qs = group_quantiles(trades, keys=keys, value=pnl, quantiles=wanted)
    dd = max_drawdown(
        trades, keys=keys, ts=ts, tie=tie, value=pnl, within=within, bucket_seconds=bucket_seconds
    )
    return null_safe_join(null_safe_join(base, qs, keys), dd, keys)


def simple_metrics(trades: DataFrame, *, keys: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """Trades, total, average and win rate per group: one combined aggregate."""
    p = F.col(pnl)
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.sum(p).alias("total_pnl"),
        F.avg(p).alias("avg_pnl"),
        F.avg((p > 0).cast("double")).alias("win_rate"),
    )


def metrics_by_sets(
    trades: DataFrame, *, params: Sequence[str], cuts: Sequence[str], pnl: str = "pnl"
) -> DataFrame:
    """Simple metrics per parameter set, overall and by each cut, as grouping sets.

    ``cut`` names the column of the row's grouping ("overall" for none), ``cut_value``
    holds its value.
    """
    p = F.col(pnl)
    # finest level first, so the grouping sets expand few rows
    fine = trades.groupBy(*params, *cuts).agg(
        F.count("*").alias("__n"), F.sum(p).alias("__s"), F.sum((p > 0).cast("bigint")).alias("__w")
    )
    sets = [list(params)] + [[*params, c] for c in cuts]
    cols = [*params, *cuts]
    grouped = fine.groupingSets(sets, *cols).agg(
        *[F.grouping(c).alias(f"__g_{c}") for c in cuts],
        F.sum("__n").alias("trades"),
        F.sum("__s").alias("total_pnl"),
        F.sum("__w").alias("__wins"),
    )
    cut, value = F.lit("overall"), F.lit(None).cast("string")
    for c in cuts:
        here = F.col(f"__g_{c}") == 0
        cut = F.when(here, c).otherwise(cut)
        value = F.when(here, F.col(c).cast("string")).otherwise(value)
    return grouped.select(
        *params,
        cut.alias("cut"),
        value.alias("cut_value"),
        "trades",
        "total_pnl",
        (F.col("total_pnl") / F.col("trades")).alias("avg_pnl"),
        (F.col("__wins") / F.col("trades")).alias("win_rate"),
    )


def stability(
    trades: DataFrame,
    *,
    params: Sequence[str],
    date: str = "date",
    bucket: str = "tte_bucket",
    market: str = "market_id",
    pnl: str = "pnl",
) -> DataFrame:
    """How evenly the result is spread over dates, buckets and markets, per parameter set."""
    per = metrics_by_sets(trades, params=params, cuts=[date, bucket, market], pnl=pnl)
    total = F.col("total_pnl")

    def is_cut(c: str) -> Column:
        return F.col("cut") == c

    out = per.groupBy(*params).agg(
        F.max(F.when(is_cut("overall"), F.col("trades"))).alias("trades"),
        F.max(F.when(is_cut("overall"), total)).alias("total_pnl"),
        F.max(F.when(is_cut("overall"), F.col("avg_pnl"))).alias("avg_pnl"),
        F.max(F.when(is_cut("overall"), F.col("win_rate"))).alias("win_rate"),
        F.count_if(is_cut(market)).alias("unique_market_count"),
        F.count_if(is_cut(date) & (total > 0)).alias("positive_date_count"),
        F.count_if(is_cut(date) & (total < 0)).alias("negative_date_count"),
        F.min(F.when(is_cut(date), total)).alias("worst_date_pnl"),
        F.max(F.when(is_cut(date), total)).alias("best_date_pnl"),
        F.count_if(is_cut(bucket) & (total > 0)).alias("positive_tte_bucket_count"),
        F.count_if(is_cut(bucket) & (total < 0)).alias("negative_tte_bucket_count"),
        F.max(F.when(is_cut(market), total)).alias("top_market_pnl"),
    )
    share = F.abs("top_market_pnl") / F.greatest(F.abs("total_pnl"), F.lit(1e-12))
    return out.withColumns(
        {
            "avg_trades_per_market": F.col("trades") / F.col("unique_market_count"),
            "top_market_pnl_share_abs": F.when(F.col("total_pnl") != 0, share),
        }
    )


def break_even(
    metrics: DataFrame, *, keys: Sequence[str], cost: str, avg: str = "avg_pnl"
) -> DataFrame:
    """Metric row at the largest cost whose average pnl is still not negative."""
    ok = metrics.where(F.col(avg) >= 0)
    best = ok.groupBy(*keys).agg(F.max_by(F.struct(*metrics.columns), cost).alias("__row"))
    return best.select("__row.*").withColumn("break_even_cost", F.col(cost))


def sequential_rows(df: DataFrame, *, ts: str, tie: Sequence[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """Global row number in time order (``row_idx``)."""
    return row_index(df, keys=[], most_rows=most_rows, order=[micros(ts), *tie])
