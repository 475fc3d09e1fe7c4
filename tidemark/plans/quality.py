"""Data-quality tables and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.pick import top_per_group
from tidemark.operators.quantile import count_distinct_nulls, distribution, group_quantiles, null_safe_join
from tidemark.operators.rank import equal_bins


def null_ratios(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and ratio of every column: one pass, then one row per column."""
    names = list(columns or df.columns)
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in names])
    return one.select("__n", F.explode(pairs).alias("__p")).select(
        "__p.column", "__p.null_count", (F.col("__p.null_count") / F.greatest(F.col("__n"), F.lit(1))).alias("null_ratio")
    )


def split_leakage(df: DataFrame, *, entity: str, split: str = "split") -> DataFrame:
    """Entities that occur in more than one split."""
    pairs = df.select(entity, split).distinct()
    return pairs.groupBy(entity).agg(F.count("*").alias("split_count")).where("split_count > 1")


def non_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinite values per column."""
    one = df.agg(*[F.count_if(F.col(c).isNotNull() & ~fn.is_finite(c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_finite")) for c in columns])
    return one.select(F.explode(pairs).alias("__p")).select("__p.*")


def coverage_after(samples: DataFrame, series: DataFrame, *, ts: str = "sample_ts", entity: str = "market_id") -> DataFrame:
    """Rows and entities sampled after the reference series ends, and each one's range."""
    end = series.agg(F.max(ts).alias("__max"))
    tagged = null_safe_join(samples.select(entity, ts), end, [], "inner")
    late = F.col(ts) > F.col("__max")
    per = tagged.groupBy(entity).agg(
        F.count("*").alias("rows"),
        F.count_if(late).alias("rows_after"),
        F.min(F.when(late, F.col(ts))).alias("first_after"),
        F.max(F.when(late, F.col(ts))).alias("last_after"),
    )
    return per


def coverage_summary(per_entity: DataFrame) -> DataFrame:
    return per_entity.agg(
        F.sum("rows_after").alias("rows_after"),
        F.count_if(F.col("rows_after") > 0).alias("entities_after"),
        (F.sum("rows_after") / F.greatest(F.sum("rows"), F.lit(1))).alias("ratio_after"),
    )


def market_variability(df: DataFrame, *, values: Sequence[str], entity: str = "market_id", ts: str = "sample_ts") -> DataFrame:
    """Rows, time range, and range / deviation / distinct values of each column per market."""
    aggs = [F.count("*").alias("rows"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")]
    for v in values:
        aggs += [
            F.min(v).alias(f"{v}_min"),
            F.max(v).alias(f"{v}_max"),
            (F.max(v) - F.min(v)).alias(f"{v}_range"),
            F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std"),
        ]
    base = df.groupBy(entity).agg(*aggs)
    out = base
    for v in values:
        # distinct values first: a hot market is deduplicated map-side
        d = df.select(entity, v).distinct().groupBy(entity).agg(F.count("*").alias(f"{v}_unique"))
        out = out.join(d, entity, "left")
    return out


def quote_flags(df: DataFrame) -> DataFrame:
    """Shares of constant or saturated quotes."""

    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    c = F.col
    return df.agg(
        share(c("yes_mid") == 0.5).alias("yes_mid_half_rate"),
        share(c("no_mid") == 0.5).alias("no_mid_half_rate"),
        share(c("yes_bid") <= 0.01).alias("yes_bid_floor_rate"),
        share(c("no_bid") <= 0.01).alias("no_bid_floor_rate"),
        share(c("yes_ask") >= 0.99).alias("yes_ask_ceiling_rate"),
        share(c("no_ask") >= 0.99).alias("no_ask_ceiling_rate"),
        share(c("pair_mid_sum") == 1.0).alias("pair_mid_sum_one_rate"),
    )


def quote_verdict(flags: DataFrame, variability: DataFrame) -> DataFrame:
    """Pass / fail checks on the quote shares and the share of constant markets."""
    const = variability.agg(F.avg((F.col("yes_mid_unique") <= 1).cast("double")).alias("constant_market_rate"))
    both = null_safe_join(flags, const, [], "inner")
    z = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in both.columns}
    checks = {
        "yes_mid_half_gt_80": z["yes_mid_half_rate"] > 0.8,
        "no_mid_half_gt_80": z["no_mid_half_rate"] > 0.8,
        "yes_bid_floor_gt_80": z["yes_bid_floor_rate"] > 0.8,
        "yes_ask_ceiling_gt_80": z["yes_ask_ceiling_rate"] > 0.8,
        "constant_markets_gt_50": z["constant_market_rate"] > 0.5,
    }
    failed = F.lit(False)
    for cond in checks.values():
        failed = failed | cond
    return both.select(*[c.alias(n) for n, c in checks.items()], (~failed).alias("audit_pass"))


def label_comparison(proxy: DataFrame, real: DataFrame, *, entity: str = "market_id") -> DataFrame:
    """Proxy and real label per market and whether they agree."""
    joined = proxy.join(real, entity, "left")
    return joined.select(
        entity,
        "settled_yes_proxy",
        "settled_yes_real",
        (F.col("settled_yes_proxy") == F.col("settled_yes_real")).cast("int").alias("match"),
    )


def label_match_rate(comparison: DataFrame) -> DataFrame:
    """One row: entities, those with a real label, agreements and their share."""
    matched = F.count("match")
    return comparison.agg(
        F.count("*").alias("entities"),
        matched.alias("compared"),
        F.sum("match").alias("matches"),
        F.when(matched > 0, F.sum("match") / matched).alias("match_rate"),
    )


def timeline(
    sources: dict[str, DataFrame], *, entity: str, per_source: int = 20, total: int = 50, ts: str = "ts"
) -> DataFrame:
    """First rows of each source per market, labelled and merged in time order."""
    parts = []
    for name, df in sources.items():
        parts.append(
            top_per_group(df.withColumn("source", F.lit(name)), keys=[entity], score=ts, tie=["row_id"], k=per_source, descending=False).drop("rank")
        )
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p, allowMissingColumns=True)
    # at most per_source rows per source are left
    w = Window.partitionBy(entity).orderBy(ts, "source", "row_id")
    return merged.withColumn("position", F.row_number().over(w)).where(F.col("position") <= total)


def first_last(df: DataFrame, *, entity: str, ts: str, tie: str, value: str) -> DataFrame:
    """First, last, lowest and highest value per entity in time order."""
    order = F.struct(ts, tie)
    return df.groupBy(entity).agg(
        F.min_by(value, order).alias(f"first_{value}"),
        F.max_by(value, order).alias(f"last_{value}"),
        F.min(value).alias(f"min_{value}"),
        F.max(value).alias(f"max_{value}"),
    )


def nearest_rows(
    df: DataFrame, *, entity: str, value: str, targets: Sequence[float], tie: str, columns: Sequence[str], at_most: float | None = None
) -> DataFrame:
    """The row nearest to each target per entity: all targets in one combined aggregate."""
    rows = df.where(F.col(value) <= at_most) if at_most is not None else df
    aggs = [
        F.min_by(F.struct(*columns), F.struct(F.abs(F.col(value) - float(t)), F.col(tie))).alias(f"__t{i}")
        for i, t in enumerate(targets)
    ]
    g = rows.groupBy(entity).agg(*aggs)
    picks = F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"__t{i}").alias("r")) for i, t in enumerate(targets)])
    return g.select(entity, F.explode(picks).alias("__p")).select(entity, "__p.target", "__p.r.*")


def rates(df: DataFrame, *, keys: Sequence[str], label: str, entity: str | None = None, name: str = "rate") -> DataFrame:
    """Rows, entities and mean label per group."""
    aggs = [F.count("*").alias("rows"), F.avg(F.col(label).cast("double")).alias(name)]
    base = df.groupBy(*keys).agg(*aggs)
    if not entity:
        return base
    entities = df.select(*keys, entity).distinct().groupBy(*keys).agg(F.count("*").alias("entities"))
    return null_safe_join(base, entities, keys)


def group_summary(df: DataFrame, *, keys: Sequence[str], entity: str, ts: str) -> DataFrame:
    """Rows, entities and time range per group (null counts as an entity of its own)."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        count_distinct_nulls(entity).alias("entities"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def label_distribution(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Counts per label column and value, long form."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in labels])
    return df.select(F.explode(pairs).alias("__p")).groupBy("__p.label", "__p.value").agg(F.count("*").alias("rows"))


def is_monotonic(df: DataFrame, *, keys: Sequence[str], order: str, value: str, tolerance: float = 0.02) -> DataFrame:
    """Does the value not fall by more than the tolerance along the order? False below 3 values.

    Input is a short list per key, such as bucket means.
    """
    w = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(order)
    steps = df.where(F.col(value).isNotNull()).select(
        *keys, (F.col(value) + tolerance >= F.lag(value).over(w)).alias("__ok")
    )
    return steps.groupBy(*keys).agg(
        F.count("*").alias("values"),
        (F.coalesce(F.bool_and("__ok"), F.lit(False)) & (F.count("*") >= 3)).alias("monotonic"),
    )


def decile_rates(df: DataFrame, *, prob: str, label: str, tie: str, keys: Sequence[str] = (), rule: str = "floor") -> DataFrame:
    """Rows, probability range and observed rate per equal-frequency decile."""
    binned = equal_bins(df.where(F.col(prob).isNotNull() & F.col(label).isNotNull()), keys=keys, value=prob, tie=tie, rule=rule)
    return binned.groupBy(*keys, "decile").agg(
        F.count("*").alias("rows"),
        F.min(prob).alias("prob_min"),
        F.max(prob).alias("prob_max"),
        F.avg(prob).alias("prob_mean"),
        F.avg(F.col(label).cast("double")).alias("rate"),
    )


def top_decile(df: DataFrame, *, prob: str, markout: str, q: float = 0.9) -> DataFrame:
    """Markout of the rows at or above the nearest-rank quantile of a probability."""
    cut = group_quantiles(df, keys=[], value=prob, quantiles={"prob_cutoff": q}, method="nearest")
    part = null_safe_join(df, cut, [], "inner").where(F.col(prob) >= F.col("prob_cutoff"))
    m = F.col(markout)
    base = part.agg(
        F.max("prob_cutoff").alias("prob_cutoff"),
        F.count("*").alias("rows"),
        F.avg(m).alias("mean_markout"),
        F.avg((m > 0).cast("double")).alias("win_rate"),
        F.avg((m > 0.01).cast("double")).alias("gt_1c_rate"),
    )
    qs = group_quantiles(part, keys=[], value=markout, quantiles={"p25": 0.25, "p75": 0.75}, method="nearest")
    mid = group_quantiles(part, keys=[], value=markout, quantiles={"median": 0.5})
    return null_safe_join(null_safe_join(base, qs, []), mid, [])


def label_audit(df: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """Distribution and threshold rates of a result column per group."""
    v = F.col(value)

    def rate(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    base = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.avg(v).alias("mean"),
        rate(v > 0).alias("positive_rate"),
        rate(v < 0).alias("negative_rate"),
        rate(F.abs(v) > 0.01).alias("abs_gt_1c_rate"),
        rate(F.abs(v) > 0.02).alias("abs_gt_2c_rate"),
    )
    qs = group_quantiles(df, keys=keys, value=v, quantiles={"p10": 0.1, "p50": 0.5, "p90": 0.9}, method="nearest")
    return null_safe_join(base, qs, keys)


def label_audit_cuts(df: DataFrame, *, cuts: Mapping[str, Column], value: str) -> DataFrame:
    """``label_audit`` by each of several groupings in one pass: columns cut, bucket and the audit."""
    pairs = F.array(*[F.struct(F.lit(n).alias("cut"), c.cast("string").alias("bucket")) for n, c in cuts.items()])
    long = df.select(F.col(value).alias("__v"), F.explode(pairs).alias("__c")).select("__v", "__c.*")
    return label_audit(long, keys=["cut", "bucket"], value="__v")


def confidence_regime(probability: str | Column) -> Column:
    """How sure a probability is: distance from one half."""
    p = F.col(probability) if isinstance(probability, str) else probability
    distance = F.abs(p - 0.5)
    return F.when(distance >= 0.3, "high").when(distance >= 0.15, "medium").when(distance.isNotNull(), "low")


def run_diagnostics(scored: DataFrame, *, run: str = "run_id", values: Sequence[str] = ("p_up", "p_down")) -> DataFrame:
    """Counts, maxima and linear quantiles of the probabilities of each run."""
    out = scored.groupBy(run).agg(F.count("*").alias("inferences"), *[F.max(v).alias(f"max_{v}") for v in values])
    for v in values:
        qs = {f"{v}_p50": 0.5, f"{v}_p90": 0.9, f"{v}_p95": 0.95, f"{v}_p99": 0.99}
        out = null_safe_join(out, group_quantiles(scored, keys=[run], value=v, quantiles=qs), [run])
    return out


def replay_windows(
    candidates: DataFrame, *, group: str, score: str, per_group: int = 20, before_s: int = 60, after_s: int = 90
) -> DataFrame:
    """The best candidates of each group with an interval around their sample."""
    best = top_per_group(candidates, keys=[group], score=score, tie=["date", "market_id", "sample_ts", "event_id"], k=per_group)
    return best.withColumns(
        {
            "window_id": fn.stable_id(group, "market_id", "sample_ts", "event_id"),
            "start_ts": fn.plus_ms("sample_ts", -before_s * 1000),
            "end_ts": fn.plus_ms("sample_ts", after_s * 1000),
        }
    )


def rows_in_windows(rows: DataFrame, windows: DataFrame, *, entity: str = "market_id", ts: str = "sample_ts", cell_seconds: int = 300) -> DataFrame:
    """Rows inside the windows of their market, both ends included; windows without both ends hold none.

    Time is cut into cells, pairs of cells, pairs of those, and so on. A window is the union of at
    most two cells of each size, so a long one costs the logarithm of its length; a row is looked
    up once for each size that some window uses. The join key is (market, size, cell): a hot
    market spreads over its cells, and what meets there is the result but for the windows' ends.
    """
    known = windows.where("start_ts <= end_ts")
    cell = lambda c: F.floor(F.unix_timestamp(c) / cell_seconds)
    longest = known.agg(F.max(cell("end_ts") - cell("start_ts") + 1)).first()[0] or 1
    sizes = range(int(longest).bit_length())
    parts = []
    for k in sizes:
        # cells of this size inside the window; those not in a pair of the next size are taken
        first, end = F.ceil(cell("start_ts") / (1 << k)), F.floor((cell("end_ts") + 1) / (1 << k))
        for at, odd in ((first, first), (end - 1, end)):
            parts.append(F.when((first < end) & (F.pmod(odd, F.lit(2)) == 1), F.struct(F.lit(k).alias("k"), at.cast("bigint").alias("c"))))
    spans = known.select(entity, "window_id", "start_ts", "end_ts", F.inline(F.array_compact(F.array(*parts))).alias("__size", "__cell"))
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(cell(ts) / (1 << k)).cast("bigint").alias("c")) for k in sizes])
    left = rows.select("*", F.inline(places).alias("__size", "__cell"))
    hit = left.join(spans, [entity, "__size", "__cell"]).where(F.col(ts).between(F.col("start_ts"), F.col("end_ts")))
    return hit.drop("__size", "__cell")


__all__ = [
    "null_ratios", "split_leakage", "non_finite", "coverage_after", "coverage_summary", "market_variability",
    "quote_flags", "quote_verdict", "label_comparison", "timeline", "first_last", "nearest_rows", "rates",
    "group_summary", "label_distribution", "is_monotonic", "decile_rates", "top_decile", "label_audit",
    "run_diagnostics", "replay_windows", "rows_in_windows", "distribution",
]
