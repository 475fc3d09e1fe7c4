"""Labelled sample tables built from the silver grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.operators.asof import asof_join, asof_offsets
from tidemark.operators.rank import entity_split_map
from tidemark.operators.scan import micros, row_index, time_bucket
from tidemark.plans.instrument import lead_rows

# Names that would leak the future into a feature list.
LEAKY_PREFIXES = ("future_", "markout_", "label_")
LEAKY_NAMES = ("settled_yes", "btc_close_price", "close_price", "label_source", "split")
EXECUTABLE_PREFIXES = ("entry_", "exit_", "pnl_", "roi_", "cur_")


def is_feature(name: str) -> bool:
    return name not in LEAKY_NAMES and not name.startswith(LEAKY_PREFIXES)


def leaky_columns(names: Sequence[str]) -> list[str]:
    return [n for n in names if not is_feature(n)]


def feature_columns(names: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Columns that may be used as features: no leaks, no flags used as filters."""
    return [
        n
        for n in names
        if is_feature(n)
        and not n.startswith(EXECUTABLE_PREFIXES)
        and not n.endswith(("_is_stale", "_crossed_quote"))
        and n not in exclude
    ]


def with_reference_series(
    samples: DataFrame,
    series: DataFrame,
    *,
    columns: Sequence[str],
    stale_seconds: float = 5.0,
    fresh_only: bool = False,
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """Last row of a reference series at or before each sample, with its age and a stale flag.

    ``fresh_only`` drops stale samples; the limit then bounds the lookup itself.
    """
    right = series.select(F.col("sample_ts").alias("__series_ts"), *columns)
    # ages are cut to whole milliseconds, so the bound reaches one millisecond further
    joined = asof_join(
        samples, right, left_ts="sample_ts", right_ts="__series_ts", right_cols=columns,
        match_ts="matched_series_ts", bucket_seconds=bucket_seconds,
        tolerance=stale_seconds + 0.000999 if fresh_only else None,
    )
    age = fn.seconds_between("sample_ts", "matched_series_ts")
    out = joined.withColumns(
        {
            "series_age_seconds": age,
            "series_is_stale": F.col("matched_series_ts").isNull() | (age > stale_seconds),
        }
    )
    return out.where("NOT series_is_stale") if fresh_only else out


def open_close(
    markets: DataFrame,
    series: DataFrame,
    *,
    price: str = "mid_price",
    max_age: float | None = None,
    bucket_seconds: int | None = None,
) -> DataFrame:
    """Series value at each market's start and end (the last one at or before).

    Both instants of a market are looked up in one as-of pass.
    """
    right = series.select(F.col("sample_ts").alias("__ts"), F.col(price).alias("__px"))
    instants = F.array(
        F.struct(F.lit("open").alias("which"), F.col("market_start_ts").alias("at")),
        F.struct(F.lit("close").alias("which"), F.col("market_end_ts").alias("at")),
    )
    lookups = markets.select(*markets.columns, F.explode(instants).alias("__i")).select(
        *markets.columns, F.col("__i.which").alias("__which"), F.col("__i.at").alias("__at")
    )
    found = asof_join(
        lookups, right, left_ts="__at", right_ts="__ts", right_cols=["__px"], tolerance=max_age,
        bucket_seconds=bucket_seconds,
    )
    return found.groupBy(*markets.columns).agg(
        F.max(F.when(F.col("__which") == "open", F.col("__px"))).alias("open_price"),
        F.max(F.when(F.col("__which") == "close", F.col("__px"))).alias("close_price"),
    )


def terminal_gold(
    silver: DataFrame,
    series: DataFrame,
    *,
    series_columns: Sequence[str],
    sigma: str,
    stale_seconds: float = 5.0,
    bucket_seconds: int = 3_600,
    ratios: Mapping[str, float] | None = None,
) -> DataFrame:
    """Samples of fresh markets labelled with the settlement at the market's end."""
    fresh = silver.where(
        "mapping_status = 'ok' AND NOT yes_is_stale AND NOT no_is_stale "
        "AND time_to_expiry_seconds > 0 AND time_elapsed_seconds >= 0"
    ).dropna(subset=["yes_ask", "no_ask", "yes_mid", "no_mid"])
    joined = with_reference_series(
        fresh, series, columns=list(dict.fromkeys(["mid_price", sigma, *series_columns])),
        stale_seconds=stale_seconds, fresh_only=True, bucket_seconds=bucket_seconds,
    )
    spans = joined.groupBy("market_id").agg(
        F.min("market_start_ts").alias("market_start_ts"), F.min("market_end_ts").alias("market_end_ts")
    )
    splits = entity_split_map(spans, entity="market_id", ts="market_start_ts", **(ratios or {}))
    dim = open_close(spans, series).select("market_id", "open_price", "close_price").join(splits, "market_id", "left")
    labelled = joined.join(dim, "market_id", "left").withColumns(
        {
            "current_price": F.col("mid_price"),
            "return_since_open": fn.safe_div(F.col("mid_price"), F.col("open_price")) - 1.0,
            "distance_to_open": F.col("mid_price") - F.col("open_price"),
            "formula_p_yes": fn.formula_probability("mid_price", "open_price", sigma, "time_to_expiry_seconds"),
        }
    )
    return labelled.withColumns(
        {
            "edge_to_yes_ask": F.col("formula_p_yes") - F.col("yes_ask"),
            "edge_to_no_ask": (1.0 - F.col("formula_p_yes")) - F.col("no_ask"),
            "settled_yes": fn.settled_up("open_price", "close_price"),
            "label_source": F.lit("proxy"),
        }
    )


def repricing_gold(
    silver: DataFrame,
    series: DataFrame,
    *,
    series_columns: Sequence[str],
    sigma: str,
    open_column: str = "mid_price",
    stale_seconds: float = 5.0,
    steps: Sequence[int] = (1, 5, 30),
    threshold: float = 0.01,
    bucket_seconds: int = 3_600,
    ratios: Mapping[str, float] | None = None,
) -> DataFrame:
    """Samples with the mid ``k`` remaining rows ahead, its markout and a three-way label.

    ``open_column`` is the price the formula compares with; the default compares the
    current price with itself, which gives 0.5 everywhere.
    """
    fresh = silver.where("mapping_status = 'ok' AND NOT yes_is_stale AND NOT no_is_stale")
    joined = with_reference_series(
        fresh, series, columns=list(dict.fromkeys(["mid_price", sigma, *series_columns])),
        stale_seconds=stale_seconds, fresh_only=True, bucket_seconds=bucket_seconds,
    )
    priced = joined.withColumn(
        "formula_p_yes", fn.formula_probability("mid_price", open_column, sigma, "time_to_expiry_seconds")
    ).withColumns(
        {
            "formula_p_yes_minus_yes_mid": F.col("formula_p_yes") - F.col("yes_mid"),
            "formula_p_yes_minus_yes_ask": F.col("formula_p_yes") - F.col("yes_ask"),
        }
    )
    # rows were filtered out: number the remaining ones again
    indexed = row_index(
        priced, keys=["market_id"], bucket=time_bucket("sample_ts", 86_400), order=[micros("sample_ts")], name="__idx"
    )
    led = lead_rows(indexed, keys=["market_id"], index="__idx", value="yes_mid", steps=steps)
    new: dict[str, Column] = {}
    for k in steps:
        markout = F.col(f"future_yes_mid_{k}") - F.col("yes_mid")
        new[f"markout_{k}"] = markout
        new[f"label_reprice_{k}"] = fn.three_way(markout, threshold)
    splits = entity_split_map(joined, entity="market_id", ts="market_start_ts", **(ratios or {}))
    return led.withColumns(new).drop("__idx").join(splits, "market_id", "left")


def lead_time(
    samples: DataFrame, series: DataFrame, *, keys: Sequence[str], value: str, seconds: Sequence[int], tolerance: float
) -> DataFrame:
    """Value of the first row at or after ``t + s`` (within the tolerance) for each lead."""
    out = samples
    right = series.select(*keys, F.col("sample_ts").alias("__rts"), F.col(value).alias("__rv"))
    for s in seconds:
        shifted = out.withColumn("__at", fn.plus_ms("sample_ts", s * 1000))
        out = asof_join(
            shifted, right, on=keys, left_ts="__at", right_ts="__rts", direction="forward",
            tolerance=tolerance, right_cols=["__rv"],
        ).drop("__at").withColumnRenamed("__rv", f"{value}_in_{s}s")
    return out


QUOTE_FIELDS = (
    "yes_bid", "yes_ask", "no_bid", "no_ask",
    "yes_is_stale", "no_is_stale", "yes_crossed_quote", "no_crossed_quote",
)


def _usable(at: Column, fields: Sequence[str]) -> Column:
    """Prices present and flags known to be false (an unknown flag counts as bad)."""
    cond = F.lit(True)
    for f in fields:
        if f.endswith(("_is_stale", "_crossed_quote")):
            cond = cond & ~F.coalesce(at.getField(f), F.lit(True))
        else:
            cond = cond & at.getField(f).isNotNull()
    return cond


def executable_gold(
    base: DataFrame,
    silver: DataFrame,
    *,
    latencies_ms: Sequence[int] = (0, 1_000, 2_000),
    horizons_ms: Sequence[int] = (1_000, 5_000, 10_000, 30_000),
    tolerance: float = 1.0,
    price_bounds: bool = True,
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """Every sample × latency × horizon with executable entry and exit and its result.

    All lookups of a sample run in one as-of pass over the distinct offsets; the wide
    sample rows are expanded last, inside the row, after the filter on time left.
    """
    combos = [(a, h) for a in latencies_ms for h in horizons_ms]
    offsets = sorted({a for a, _ in combos} | {a + h for a, h in combos})
    looked = asof_offsets(
        base, silver, on=["market_id"], id_cols=["market_id", "sample_ts"], base_ts="sample_ts",
        quote_ts="sample_ts", offsets_ms=offsets, quote_cols=list(QUOTE_FIELDS), tolerance=tolerance,
        bucket_seconds=bucket_seconds,
    )
    table = F.array(
        *[
            F.struct(F.lit(a).cast("bigint").alias("latency_ms"), F.lit(h).cast("bigint").alias("horizon_ms"))
            for a, h in combos
        ]
    )
    left_ms = F.col("time_to_expiry_seconds") * 1000
    fits = F.filter(table, lambda c: left_ms >= c.latency_ms + c.horizon_ms)
    rows = looked.select("*", F.explode(fits).alias("__c"))
    entry = F.col("quotes_at")[F.col("__c.latency_ms")]
    exit_ = F.col("quotes_at")[F.col("__c.latency_ms") + F.col("__c.horizon_ms")]
    rows = rows.withColumns({"__e": entry, "__x": exit_})
    e, x = F.col("__e"), F.col("__x")
    flags = ["yes_is_stale", "no_is_stale", "yes_crossed_quote", "no_crossed_quote"]
    valid = _usable(e, ["yes_ask", "no_ask", *flags]) & _usable(x, ["yes_bid", "no_bid", *flags])
    if price_bounds:
        for f in ("yes_ask", "no_ask"):
            valid = valid & (e.getField(f) > 0) & (e.getField(f) <= 1)
    kept = rows.where(valid)
    up = x.getField("yes_bid") - e.getField("yes_ask")
    down = x.getField("no_bid") - e.getField("no_ask")
    return kept.select(
        *base.columns,
        (F.col("__c.latency_ms") / 1000).alias("latency_seconds"),
        (F.col("__c.horizon_ms") / 1000).alias("exit_horizon_seconds"),
        e.getField("quote_ts").alias("entry_quote_ts"),
        x.getField("quote_ts").alias("exit_quote_ts"),
        e.getField("yes_ask").alias("entry_yes_ask"),
        e.getField("no_ask").alias("entry_no_ask"),
        x.getField("yes_bid").alias("exit_yes_bid"),
        x.getField("no_bid").alias("exit_no_bid"),
        up.alias("pnl_up"),
        F.when(e.getField("yes_ask") != 0, up / e.getField("yes_ask")).alias("roi_up"),
        (up > 0).cast("int").alias("label_up_profitable"),
        down.alias("pnl_down"),
        F.when(e.getField("no_ask") != 0, down / e.getField("no_ask")).alias("roi_down"),
        (down > 0).cast("int").alias("label_down_profitable"),
    )


def event_time_gold(
    events: DataFrame,
    gold: DataFrame,
    silver: DataFrame,
    *,
    feature_columns: Sequence[str],
    latencies_ms: Sequence[int] = (0, 250, 500, 1_000, 2_000),
    horizons_ms: Sequence[int] = (1_000, 5_000, 10_000, 30_000),
    feature_tolerance: float = 2.0,
    tolerance: float = 1.0,
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """Executable results sampled at quote-update times instead of the grid."""
    times = (
        events.where("update_bid IS NOT NULL OR update_ask IS NOT NULL")
        .select("market_id", F.col("ts_event").alias("sample_ts"))
        .distinct()
    )
    features = gold.select("market_id", F.col("sample_ts").alias("__g_ts"), *feature_columns)
    base = asof_join(
        times, features, on=["market_id"], left_ts="sample_ts", right_ts="__g_ts",
        right_cols=list(feature_columns), tolerance=feature_tolerance, bucket_seconds=bucket_seconds,
    )
    return executable_gold(
        base, silver, latencies_ms=latencies_ms, horizons_ms=horizons_ms, tolerance=tolerance,
        price_bounds=False, bucket_seconds=bucket_seconds,
    )


def label_rates(executable: DataFrame) -> DataFrame:
    """Rows, win rates and average results per latency and horizon."""
    return executable.groupBy("latency_seconds", "exit_horizon_seconds").agg(
        F.count("*").alias("rows"),
        F.avg("label_up_profitable").alias("up_profitable_rate"),
        F.avg("pnl_up").alias("avg_pnl_up"),
        F.avg("label_down_profitable").alias("down_profitable_rate"),
        F.avg("pnl_down").alias("avg_pnl_down"),
    )
