"""History through the live rules: the same transforms on a table, window by window."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.cooldown import cooldown_thin
from tidemark.operators.gates import Rule, first_reason
from tidemark.operators.pick import first_per_group
from tidemark.plans.quality import rows_in_windows
from tidemark.session import stage


def replay_windows(
    rows: DataFrame,
    windows: DataFrame,
    *,
    rules: Sequence[Rule],
    cooldown_seconds: float,
    forced: bool = False,
    tie: str = "event_id",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Signals the live rules would emit inside each window, from its centre on.

    Windows: window_id, market_id, start_ts, center_ts, end_ts. Cooldowns start fresh in
    every window. ``forced`` adds a signal at the centre sample itself.

    Without ``prepare`` a row passes or not whatever the window, so the first row that may follow
    it after the cooldown is the same in all windows of its market: windows hop from one to the
    next, and the rows between are never paired with them. Windows whose id has several, and
    rows that ``prepare`` changes window by window, are paired.
    """
    if prepare or cooldown_seconds <= 0:
        return _paired(rows, windows, rules, cooldown_seconds, forced, tie, prepare)
    known = windows.where("window_id IS NOT NULL AND market_id IS NOT NULL AND start_ts <= end_ts")
    spans = windows.where("window_id IS NOT NULL").groupBy("window_id").agg(
        F.count_distinct(F.struct("market_id", "start_ts", "center_ts", "end_ts")).alias("__n")
    )
    several = spans.where("__n > 1").select("window_id")
    single = stage(known.join(several, "window_id", "left_anti").select("window_id", "market_id", "start_ts", "center_ts", "end_ts").distinct(), "replay_spans")
    emitted = _hopped(rows, single, rules, cooldown_seconds, tie)
    if not several.isEmpty():
        mixed = windows.join(several, "window_id", "left_semi")
        emitted = emitted.unionByName(_paired(rows, mixed, rules, cooldown_seconds, False, tie, None))
    if not forced:
        return emitted
    centres = known.select("window_id", "market_id", "start_ts", "end_ts").join(windows.select("window_id", "center_ts"), "window_id")
    centres = centres.where("center_ts BETWEEN start_ts AND end_ts").select("window_id", "market_id", "center_ts", F.col("center_ts").alias("sample_ts"))
    at_centre = rows.join(centres, ["market_id", "sample_ts"]).withColumn("is_forced", F.lit(True))
    return emitted.unionByName(at_centre.select(emitted.columns))


def _hopped(rows: DataFrame, windows: DataFrame, rules: Sequence[Rule], cooldown_seconds: float, tie: str) -> DataFrame:
    """What a cooldown keeps in each window, by hops from one passing row to the next that may follow."""
    passed = rows.where(first_reason(rules).isNull() & F.col("market_id").isNotNull() & F.col("sample_ts").isNotNull())
    firsts = stage(first_per_group(passed, keys=["market_id", "sample_ts"], order=[tie]), "replay_firsts")
    places = firsts.select("market_id", F.col("sample_ts").alias("__to"))
    wait = int(round(cooldown_seconds * 1_000_000))
    after = firsts.select("market_id", F.col("sample_ts").alias("__at"), F.timestamp_micros(F.unix_micros("sample_ts") + wait).alias("__due"))
    # a map of places only: the rows' other columns come in at the end
    hops = asof_join(after, places, on=["market_id"], left_ts="__due", right_ts="__to", direction="forward", right_cols=[], match_ts="__next")
    hops = stage(hops.where("__next IS NOT NULL").select("market_id", "__at", "__next"), "replay_hops")
    begun = windows.where("center_ts IS NOT NULL").withColumn("__from", F.greatest("start_ts", "center_ts"))
    begun = asof_join(begun, places, on=["market_id"], left_ts="__from", right_ts="__to", direction="forward", right_cols=[], match_ts="__at")
    keep = ("window_id", "market_id", "center_ts", "end_ts", "__at")
    here = stage(begun.where("__at <= end_ts").select(*keep), "replay_reached")
    reached = [here]
    while not here.isEmpty():
        onward = here.join(hops, ["market_id", "__at"]).where("__next <= end_ts").withColumn("__at", F.col("__next"))
        here = stage(onward.select(*keep), "replay_reached")
        reached.append(here)
    marks = reduce(DataFrame.unionByName, reached).select("window_id", "market_id", "center_ts", F.col("__at").alias("sample_ts"))
    out = firsts.join(marks, ["market_id", "sample_ts"])
    return out.select(*rows.columns, "window_id", "center_ts").withColumn("is_forced", F.lit(False))


def _paired(
    rows: DataFrame, windows: DataFrame, rules: Sequence[Rule], cooldown_seconds: float, forced: bool, tie: str,
    prepare: Callable[[DataFrame], DataFrame] | None,
) -> DataFrame:
    hit = rows_in_windows(rows, windows.drop("center_ts"), ts="sample_ts").drop("start_ts", "end_ts")
    hit = hit.join(windows.select("window_id", "center_ts"), "window_id")
    ready = prepare(hit) if prepare else hit
    passed = ready.where(F.col("sample_ts") >= F.col("center_ts")).where(first_reason(rules).isNull())
    emitted = cooldown_thin(
        passed, keys=["window_id"], ts="sample_ts", tie=tie, seconds=cooldown_seconds
    ).withColumn("is_forced", F.lit(False))
    if not forced:
        return emitted
    at_centre = ready.where(F.col("sample_ts") == F.col("center_ts")).withColumn("is_forced", F.lit(True))
    return emitted.unionByName(at_centre)


def replay_tail(
    rows: DataFrame, *, keys: Sequence[str], rules: Sequence[Rule], cooldown_seconds: float, minutes: float, ts: str = "sample_ts", tie: str = "event_id",
) -> DataFrame:
    """Signals the live rules would have emitted in the last ``minutes`` of the table, with fresh cooldowns.

    The newest time is read first, as one value, so that the filter on it reaches the scan. Rows
    without a time, and an empty table, give nothing.
    """
    newest = rows.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()[0]
    start = F.lit(None) if newest is None else F.lit(newest - int(round(minutes * 60e6)))
    since = F.timestamp_micros(start.cast("bigint")).cast(rows.schema[ts].dataType)
    passed = rows.where(F.col(ts) >= since).where(first_reason(rules).isNull())
    return cooldown_thin(passed, keys=keys, ts=ts, tie=tie, seconds=cooldown_seconds)
