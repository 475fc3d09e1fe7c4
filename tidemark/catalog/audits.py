"""Queries on metrics, features, gates and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import quotes as cq
from tidemark.catalog import views as v
from tidemark.functions import scalars as fn
from tidemark.operators import gates, pick, rank
from tidemark.operators.quantile import distribution, group_quantiles
from tidemark.plans import features as ft
from tidemark.plans import quality as ql
from tidemark.session import stage

PROBS = ["p_up", "yes_ask", "yes_bid"]


def _round(cols, digits=6):
    return [F.round(c, digits).alias(c) for c in cols]


def auc_by_group(spark, sf):
    long = rank.unpivot_probabilities(v.predictions(spark, sf), keep=["settled_yes", "tte_bucket"], columns=PROBS)
    out = rank.binary_metrics(long, keys=["tte_bucket", "probability"], label="settled_yes", prob="p")
    return out.select("tte_bucket", "probability", "rows", *_round(["auc", "logloss", "brier", "accuracy_0p5"]))


def logloss_brier(spark, sf):
    out = rank.binary_metrics(v.predictions(spark, sf), label="settled_yes", prob="p_up")
    return out.select("rows", *_round(["auc", "logloss", "brier", "accuracy_0p5"]))


def inversion_check(spark, sf):
    p = v.predictions(spark, sf).withColumn("inv_p_up", 1 - F.col("p_up"))
    long = rank.unpivot_probabilities(p, keep=["settled_yes", "label_source"], columns=["p_up", "inv_p_up"])
    m = rank.binary_metrics(long, keys=["label_source", "probability"], label="settled_yes", prob="p")
    out = m.groupBy("label_source").agg(
        F.max(F.when(F.col("probability") == "p_up", F.col("auc"))).alias("auc"),
        F.max(F.when(F.col("probability") == "inv_p_up", F.col("auc"))).alias("inverted_auc"),
    )
    diff = F.col("inverted_auc") - F.col("auc")
    return out.select("label_source", *_round(["auc", "inverted_auc"]), F.round(diff, 6).alias("difference"), (diff > 0.05).alias("possible_inversion"))


def calibration_bins(spark, sf):
    out = rank.calibration_bins(v.predictions(spark, sf), keys=["label_source"], label="settled_yes", prob="p_up")
    return out.select("label_source", "prob_bin", "prob_bucket", "rows", *_round(["mean_pred", "observed_rate"]))


def deciles_floor(spark, sf):
    out = ql.decile_rates(v.predictions(spark, sf), prob="p_up", label="settled_yes", tie="event_id")
    return out.select("decile", "rows", "prob_min", "prob_max", *_round(["prob_mean", "rate"]))


def deciles_cuts(spark, sf):
    out = ql.decile_rates(v.predictions(spark, sf), keys=["label_source"], prob="p_up", label="settled_yes", tie="event_id", rule="cuts")
    return out.select("label_source", "decile", "rows", "prob_min", "prob_max", *_round(["prob_mean", "rate"]))


def decile_heavy_ties(spark, sf):
    """Most rows share one value: the bins still hold equal numbers of rows."""
    p = v.predictions(spark, sf).withColumn("p", F.when(F.col("p_up") < 0.6, 0.5).otherwise(F.col("p_up")))
    return rank.equal_bins(p, value="p", tie="event_id", bins=7).select("event_id", "decile")


def _classes(spark, sf):
    p = v.predictions(spark, sf)
    cls = lambda c: F.when(c > 0.66, "UP").when(c < 0.33, "DOWN").otherwise("FLAT")
    return p.select("tte_bucket", cls(F.col("p_up")).alias("predicted"), cls(F.col("yes_ask")).alias("actual"))


def confusion_counts(spark, sf):
    return rank.confusion(_classes(spark, sf), actual="actual", predicted="predicted")


def confusion_metrics(spark, sf):
    out = rank.multiclass_metrics(_classes(spark, sf), keys=["tte_bucket"], actual="actual", predicted="predicted", classes=["DOWN", "FLAT", "UP"])
    return out.select("tte_bucket", "rows", *_round(["accuracy", "balanced_accuracy", "macro_f1", "precision_UP", "recall_UP", "f1_DOWN"]), "support_FLAT")


def threshold_pr(spark, sf):
    out = rank.threshold_metrics(v.predictions(spark, sf), keys=["label_source"], label="settled_yes", prob="p_up", thresholds=(0.55, 0.65, 0.75, 0.85))
    return out.select("label_source", "threshold", "rows", "signals", *_round(["precision", "recall"]))


DIST = ["count", "null_count", "unique_count", "min", "max", "mean", "std", "p01", "p05", "p25", "p50", "p75", "p95", "p99"]


def dist_summary_nearest(spark, sf):
    p = v.predictions(spark, sf).withColumn("maybe", F.when(F.col("event_id") % 4 != 0, F.col("p_up")))
    out = distribution(p, keys=["label_source"], fields=["p_up", "yes_ask", "maybe"])
    return out.select("label_source", "field", *[F.round(c, 6).alias(c) if c not in ("count", "null_count", "unique_count") else c for c in DIST])


def quartiles_linear(spark, sf):
    out = group_quantiles(v.events(spark, sf), keys=["event_type"], value="value", quantiles={"p25": 0.25, "median": 0.5, "p75": 0.75, "p999": 0.999})
    return out.select("event_type", *_round(["p25", "median", "p75", "p999"]))


def bucket_rates(spark, sf):
    p = v.predictions(spark, sf).withColumn("edge_bucket", fn.bucket_label(F.col("p_up") - F.col("yes_ask"), fn.EDGE, "unbucketed"))
    out = ql.rates(p, keys=["edge_bucket"], label="settled_yes", entity="market_id")
    return out.select("edge_bucket", "rows", "entities", *_round(["rate"]), fn.bucket_rank("edge_bucket", fn.EDGE).alias("bucket_rank"))


def monotonic_check(spark, sf):
    d = ql.decile_rates(v.predictions(spark, sf), keys=["label_source"], prob="yes_ask", label="settled_yes", tie="event_id")
    return ql.is_monotonic(d, keys=["label_source"], order="decile", value="prob_mean")


def top_decile_markout(spark, sf):
    p = v.predictions(spark, sf).withColumn("markout", F.round((F.col("settled_yes") - F.col("yes_ask")) / 10, 6))
    out = ql.top_decile(p, prob="p_up", markout="markout")
    return out.select("prob_cutoff", "rows", *_round(["mean_markout", "win_rate", "gt_1c_rate", "p25", "p75", "median"]))


def label_audit(spark, sf):
    p = v.predictions(spark, sf).withColumn("markout", F.round((F.col("settled_yes") - F.col("yes_ask")) / 10, 6))
    out = ql.label_audit(p, keys=["date"], value="markout")
    return out.select("date", "rows", *_round(["mean", "positive_rate", "negative_rate", "abs_gt_1c_rate", "abs_gt_2c_rate", "p10", "p50", "p90"]))


def label_distribution(spark, sf):
    p = v.predictions(spark, sf).withColumns({"l1": fn.three_way(F.col("p_up") - 0.5, 0.1), "l2": fn.three_way(F.col("yes_ask") - 0.5, 0.2)})
    return ql.label_distribution(p, ["l1", "l2", "label_source"])


def null_ratios(spark, sf):
    e = v.events(spark, sf)
    df = e.select("event_id", F.when(F.col("k") % 3 == 0, F.col("value")).alias("some"), F.when(F.col("event_type") == "view", F.col("k")).alias("few"))
    return ql.null_ratios(df).select("column", "null_count", F.round("null_ratio", 6).alias("null_ratio"))


def non_finite_counts(spark, sf):
    e = v.events(spark, sf)
    df = e.select(
        F.when(F.col("k") == 0, F.lit(float("nan"))).when(F.col("k") == 1, F.lit(float("inf"))).otherwise(F.col("value")).alias("a"),
        F.col("value").alias("b"),
    )
    return ql.non_finite(df, ["a", "b"])


def split_leakage(spark, sf):
    e = v.table(spark, sf, "events").withColumn("split", F.when(F.col("ts") < F.lit("2024-01-29").cast("timestamp"), "train").otherwise("test"))
    return ql.split_leakage(e, entity="user_id")


def coverage_after_max(spark, sf):
    e = v.table(spark, sf, "events")
    s = e.select(F.col("user_id").alias("market_id"), F.col("ts").alias("sample_ts"))
    series = e.where("event_type = 'signup' AND ts < TIMESTAMP '2024-01-20'").select(F.col("ts").alias("sample_ts"))
    out = ql.coverage_after(s, series)
    return out.select("market_id", "rows", "rows_after", v.naive("first_after"), v.naive("last_after"))


def coverage_summary(spark, sf):
    e = v.table(spark, sf, "events")
    s = e.select(F.col("user_id").alias("market_id"), F.col("ts").alias("sample_ts"))
    series = e.where("event_type = 'signup' AND ts < TIMESTAMP '2024-01-20'").select(F.col("ts").alias("sample_ts"))
    return ql.coverage_summary(ql.coverage_after(s, series)).select("rows_after", "entities_after", F.round("ratio_after", 6).alias("ratio_after"))


def market_variability(spark, sf):
    out = ql.market_variability(v.predictions(spark, sf), values=["p_up", "yes_ask"])
    return out.select("market_id", "rows", v.naive("start_ts"), *_round(["p_up_range", "p_up_std", "yes_ask_min", "yes_ask_max"]), "p_up_unique", "yes_ask_unique")


def _quotes(spark, sf):
    return stage(cq.market_silver_frame(spark, sf, 14_400), "market_silver")


def quote_flags(spark, sf):
    return ql.quote_flags(_quotes(spark, sf)).select(
        *_round(["yes_mid_half_rate", "no_mid_half_rate", "yes_bid_floor_rate", "no_bid_floor_rate", "yes_ask_ceiling_rate", "no_ask_ceiling_rate", "pair_mid_sum_one_rate"])
    )


def quote_verdict(spark, sf):
    s = _quotes(spark, sf)
    return ql.quote_verdict(ql.quote_flags(s), ql.market_variability(s, values=["yes_mid"]))


def label_comparison(spark, sf):
    p = v.predictions(spark, sf)
    proxy = p.groupBy("market_id").agg(F.max_by("settled_yes", F.struct("sample_ts", "event_id")).alias("settled_yes_proxy"))
    real = p.where("label_source = 'real'").groupBy("market_id").agg(F.min_by("settled_yes", F.struct("sample_ts", "event_id")).alias("settled_yes_real"))
    return ql.label_comparison(proxy, real)


def source_timeline(spark, sf):
    e = v.table(spark, sf, "events").select(F.col("user_id").alias("market_id"), "ts", F.col("event_id").alias("row_id"), "event_type", "value")
    out = ql.timeline({t: e.where(F.col("event_type") == t).drop("event_type") for t in ("view", "click", "error")}, entity="market_id", per_source=4, total=9)
    return out.select("market_id", F.col("position").cast("bigint").alias("position"), "source", v.naive("ts"), "row_id", "value")


def first_last_value(spark, sf):
    return ql.first_last(v.table(spark, sf, "events"), entity="user_id", ts="ts", tie="event_id", value="value")


def nearest_targets(spark, sf):
    out = ql.nearest_rows(
        v.predictions(spark, sf), entity="market_id", value="time_to_expiry_seconds", targets=(30, 20, 10, 0), tie="event_id",
        columns=["event_id", "time_to_expiry_seconds", "p_up"], at_most=60,
    )
    return out


def group_summary(spark, sf):
    p = v.predictions(spark, sf).withColumn("m", F.when(F.col("event_id") % 5 != 0, F.col("market_id")))
    out = ql.group_summary(p, keys=["label_source"], entity="m", ts="sample_ts")
    return out.select("label_source", "rows", "entities", v.naive("first_ts"), v.naive("last_ts"))


def run_diagnostics(spark, sf):
    p = v.predictions(spark, sf).withColumnRenamed("label_source", "run_id")
    out = ql.run_diagnostics(p)
    return out.select("run_id", "inferences", "max_p_up", "max_p_down", *_round(["p_up_p50", "p_up_p90", "p_up_p99", "p_down_p95"]))


def daily_report(spark, sf):
    """Signals and results per day, source and time-left bucket."""
    p = v.predictions(spark, sf).withColumn("pnl", F.col("settled_yes") - F.col("yes_ask"))
    return p.groupBy("date", "label_source", "tte_bucket").agg(
        F.count("*").alias("signals"), F.max("p_up").alias("max_p_up"), F.round(F.avg("pnl"), 6).alias("avg_pnl"),
        F.round(F.sum("pnl"), 6).alias("total_pnl"), F.round(F.avg((F.col("pnl") > 0).cast("double")), 6).alias("win_rate"),
    )


def balanced_examples(spark, sf):
    p = v.predictions(spark, sf)
    m = p.groupBy("market_id").agg(
        F.min_by("settled_yes", F.struct("sample_ts", "event_id")).alias("settled_yes"),
        F.count_distinct("p_up").alias("spread"), F.round(F.avg(F.abs(F.col("p_up") - F.col("yes_ask"))), 6).alias("disagreement"),
    )
    out = pick.balanced_examples(m, label="settled_yes", entity="market_id", spread="spread", disagreement="disagreement", n=12)
    return out.select(F.col("position").cast("bigint").alias("position"), "market_id", "settled_yes", "spread", "disagreement")


def seeded_sample(spark, sf):
    return pick.seeded_sample(v.predictions(spark, sf).select("event_id", "settled_yes"), keys=["settled_yes"], id_col="event_id", k=10, seed=7)


def active_markets(spark, sf):
    m = v.markets(spark, sf)
    out = pick.active_at(m, now="2024-01-02 12:00:00", lookback_seconds=3600, lookahead_seconds=86_400, limit=20)
    return out.select("market_id", v.naive("market_start_ts"), v.naive("market_end_ts"))


def _windows(spark, sf):
    p = v.predictions(spark, sf).where("p_up >= 0.8").withColumn("cfg", F.col("label_source"))
    return ql.replay_windows(p, group="cfg", score="p_up", per_group=20, before_s=14_400, after_s=21_600)


def replay_windows(spark, sf):
    return _windows(spark, sf).select("cfg", F.col("rank").cast("bigint").alias("rank"), "event_id", "p_up", v.naive("start_ts"), v.naive("end_ts"))


def interval_windows(spark, sf):
    """Samples inside the replay windows of their market."""
    w = _windows(spark, sf).select("market_id", "window_id", "start_ts", "end_ts", F.col("event_id").alias("center_id"))
    rows = v.predictions(spark, sf).select("event_id", "market_id", "sample_ts")
    hit = ql.rows_in_windows(rows, w, cell_seconds=7200).join(w.select("window_id", "center_id"), "window_id")
    return hit.select("center_id", "event_id", v.naive("sample_ts"))


def _gate_rows(spark, sf):
    p = v.predictions(spark, sf)
    e = F.col("event_id")
    return p.select(
        "event_id", "market_id", "sample_ts", (e % 11 == 0).alias("quote_bad"), "time_to_expiry_seconds",
        (F.col("yes_ask") + F.col("no_ask")).alias("pair_ask_sum"), (e % 7).cast("double").alias("update_age"),
        F.when(e % 13 != 0, F.col("quote_age_seconds")).alias("yes_quote_age"), (e % 5).cast("double").alias("no_quote_age"),
        F.col("p_up").alias("probability"), F.when(e % 17 != 0, (e % 6) / 100).alias("spread"), (e % 40).cast("double").alias("ask_depth"),
        "yes_ask",
    )


RULES = gates.SignalRules("base", threshold=0.3, min_tte=20, max_tte=280, max_pair_ask_sum=1.03, max_update_age=5, max_quote_age=8,
                          max_spread=0.04, min_ask_depth=4, max_depth_fraction=0.5, order_size=6, min_edge=0.4)


def gate_first_reason(spark, sf):
    rows = _gate_rows(spark, sf).withColumn("in_cooldown", F.col("event_id") % 3 == 0)
    rows = rows.withColumn("reject_reason", gates.first_reason(gates.signal_rules(RULES, cooldown=True)))
    return rows.select("event_id", "reject_reason")


def gate_histogram(spark, sf):
    rows = _gate_rows(spark, sf).withColumn("reject_reason", gates.first_reason(gates.signal_rules(RULES)))
    return gates.rejection_histogram(rows)


def gate_all_reasons(spark, sf):
    e = F.col("event_id")
    o = gates.OrderRules()
    rows = _gate_rows(spark, sf).select(
        "event_id", F.when(e % 19 != 0, e.cast("string")).alias("signal_id"),
        F.when(e % 3 == 0, "UP").when(e % 3 == 1, "DOWN").otherwise("SIDEWAYS").alias("direction"),
        F.when(e % 23 != 0, (e % 50) - 8).cast("double").alias("signal_age"), "time_to_expiry_seconds",
        F.when(e % 29 != 0, F.col("market_id")).alias("asset_id"), F.when(e % 31 != 0, F.col("yes_ask")).alias("ask"),
        (e % 9).cast("double").alias("fill"), "spread", (e % 37 == 0).alias("seen_before"), (e % 41 < 4).alias("side_accepted"),
        (e % 43).alias("decisions_last_hour"),
    )
    rows = rows.withColumns(ft.limit_order("ask", o.target_shares, offset=o.limit_offset, low=o.min_limit, high=o.max_limit))
    return rows.select("event_id", gates.all_reasons(gates.order_rules(o, with_history=True)).alias("reasons"), *_round(["limit_price", "notional"]))


def _feature_rows(spark, sf):
    e = v.events(spark, sf)
    k, x = F.col("k").cast("double"), F.col("value") / 500
    return e.select(
        "event_id", (k * 5).alias("time_to_expiry_seconds"), (500 - k * 5).alias("time_elapsed_seconds"),
        x.alias("yes_bid"), (x + 0.02).alias("yes_ask"), (x + 0.01).alias("yes_mid"), F.lit(0.02).alias("yes_spread"),
        (0.9 - x).alias("no_bid"), (0.95 - x).alias("no_ask"), (0.925 - x).alias("no_mid"), F.lit(0.05).alias("no_spread"),
        (x * 0.9 + 0.05).alias("formula_p_yes"), (x + 0.02 + 0.95 - x).alias("pair_ask_sum"), F.lit(0.9).alias("pair_bid_sum"), F.lit(0.935).alias("pair_mid_sum"),
        k.alias("yes_bid_depth"), (k + 3).alias("yes_ask_depth"), (100 - k).alias("no_bid_depth"), (k * 2).alias("no_ask_depth"),
        (x / 10).alias("yes_mid_change_1s"), (-x / 10).alias("no_mid_change_1s"), (x / 5).alias("yes_mid_change_5s"), F.lit(0.01).alias("no_mid_change_5s"),
        *[(x * s / 100 - 0.01).alias(f"ref_return_{s}s") for s in (1, 5, 10, 30)], F.when(F.col("k") % 10 != 0, (k + 1) / 1000).alias("ref_vol_60s"),
        *[(k / 100 - s / 50).alias(f"ref_imbalance_{s}s") for s in (1, 5, 30)], (k / 50 - 1).alias("ref_depth_imbalance"),
        F.when(F.col("k") % 4 != 0, k).alias("yes_quote_age_seconds"), F.when(F.col("k") % 6 != 0, k / 2).alias("no_quote_age_seconds"),
    )


_FLAGS = [n for n in ft.DERIVED_FEATURES if n.startswith("tte_le_")]
FEATS = [n for n in ft.DERIVED_FEATURES if n not in _FLAGS]


def derived_features(spark, sf):
    out = ft.derived_features(_feature_rows(spark, sf))
    return out.select("event_id", *_FLAGS, *_round(FEATS, 8))


_PER_VOL = [n for n in FEATS if "vol" in n]


def derived_features_live(spark, sf):
    out = ft.derived_features(_feature_rows(spark, sf), live=True)
    rest = [n for n in FEATS if n not in _PER_VOL]
    # divided by almost nothing where volatility is missing: compared in millions
    return out.select("event_id", *_FLAGS, *_round(rest, 8), *[F.round(F.col(n) / 1e6, 8).alias(n) for n in _PER_VOL])


def implied_probabilities(spark, sf):
    out = ft.market_probabilities(_feature_rows(spark, sf).select("event_id", "yes_bid", "yes_ask", "yes_mid", "no_mid", "formula_p_yes"))
    edges = ft.cost_adjusted_edges("formula_p_yes", "yes_ask", F.lit(0.5), yes_full=F.col("event_id") % 2 == 0, no_full=F.lit(True))
    return out.select("event_id", *_round(["p_market_mid", "p_market_norm", "p_market_ba", "inv_yes_mid", "inv_formula_p_yes"]),
                      *[F.round(c, 6).alias(n) for n, c in edges.items()])


QUERIES = {
    n: f for n, f in list(globals().items())
    if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")
}


def _r(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def _metrics(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    both = f"PARTITION BY {keys + ', ' if keys else ''}pc"
    sel = keys + ", " if keys else ""
    return f"""(SELECT {sel}count(*) AS rows, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc,
      avg(-(y * ln(pc) + (1 - y) * ln(1 - pc))) AS logloss, avg((pc - y) * (pc - y)) AS brier, avg(CASE WHEN (pc >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy_0p5
      FROM (SELECT *, rank() OVER ({part} ORDER BY pc) + (count(*) OVER ({both}) - 1) / 2.0 AS r FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS pc FROM ({source})))
      {'GROUP BY ' + keys if keys else ''})"""


_nearest = lambda c, q: f"{c}[CAST(floor((len({c}) - 1) * CAST({q} AS DOUBLE) + 0.5) AS BIGINT) + 1]"
_CLS = "CASE WHEN {c} > 0.66 THEN 'UP' WHEN {c} < 0.33 THEN 'DOWN' ELSE 'FLAT' END"
CLASSES = f"{v.PRED}, c AS (SELECT tte_bucket, {_CLS.format(c='p_up')} AS predicted, {_CLS.format(c='yes_ask')} AS actual FROM pred)"
_EDGE_CASE = "CASE " + " ".join(
    f"WHEN {'true' if lo is None else '{e} >= ' + str(lo)} AND {'true' if hi is None else '{e} < ' + str(hi)} THEN '{t}'" for lo, hi, t in fn.EDGE
) + " END"
_EDGE_RANK = "CASE edge_bucket " + " ".join(f"WHEN '{t}' THEN {i}" for i, (_, _, t) in enumerate(fn.EDGE)) + " END"
MARK = f"{v.PRED}, m AS (SELECT *, round((settled_yes - yes_ask) / 10, 6) AS markout FROM pred)"
GATE = f"""{v.PRED}, g AS (SELECT event_id, event_id % 11 = 0 AS bad, time_to_expiry_seconds AS tte, yes_ask + no_ask AS s, event_id % 7 AS ua, CASE WHEN event_id % 13 <> 0 THEN quote_age_seconds END AS ya,
   event_id % 5 AS na, p_up, CASE WHEN event_id % 17 <> 0 THEN (event_id % 6) / 100.0 END AS sp, event_id % 40 AS d FROM pred),
 r AS (SELECT event_id, CASE WHEN bad THEN 'quote_stale' WHEN tte < 20 THEN 'tte_too_low' WHEN tte > 280 THEN 'tte_too_high' WHEN s > 1.03 THEN 'pair_ask_sum_too_high' WHEN ua > 5 THEN 'pm_update_too_old'
   WHEN ya IS NULL OR ya > 8 OR na > 8 THEN 'quote_age_too_old' WHEN p_up < 0.3 THEN 'probability_below_threshold' WHEN sp IS NULL OR sp > 0.04 THEN 'spread_too_wide' WHEN d < 4 THEN 'ask_depth_too_low'
   WHEN d * 0.5 < 6 THEN 'order_too_large_for_depth' WHEN p_up < 0.4 THEN 'cost_adjusted_edge_too_low' END AS reject_reason FROM g)"""
FEAT = f"""{v.EV}, f AS (SELECT event_id, k, value / 500 AS x, k * 5.0 AS tte, value / 500 * 0.9 + 0.05 AS fp, CASE WHEN k % 10 <> 0 THEN (k + 1) / 1000.0 END AS vol,
   CASE WHEN k % 4 <> 0 THEN CAST(k AS DOUBLE) END AS ya, CASE WHEN k % 6 <> 0 THEN k / 2.0 END AS na FROM ev)"""


def _features_sql(vol: str, clamp: str) -> str:
    def log1p(x):
        return f"ln(1 + {clamp.format(x)})"

    def per_vol(s):
        return f"(x * {s} / 100 - 0.01) / ({vol} + 1e-9)"

    made = {
        **{n: f"CAST(tte <= {n.rsplit('_', 1)[1]} AS INTEGER)" for n in _FLAGS},
        "log_tte": log1p("tte"), "time_frac_elapsed": "(500 - tte) / 500.0",
        "yes_ask_minus_formula_p_yes": "x + 0.02 - fp", "no_ask_minus_formula_p_no": "0.95 - x - (1.0 - fp)",
        "abs_formula_gap_yes_mid": "abs(fp - (x + 0.01))", "pair_ask_overround": "x + 0.02 + 0.95 - x - 1.0",
        "pair_bid_underround": "1.0 - 0.9::DOUBLE", "pair_mid_sum_excess": "0.935::DOUBLE - 1.0",
        "yes_depth_skew_abs": "3.0::DOUBLE", "no_depth_skew_abs": "(k * 2 - (100 - k))::DOUBLE",
        "log_yes_ask_bid_depth_ratio": log1p("((k + 3) / (k + 1e-9))"), "log_no_ask_bid_depth_ratio": log1p("((k * 2) / (100 - k + 1e-9))"),
        "sum_side_spreads": "0.07::DOUBLE", "spread_diff_yes_no": "-0.03::DOUBLE", "yes_no_mid_diff": "x + 0.01 - (0.925 - x)",
        "pm_mid_change_1s_rel": "x / 10 + x / 10", "pm_mid_change_5s_rel": "x / 5 - 0.01",
        **{f"btc_ret{s}_x_logtte": f"(x * {s} / 100 - 0.01) * {log1p('tte')}" for s in (1, 5, 10, 30)},
        **{f"btc_ret{s}_vol_adj": per_vol(s) for s in (5, 10, 30)},
        **{f"btc_ret_{a}m{b}_reversal": f"(x * {a} / 100 - 0.01) - (x * {b} / 100 - 0.01)" for a, b in ((1, 5), (5, 30))},
        "btc_trade_imb_1m5": "5 / 50.0::DOUBLE - 1 / 50.0", "btc_trade_imb_5m30": "30 / 50.0::DOUBLE - 5 / 50.0",
        "btc_depth_x_trade_imb5": "(k / 50.0 - 1) * (k / 100.0 - 0.1)",
        "formula_yes_edge_x_btc_ret5_vol": f"(fp - (x + 0.02)) * ({per_vol(5)})", "formula_no_edge_x_btc_ret5_vol": f"(1.0 - fp - (0.95 - x)) * -({per_vol(5)})",
        "sum_quote_age": "coalesce(ya, 999) + coalesce(na, 999)",
        "max_quote_age": "CASE WHEN ya IS NULL THEN na WHEN na IS NULL THEN ya ELSE greatest(ya, na) END",
    }
    columns = ", ".join(f"{sql} AS {name}" for name, sql in made.items())
    live = "greatest" in clamp
    rounded = ", ".join(f"round({n}{' / 1e6' if live and n in _PER_VOL else ''}, 8) AS {n}" for n in FEATS)
    return f"WITH {FEAT}, g AS (SELECT event_id, {columns} FROM f) SELECT event_id, {', '.join(_FLAGS)}, {rounded} FROM g"


WINDOWS = f"""{v.PRED}, wr AS (SELECT *, label_source AS cfg, row_number() OVER (PARTITION BY label_source ORDER BY p_up DESC, date, market_id, sample_ts, event_id) AS rank FROM pred WHERE p_up >= 0.8),
 win AS (SELECT *, sample_ts - INTERVAL 14400 SECOND AS start_ts, sample_ts + INTERVAL 21600 SECOND AS end_ts FROM wr WHERE rank <= 20)"""
_LATE = "(SELECT max(ts) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-20')"

ORACLES = {
    "auc_by_group": f"""WITH {v.PRED}, l AS (SELECT tte_bucket, 'p_up' AS probability, settled_yes AS y, p_up AS p FROM pred UNION ALL SELECT tte_bucket, 'yes_ask', settled_yes, yes_ask FROM pred UNION ALL SELECT tte_bucket, 'yes_bid', settled_yes, yes_bid FROM pred)
      SELECT tte_bucket, probability, rows, {_r(['auc', 'logloss', 'brier', 'accuracy_0p5'])} FROM {_metrics('SELECT * FROM l', 'tte_bucket, probability')}""",
    "logloss_brier": f"WITH {v.PRED} SELECT rows, {_r(['auc', 'logloss', 'brier', 'accuracy_0p5'])} FROM {_metrics('SELECT settled_yes AS y, p_up AS p FROM pred', '')}",
    "inversion_check": f"""WITH {v.PRED}, a AS {_metrics('SELECT label_source, settled_yes AS y, p_up AS p FROM pred', 'label_source')}, b AS {_metrics('SELECT label_source, settled_yes AS y, 1 - p_up AS p FROM pred', 'label_source')}
      SELECT label_source, round(a.auc, 6) AS auc, round(b.auc, 6) AS inverted_auc, round(b.auc - a.auc, 6) AS difference, b.auc - a.auc > 0.05 AS possible_inversion FROM a JOIN b USING (label_source)""",
    "calibration_bins": f"""WITH {v.PRED}, b AS (SELECT *, CAST(least(9, greatest(0, floor(p_up * 10))) AS INTEGER) AS prob_bin FROM pred)
      SELECT label_source, prob_bin, CASE WHEN prob_bin < 9 THEN printf('[%.1f, %.1f)', prob_bin / 10.0, (prob_bin + 1) / 10.0) ELSE '[0.9, 1.0]' END AS prob_bucket, count(*) AS rows, round(avg(p_up), 6) AS mean_pred, round(avg(settled_yes), 6) AS observed_rate FROM b GROUP BY 1, 2""",
    "deciles_floor": f"""WITH {v.PRED}, i AS (SELECT *, row_number() OVER (ORDER BY p_up, event_id) - 1 AS idx, count(*) OVER () AS n FROM pred)
      SELECT CAST(least(9, idx * 10 // n) + 1 AS INTEGER) AS decile, count(*) AS rows, min(p_up) AS prob_min, max(p_up) AS prob_max, round(avg(p_up), 6) AS prob_mean, round(avg(settled_yes), 6) AS rate FROM i GROUP BY 1""",
    "deciles_cuts": f"""WITH {v.PRED}, i AS (SELECT *, row_number() OVER (PARTITION BY label_source ORDER BY p_up, event_id) - 1 AS idx, count(*) OVER (PARTITION BY label_source) AS n FROM pred),
      d AS (SELECT i.*, (SELECT max(d) FROM (SELECT unnest(range(10)) AS d) WHERE d * n // 10 <= idx) + 1 AS decile FROM i)
      SELECT label_source, CAST(decile AS INTEGER) AS decile, count(*) AS rows, min(p_up) AS prob_min, max(p_up) AS prob_max, round(avg(p_up), 6) AS prob_mean, round(avg(settled_yes), 6) AS rate FROM d GROUP BY 1, 2""",
    "decile_heavy_ties": f"""WITH {v.PRED}, i AS (SELECT event_id, row_number() OVER (ORDER BY CASE WHEN p_up < 0.6 THEN 0.5 ELSE p_up END, event_id) - 1 AS idx, count(*) OVER () AS n FROM pred)
      SELECT event_id, CAST(least(6, idx * 7 // n) + 1 AS INTEGER) AS decile FROM i""",
    "confusion_counts": f"WITH {CLASSES} SELECT actual, predicted, count(*) AS rows FROM c GROUP BY 1, 2",
    "confusion_metrics": f"""WITH {CLASSES}, t AS (SELECT tte_bucket, x.c AS cls, count(*) FILTER (actual = x.c AND predicted = x.c) AS tp, count(*) FILTER (actual = x.c) AS act, count(*) FILTER (predicted = x.c) AS prd
        FROM c, (VALUES ('DOWN'), ('FLAT'), ('UP')) x(c) GROUP BY 1, 2),
      s AS (SELECT *, CASE WHEN prd > 0 THEN tp / prd ELSE 0.0 END AS pr, CASE WHEN act > 0 THEN tp / act ELSE 0.0 END AS rc, CASE WHEN act + prd > 0 THEN 2.0 * tp / (act + prd) ELSE 0.0 END AS f1 FROM t)
      SELECT tte_bucket, CAST(sum(act) AS BIGINT) AS rows, round(sum(tp) / sum(act), 6) AS accuracy, round(sum(rc) / count(*) FILTER (act > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1,
        round(max(pr) FILTER (cls = 'UP'), 6) AS precision_UP, round(max(rc) FILTER (cls = 'UP'), 6) AS recall_UP, round(max(f1) FILTER (cls = 'DOWN'), 6) AS f1_DOWN, max(act) FILTER (cls = 'FLAT') AS support_FLAT FROM s GROUP BY 1""",
    "threshold_pr": f"""WITH {v.PRED} SELECT label_source, threshold, count(*) AS rows, count(*) FILTER (p_up >= threshold) AS signals,
        round(CASE WHEN count(*) FILTER (p_up >= threshold) > 0 THEN count(*) FILTER (p_up >= threshold AND settled_yes = 1) / count(*) FILTER (p_up >= threshold) ELSE 0.0 END, 6) AS precision,
        round(count(*) FILTER (p_up >= threshold AND settled_yes = 1) / sum(settled_yes), 6) AS recall
      FROM pred, (VALUES (CAST(0.55 AS DOUBLE)), (0.65), (0.75), (0.85)) t(threshold) GROUP BY 1, 2""",
    "dist_summary_nearest": f"""WITH {v.PRED}, l AS (SELECT label_source, 'p_up' AS field, p_up AS x FROM pred UNION ALL SELECT label_source, 'yes_ask', yes_ask FROM pred UNION ALL SELECT label_source, 'maybe', CASE WHEN event_id % 4 <> 0 THEN p_up END FROM pred),
      a AS (SELECT label_source, field, count(*) AS count, count(*) - count(x) AS null_count, count(DISTINCT x) + max(CAST(x IS NULL AS INTEGER)) AS unique_count, min(x) AS mn, max(x) AS mx, avg(x) AS mean, stddev_samp(x) AS std, list_sort(list(x) FILTER (x IS NOT NULL)) AS s FROM l GROUP BY 1, 2)
      SELECT label_source, field, count, null_count, unique_count, round(mn, 6) AS min, round(mx, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std,
        {", ".join(f"round({_nearest('s', q)}, 6) AS {n}" for n, q in (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))} FROM a""",
    "quartiles_linear": "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY 1",
    "bucket_rates": f"""WITH {v.PRED}, b AS (SELECT *, {_EDGE_CASE.replace('{e}', '(p_up - yes_ask)')} AS edge_bucket FROM pred)
      SELECT edge_bucket, count(*) AS rows, count(DISTINCT market_id) AS entities, round(avg(settled_yes), 6) AS rate, {_EDGE_RANK} AS bucket_rank FROM b GROUP BY 1""",
    "monotonic_check": f"WITH {v.PRED} SELECT DISTINCT label_source, CAST(10 AS BIGINT) AS values, true AS monotonic FROM pred",
    "top_decile_markout": f"""WITH {MARK}, q AS (SELECT list_sort(list(p_up)) AS s FROM m), cut AS (SELECT {_nearest('s', 0.9)} AS c FROM q), t AS (SELECT m.*, c FROM m, cut WHERE p_up >= c),
      a AS (SELECT max(c) AS prob_cutoff, count(*) AS rows, avg(markout) AS mean_markout, avg(CAST(markout > 0 AS INTEGER)) AS win_rate, avg(CAST(markout > 0.01 AS INTEGER)) AS gt_1c_rate, list_sort(list(markout)) AS s, quantile_cont(markout, 0.5) AS median FROM t)
      SELECT prob_cutoff, rows, {_r(['mean_markout', 'win_rate', 'gt_1c_rate', 'median'])}, round({_nearest('s', 0.25)}, 6) AS p25, round({_nearest('s', 0.75)}, 6) AS p75 FROM a""",
    "label_audit": f"""WITH {MARK}, a AS (SELECT date, count(*) AS rows, avg(markout) AS mean, avg(CAST(markout > 0 AS INTEGER)) AS positive_rate, avg(CAST(markout < 0 AS INTEGER)) AS negative_rate,
        avg(CAST(abs(markout) > 0.01 AS INTEGER)) AS abs_gt_1c_rate, avg(CAST(abs(markout) > 0.02 AS INTEGER)) AS abs_gt_2c_rate, list_sort(list(markout)) AS s FROM m GROUP BY 1)
      SELECT date, rows, {_r(['mean', 'positive_rate', 'negative_rate', 'abs_gt_1c_rate', 'abs_gt_2c_rate'])}, round({_nearest('s', 0.1)}, 6) AS p10, round({_nearest('s', 0.5)}, 6) AS p50, round({_nearest('s', 0.9)}, 6) AS p90 FROM a""",
    "label_distribution": f"""WITH {v.PRED}, l AS (SELECT 'l1' AS label, CASE WHEN p_up - 0.5 > 0.1 THEN 'UP' WHEN p_up - 0.5 < -0.1 THEN 'DOWN' ELSE 'FLAT' END AS value FROM pred
        UNION ALL SELECT 'l2', CASE WHEN yes_ask - 0.5 > 0.2 THEN 'UP' WHEN yes_ask - 0.5 < -0.2 THEN 'DOWN' ELSE 'FLAT' END FROM pred UNION ALL SELECT 'label_source', label_source FROM pred) SELECT label, value, count(*) AS rows FROM l GROUP BY 1, 2""",
    "null_ratios": f"""WITH {v.EV}, d AS (SELECT 'event_id' AS "column", CAST(0 AS BIGINT) AS null_count, count(*) AS n FROM ev UNION ALL SELECT 'some', count(*) FILTER (k % 3 <> 0), count(*) FROM ev UNION ALL SELECT 'few', count(*) FILTER (event_type <> 'view'), count(*) FROM ev)
      SELECT "column", null_count, round(null_count / n, 6) AS null_ratio FROM d""",
    "non_finite_counts": f"""WITH {v.EV} SELECT 'a' AS "column", count(*) FILTER (k IN (0, 1)) AS non_finite FROM ev UNION ALL SELECT 'b', CAST(0 AS BIGINT)""",
    "split_leakage": "SELECT user_id, CAST(2 AS BIGINT) AS split_count FROM events GROUP BY 1 HAVING min(ts) < TIMESTAMP '2024-01-29' AND max(ts) >= TIMESTAMP '2024-01-29'",
    "coverage_after_max": f"""SELECT user_id AS market_id, count(*) AS rows, count(*) FILTER (ts > {_LATE}) AS rows_after, min(ts) FILTER (ts > {_LATE}) AS first_after, max(ts) FILTER (ts > {_LATE}) AS last_after FROM events GROUP BY 1""",
    "coverage_summary": f"""SELECT count(*) FILTER (ts > {_LATE}) AS rows_after, count(DISTINCT CASE WHEN ts > {_LATE} THEN user_id END) AS entities_after, round(count(*) FILTER (ts > {_LATE}) / count(*), 6) AS ratio_after FROM events""",
    "market_variability": f"""WITH {v.PRED} SELECT market_id, count(*) AS rows, min(sample_ts) AS start_ts, round(max(p_up) - min(p_up), 6) AS p_up_range, round(coalesce(stddev_samp(p_up), 0), 6) AS p_up_std,
      round(min(yes_ask), 6) AS yes_ask_min, round(max(yes_ask), 6) AS yes_ask_max, count(DISTINCT p_up) AS p_up_unique, count(DISTINCT yes_ask) AS yes_ask_unique FROM pred GROUP BY 1""",
    "quote_flags": f"""WITH {cq.silver_sql(14400)} SELECT {", ".join(f"round(avg(CAST({c} AS INTEGER)), 6) AS {n}" for n, c in {"yes_mid_half_rate": "yes_mid = 0.5", "no_mid_half_rate": "no_mid = 0.5", "yes_bid_floor_rate": "yes_bid <= 0.01", "no_bid_floor_rate": "no_bid <= 0.01", "yes_ask_ceiling_rate": "yes_ask >= 0.99", "no_ask_ceiling_rate": "no_ask >= 0.99", "pair_mid_sum_one_rate": "pair_mid_sum = 1.0"}.items())} FROM silver2""",
    "quote_verdict": f"""WITH {cq.silver_sql(14400)}, u AS (SELECT market_id, count(DISTINCT yes_mid) + max(CAST(yes_mid IS NULL AS INTEGER)) AS n FROM silver2 GROUP BY 1),
      a AS (SELECT avg(CAST(yes_mid = 0.5 AS INTEGER)) > 0.8 AS a, avg(CAST(no_mid = 0.5 AS INTEGER)) > 0.8 AS b, avg(CAST(yes_bid <= 0.01 AS INTEGER)) > 0.8 AS c, avg(CAST(yes_ask >= 0.99 AS INTEGER)) > 0.8 AS d, (SELECT avg(CAST(n <= 1 AS INTEGER)) > 0.5 FROM u) AS e FROM silver2)
      SELECT a AS yes_mid_half_gt_80, b AS no_mid_half_gt_80, c AS yes_bid_floor_gt_80, d AS yes_ask_ceiling_gt_80, e AS constant_markets_gt_50, NOT (a OR b OR c OR d OR e) AS audit_pass FROM a""",
    "label_comparison": f"""WITH {v.PRED}, p AS (SELECT market_id, arg_max(settled_yes, sample_ts) AS x FROM pred GROUP BY 1), r AS (SELECT market_id, arg_min(settled_yes, sample_ts) AS y FROM pred WHERE label_source = 'real' GROUP BY 1)
      SELECT market_id, x AS settled_yes_proxy, y AS settled_yes_real, CAST(x = y AS INTEGER) AS match FROM p LEFT JOIN r USING (market_id)""",
    "source_timeline": """WITH a AS (SELECT user_id AS market_id, ts, event_id AS row_id, event_type AS source, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('view', 'click', 'error')),
      b AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY ts, source, row_id) AS position FROM a WHERE rn <= 4) SELECT market_id, position, source, ts, row_id, value FROM b WHERE position <= 9""",
    "first_last_value": "SELECT user_id, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1",
    "nearest_targets": f"""WITH {v.PRED}, j AS (SELECT p.*, t.target, row_number() OVER (PARTITION BY market_id, t.target ORDER BY abs(time_to_expiry_seconds - t.target), event_id) AS rn FROM pred p, (VALUES (CAST(30 AS DOUBLE)), (20), (10), (0)) t(target) WHERE time_to_expiry_seconds <= 60)
      SELECT market_id, target, event_id, time_to_expiry_seconds, p_up FROM j WHERE rn = 1""",
    "group_summary": f"""WITH {v.PRED} SELECT label_source, count(*) AS rows, count(DISTINCT CASE WHEN event_id % 5 <> 0 THEN market_id END) + max(CAST(event_id % 5 = 0 AS INTEGER)) AS entities, min(sample_ts) AS first_ts, max(sample_ts) AS last_ts FROM pred GROUP BY 1""",
    "run_diagnostics": f"""WITH {v.PRED} SELECT label_source AS run_id, count(*) AS inferences, max(p_up) AS max_p_up, max(p_down) AS max_p_down, round(quantile_cont(p_up, 0.5), 6) AS p_up_p50, round(quantile_cont(p_up, 0.9), 6) AS p_up_p90,
      round(quantile_cont(p_up, 0.99), 6) AS p_up_p99, round(quantile_cont(p_down, 0.95), 6) AS p_down_p95 FROM pred GROUP BY 1""",
    "daily_report": f"""WITH {v.PRED} SELECT date, label_source, tte_bucket, count(*) AS signals, max(p_up) AS max_p_up, round(avg(settled_yes - yes_ask), 6) AS avg_pnl, round(sum(settled_yes - yes_ask), 6) AS total_pnl,
      round(avg(CAST(settled_yes - yes_ask > 0 AS INTEGER)), 6) AS win_rate FROM pred GROUP BY 1, 2, 3""",
    "balanced_examples": f"""WITH {v.PRED}, m AS (SELECT market_id, arg_min(settled_yes, sample_ts) AS settled_yes, count(DISTINCT p_up) AS spread, round(avg(abs(p_up - yes_ask)), 6) AS disagreement FROM pred GROUP BY 1),
      a AS (SELECT *, CASE settled_yes WHEN 1 THEN 0 ELSE 1 END AS pool, row_number() OVER (PARTITION BY settled_yes ORDER BY spread, disagreement DESC, market_id) AS rk FROM m),
      b AS (SELECT *, 2 AS pool, row_number() OVER (ORDER BY disagreement DESC, market_id) AS rk FROM m),
      u AS (SELECT * FROM a WHERE rk <= 6 UNION ALL SELECT * FROM b WHERE rk <= 24),
      o AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY pool, rk) AS once FROM u), p AS (SELECT *, row_number() OVER (ORDER BY pool, rk) AS position FROM o WHERE once = 1)
      SELECT position, market_id, settled_yes, spread, disagreement FROM p WHERE position <= 12""",
    "seeded_sample": f"""WITH {v.PRED}, r AS (SELECT event_id, settled_yes, row_number() OVER (PARTITION BY settled_yes ORDER BY md5('7|' || event_id)) AS rn FROM pred) SELECT event_id, settled_yes FROM r WHERE rn <= 10""",
    "active_markets": f"""WITH {v.MARKETS} SELECT market_id, market_start_ts, market_end_ts FROM markets WHERE market_end_ts >= TIMESTAMP '2024-01-02 11:00:00' AND market_start_ts <= TIMESTAMP '2024-01-03 12:00:00'
      ORDER BY market_start_ts, market_end_ts, market_id LIMIT 20""",
    "replay_windows": f"WITH {WINDOWS} SELECT cfg, rank, event_id, p_up, start_ts, end_ts FROM win",
    "interval_windows": f"WITH {WINDOWS} SELECT w.event_id AS center_id, p.event_id, p.sample_ts FROM win w JOIN pred p ON p.market_id = w.market_id AND p.sample_ts BETWEEN w.start_ts AND w.end_ts",
    "gate_first_reason": f"WITH {GATE} SELECT event_id, coalesce(reject_reason, CASE WHEN event_id % 3 = 0 THEN 'cooldown' END) AS reject_reason FROM r",
    "gate_histogram": f"WITH {GATE} SELECT reject_reason, count(*) AS rows FROM r WHERE reject_reason IS NOT NULL GROUP BY 1",
    "gate_all_reasons": f"""WITH {v.PRED}, g AS (SELECT event_id, event_id % 19 <> 0 AS has_id, event_id % 3 AS d, CASE WHEN event_id % 23 <> 0 THEN event_id % 50 - 8 END AS age, time_to_expiry_seconds AS tte, event_id % 29 <> 0 AS has_asset,
          CASE WHEN event_id % 31 <> 0 THEN yes_ask END AS ask, event_id % 9 AS fill, CASE WHEN event_id % 17 <> 0 THEN (event_id % 6) / 100.0 END AS sp FROM pred),
      h AS (SELECT *, least(0.99, greatest(0.01, ask + 0.01)) + CASE WHEN ask IS NULL THEN NULL ELSE 0 END AS lp FROM g)
      SELECT event_id, array_to_string(list_filter([CASE WHEN NOT has_id THEN 'missing_signal_id' END, CASE WHEN event_id % 37 = 0 THEN 'duplicate_signal' END, CASE WHEN d = 2 THEN 'bad_direction' END, CASE WHEN age IS NULL THEN 'missing_sample_ts' END, CASE WHEN age > 30 THEN 'signal_too_old' END, CASE WHEN age < -5 THEN 'signal_from_future' END,
          CASE WHEN tte < 30 THEN 'tte_too_low' END, CASE WHEN tte > 900 THEN 'tte_too_high' END, CASE WHEN event_id % 41 < 4 THEN 'market_side_already_accepted' END, CASE WHEN event_id % 43 >= 20 THEN 'hourly_decision_limit' END, CASE WHEN NOT has_asset THEN 'missing_asset_id' END, CASE WHEN ask IS NULL THEN 'missing_effective_ask' END, CASE WHEN ask > 0.9 THEN 'ask_too_high' END, CASE WHEN ask <= 0 THEN 'bad_ask' END,
          CASE WHEN fill + 1e-9 < 6 THEN 'insufficient_depth' END, CASE WHEN sp > 0.05 THEN 'spread_too_wide' END, CASE WHEN lp * 6 < 1 THEN 'notional_below_min' END], lambda x: x IS NOT NULL), ',') AS reasons, round(lp, 6) AS limit_price, round(lp * 6, 6) AS notional FROM h""",
    "derived_features": _features_sql("vol", "{0}"),
    "derived_features_live": _features_sql("coalesce(vol, 0)", "greatest({0}, 0)"),
    "implied_probabilities": f"""WITH {FEAT} SELECT event_id, round(x + 0.01, 6) AS p_market_mid, round((x + 0.01) / (x + 0.01 + (0.925 - x)), 6) AS p_market_norm, round((x + (x + 0.02)) / 2.0, 6) AS p_market_ba, round(1.0 - (x + 0.01), 6) AS inv_yes_mid, round(1.0 - fp, 6) AS inv_formula_p_yes,
      CASE WHEN event_id % 2 = 0 THEN round(fp - (x + 0.02) - 0.07 * (x + 0.02) * (1.0 - (x + 0.02)) - 0.0025, 6) ELSE -999.0 END AS edge_yes, round(1.0 - fp - 0.5 - 0.07 * 0.5 * 0.5 - 0.0025, 6) AS edge_no FROM f""",
}
