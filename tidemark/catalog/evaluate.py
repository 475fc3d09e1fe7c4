"""Queries on signal selection and evaluation over parameter grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import quotes as cq
from tidemark.catalog import views as v
from tidemark.functions import scalars as fn
from tidemark.operators import pick, rank
from tidemark.operators import trades as tr
from tidemark.operators.cooldown import cooldown_thin
from tidemark.plans import evaluate as ev
from tidemark.session import stage

MODES = {"all_signals": 0, "first_signal_per_market_side": None, "cooldown_6h": 21_600, "cooldown_2d": 172_800}
THRESHOLDS = (0.5, 0.7, 0.9)
HORIZONS = (21_600, 86_400)
LATENCIES = (0, 14_400)
TOL = 43_200
COSTS = (0.0, 0.05, 0.1, 0.2, 0.3)
PARAMS = ("direction", "threshold", "exit_horizon_seconds")


def _round(cols, digits=6):
    return [F.round(c, digits).alias(c) for c in cols]


def _sided(spark, sf, threshold=0.5):
    """Signals of both sides."""
    sides = F.array(*[F.struct(F.lit(d).alias("direction"), F.col(c).alias("probability")) for d, c in (("UP", "p_up"), ("DOWN", "p_down"))])
    p = v.predictions(spark, sf).select("event_id", "market_id", "sample_ts", F.inline(sides))
    return p.where(F.col("probability") >= threshold)


def first_signal(spark, sf):
    out = pick.first_per_group(_sided(spark, sf, 0.7), keys=["market_id", "direction"], order=["sample_ts", "event_id"])
    return out.select("market_id", "direction", "event_id", v.naive("sample_ts"))


def cooldown_6h(spark, sf):
    out = cooldown_thin(_sided(spark, sf), keys=["market_id", "direction"], ts="sample_ts", tie="event_id", seconds=21_600)
    return out.select("event_id", "market_id", "direction", v.naive("sample_ts"))


def cooldown_hot_key(spark, sf):
    """All events as one key: the thinning runs in blocks and their steps are linked."""
    e = v.table(spark, sf, "events").select("event_id", "ts", F.lit("all").alias("key"))
    return cooldown_thin(e, keys=["key"], ts="ts", tie="event_id", seconds=3_600).select("event_id", v.naive("ts"))


def _looked(spark, sf):
    p = v.predictions(spark, sf)
    q = p.select("market_id", "sample_ts", "yes_bid", "yes_ask", "no_bid", "no_ask")
    return ev.future_quotes(p, q, horizons_s=HORIZONS, tolerance=TOL, bucket_seconds=5 * 86_400)


def future_quotes(spark, sf):
    out = _looked(spark, sf)
    return out.select(
        "event_id",
        *[F.col("quotes_at")[F.lit(h * 1000).cast("bigint")].getField("yes_bid").alias(f"future_yes_bid_{h}") for h in HORIZONS],
        *[F.col("quotes_at")[F.lit(h * 1000).cast("bigint")].getField("no_ask").alias(f"future_no_ask_{h}") for h in HORIZONS],
    )


def _long(spark, sf):
    return ev.signals(_looked(spark, sf), thresholds=THRESHOLDS, horizons_s=HORIZONS).drop("latency_seconds")


def _trades(spark, sf):
    long = stage(_long(spark, sf), "signals")
    return stage(ev.evaluate_grid(long, modes=MODES, params=PARAMS), "trades")


def signals_long(spark, sf):
    return _long(spark, sf).select(
        "event_id", "direction", "threshold", "exit_horizon_seconds", "signal_probability", "entry_price", "exit_price",
        F.round("pnl", 9).alias("pnl"),
    )


METRICS = ["avg_entry_price", "avg_exit_price", "avg_time_to_expiry", "win_rate", "total_pnl", "avg_pnl", "pnl_std",
           "sharpe_like", "median_pnl", "max_drawdown"]


def threshold_metrics(spark, sf):
    out = ev.grid_metrics(_trades(spark, sf), params=PARAMS)
    return out.select("mode", *PARAMS, "trades", *_round(METRICS))


def grid_cuts(spark, sf):
    out = ev.grid_cuts(_trades(spark, sf), params=PARAMS)
    return out.select("mode", *PARAMS, "cut", "cut_value", "trades", *_round(["total_pnl", "avg_pnl", "win_rate"]))


def _latency_long(spark, sf):
    silver = stage(cq.market_silver_frame(spark, sf, 14_400), "market_silver")
    p = v.predictions(spark, sf).withColumn("time_to_expiry_seconds", F.lit(200_000.0) - F.col("time_to_expiry_seconds"))
    offsets = sorted({*LATENCIES, *[a + h for a in LATENCIES for h in HORIZONS]})
    looked = ev.future_quotes(p, silver, horizons_s=offsets, tolerance=14_400, bucket_seconds=5 * 86_400)
    return ev.signals(looked, thresholds=THRESHOLDS, horizons_s=HORIZONS, latencies_s=LATENCIES)


def latency_grid(spark, sf):
    long = stage(_latency_long(spark, sf), "latency_signals")
    out = tr.simple_metrics(ev.evaluate_grid(long, modes=MODES), keys=["mode", *ev.PARAMS])
    return out.select("mode", *ev.PARAMS, "trades", *_round(["total_pnl", "avg_pnl", "win_rate"]))


def stress_costs(spark, sf):
    out = ev.stress(_trades(spark, sf), costs=COSTS, params=PARAMS)
    return out.select("mode", *PARAMS, "stress_cost", "trades", *_round(["total_pnl", "avg_pnl", "win_rate"]))


def break_even_cost(spark, sf):
    out = ev.break_even_costs(ev.stress(_trades(spark, sf), costs=COSTS, params=PARAMS), params=PARAMS)
    return out.select("mode", *PARAMS, "break_even_cost", "trades", *_round(["avg_pnl"]))


def _executable(spark, sf):
    p = v.predictions(spark, sf)
    yes, no = F.col("settled_yes").cast("double"), (1 - F.col("settled_yes")).cast("double")
    sides = F.array(*[
        F.struct(F.lit(d).alias("direction"), F.col(q).alias("p_model"), F.col(a).alias("entry_price"), x.alias("exit_price"), (x - F.col(a)).alias("pnl"))
        for d, q, a, x in (("UP", "p_up", "yes_ask", yes), ("DOWN", "p_down", "no_ask", no))
    ])
    return p.select(
        "event_id", "market_id", "sample_ts", "date", "tte_bucket", "time_to_expiry_seconds", "settled_yes",
        F.round(F.pmod("event_id", F.lit(13)) / 100, 2).alias("side_spread"),
        F.col("quote_age_seconds").alias("side_quote_age_seconds"), F.inline(sides),
    )


def filter_grid(spark, sf):
    fanned = ev.filter_grid(
        _executable(spark, sf), probabilities=(0.6, 0.8), max_spreads=(0.02, 0.05, None), max_ages=(2.0, 5.0), min_ttes=(10, 60)
    )
    out = tr.simple_metrics(
        tr.select_modes(fanned, params=ev.FILTER_PARAMS, modes={"all_signals": 0, "first_signal_per_market_side": None}),
        keys=["mode", *ev.FILTER_PARAMS],
    )
    return out.select("mode", *ev.FILTER_PARAMS, "trades", *_round(["total_pnl", "avg_pnl", "win_rate"]))


def stability_two_level(spark, sf):
    out = tr.stability(_trades(spark, sf), params=["mode", *PARAMS])
    return out.select(
        "mode", *PARAMS, "trades", "unique_market_count", "positive_date_count", "negative_date_count",
        "positive_tte_bucket_count", "negative_tte_bucket_count",
        *_round(["total_pnl", "avg_pnl", "win_rate", "worst_date_pnl", "best_date_pnl", "top_market_pnl",
                 "avg_trades_per_market", "top_market_pnl_share_abs"]),
    )


def stability_top_markets(spark, sf):
    per = tr.simple_metrics(_trades(spark, sf), keys=["mode", *PARAMS, "market_id"])
    per = per.withColumn("total_pnl", F.round("total_pnl", 6))
    out = pick.top_per_group(per, keys=["mode", *PARAMS], score="total_pnl", tie=["market_id"], k=5)
    return out.select("mode", *PARAMS, "market_id", F.col("rank").cast("bigint").alias("rank"), "trades", "total_pnl", *_round(["avg_pnl", "win_rate"]))


def equity_curve(spark, sf):
    out = tr.equity_curve(_trades(spark, sf), keys=["mode", *PARAMS], ts="sample_ts", tie=["event_id"], value="pnl", points=20)
    return out.select("mode", *PARAMS, "event_id", v.naive("sample_ts"), *_round(["cum_pnl", "drawdown"]))


def drawdown(spark, sf):
    """Drawdown of one long run in time order: all events as one account."""
    e = v.events(spark, sf).select("event_id", "ts", "event_type", (F.col("value") - 50).alias("pnl"))
    out = tr.max_drawdown(e.withColumn("account", F.lit("one")), keys=["account"], ts="ts", tie=["event_id"], value="pnl")
    per = tr.max_drawdown(e.withColumn("account", F.col("event_type")), keys=["account"], ts="ts", tie=["event_id"], value="pnl")
    return out.unionByName(per).select("account", *_round(["max_drawdown"], 4))


def _settlement(spark, sf, maker):
    long = ev.settlement_signals(v.predictions(spark, sf), prob="p_up", thresholds=(0.0, 0.1, 0.3), maker=maker)
    return stage(ev.settlement_trades(long), "settlement")


SETTLE = ["avg_entry_price", "win_rate", "total_pnl", "avg_pnl", "avg_roi", "median_roi", "pnl_std", "sharpe_like",
          "max_drawdown", "avg_time_to_expiry", "min_time_to_expiry", "max_time_to_expiry"]


def settlement_taker(spark, sf):
    out = ev.settlement_metrics(_settlement(spark, sf, False))
    return out.select("mode", "side", "threshold", "trades", *_round(SETTLE, 5))


def settlement_taker_by_source(spark, sf):
    out = ev.settlement_metrics(_settlement(spark, sf, False), by=["label_source", "tte_bucket"])
    return out.select("mode", "side", "threshold", "label_source", "tte_bucket", "trades", *_round(SETTLE, 5))


def settlement_maker(spark, sf):
    out = ev.settlement_metrics(_settlement(spark, sf, True))
    return out.select("mode", "side", "threshold", "trades", *_round(SETTLE, 5))


def markout_sanity(spark, sf):
    p = v.predictions(spark, sf).withColumns(
        {"markout": (F.col("settled_yes") - F.col("yes_ask")) / 10, "yes_spread": F.col("yes_ask") - F.col("yes_bid")}
    )
    out = ev.markout_sanity(p, thresholds=THRESHOLDS, markout="markout", spread="yes_spread", by=["tte_bucket"])
    cols = ["mean_markout", "median_markout", "positive_rate", "gt_half_cent_rate", "gt_1c_rate", "gt_2c_rate",
            "avg_spread", "markout_minus_half_spread", "markout_minus_full_spread"]
    return out.select("direction", "threshold", "tte_bucket", "signals", *_round(cols))


FOLDS = (
    ("fold1", "2024-01-01", "2024-01-10", "2024-01-11", "2024-01-12"),
    ("fold2", "2024-01-01", "2024-01-15", "2024-01-16", "2024-01-17"),
    ("fold3", "2024-01-01", "2024-01-20", "2024-01-21", "2024-03-01"),
)


def walkforward_folds(spark, sf):
    return ev.fold_status(ev.fold_roles(v.predictions(spark, sf), FOLDS), min_rows=20)


def _scored(spark, sf):
    p = v.predictions(spark, sf)
    t = p.withColumns({"entry": F.col("yes_ask"), "exit": F.col("settled_yes").cast("double")})
    t = t.withColumn("gross", F.col("exit") - F.col("entry"))
    net = ev.with_net_pnl(t, gross="gross", entry="entry", exit="exit")
    return net.withColumns({"pred_edge": F.round(F.col("p_up") - F.col("yes_ask"), 6), "pred_prob": F.col("p_up")})


def chosen_thresholds(spark, sf):
    out = ev.choose_threshold(
        _scored(spark, sf), keys=["label_source"], edges=(-0.2, 0.0, 0.2, 0.5), probabilities=(0.3, 0.5, 0.7), min_trades=20
    )
    return out.select("label_source", "edge_threshold", "prob_threshold", F.round("score", 6).alias("score"), "trades")


def net_threshold_pnl(spark, sf):
    out = ev.threshold_pnl(_scored(spark, sf), prob="pred_prob", thresholds=(0.55, 0.65, 0.75), keys=["date"])
    return out.select("date", "threshold", "trades", *_round(["total_pnl", "avg_pnl", "win_rate"]))


def _runs(spark, sf):
    """Windows centred on purchases, and a run's signals from views."""
    p = v.predictions(spark, sf)
    e = v.events(spark, sf).select("event_id", "event_type")
    kind = p.join(e, "event_id")
    windows = kind.where("event_type = 'purchase'").select(
        F.col("event_id").alias("window_id"), "market_id", F.col("sample_ts").alias("center_sample_ts"),
        F.col("p_up").alias("offline_p_up"), F.col("p_down").alias("offline_p_down"),
    )
    sig = kind.where("event_type = 'view'").select(
        F.col("event_id").alias("signal_id"), "market_id", "sample_ts",
        F.when(F.col("event_id") % 2 == 0, "UP").otherwise("DOWN").alias("direction"), "p_up", "p_down",
    )
    return windows, sig, p


def signal_parity(spark, sf):
    windows, sig, _ = _runs(spark, sf)
    out = ev.signal_parity(windows, sig, bucket_seconds=5 * 86_400)
    return out.select(
        "window_id", "market_id", "signal_id", "direction", "signal_found", F.round("abs_ms_from_center", 3).alias("abs_ms"),
        *_round(["abs_diff_p_up", "abs_diff_p_down"]),
    )


def _outcomes(spark, sf):
    _, sig, p = _runs(spark, sf)
    out = sig.select(
        "signal_id", "market_id", "direction", F.col("sample_ts").alias("signal_ts"),
        F.explode(F.array(F.lit(0), F.lit(3_600_000))).alias("entry_latency_ms"), F.lit(86_400).alias("exit_horizon_seconds"),
        F.col("p_up").alias("entry_price"), F.col("p_down").alias("exit_price"), (F.col("p_down") - F.col("p_up")).alias("pnl"),
    )
    return ev.outcome_parity(out, p, bucket_seconds=5 * 86_400)


def outcome_parity(spark, sf):
    return _outcomes(spark, sf).select(
        "signal_id", "entry_latency_ms", *_round(["expected_entry_price", "expected_exit_price", "expected_pnl",
        "abs_diff_entry_price", "abs_diff_exit_price", "abs_diff_pnl"]),
    )


def parity_p95(spark, sf):
    o = stage(_outcomes(spark, sf), "outcomes").withColumn("abs_diff_pnl", F.round("abs_diff_pnl", 6))
    out = ev.parity_summary(o, keys=["direction"], columns=["abs_diff_entry_price", "abs_diff_pnl"])
    return out.select("direction", "rows", *_round(["abs_diff_entry_price_p95", "abs_diff_pnl_p95"]))


def model_summary(spark, sf):
    long = rank.unpivot_probabilities(v.predictions(spark, sf), keep=["settled_yes", "tte_bucket"], columns=["p_up", "yes_ask"])
    m = rank.binary_metrics(long, keys=["tte_bucket", "probability"], label="settled_yes", prob="p")
    out = ev.model_summary(m, model="p_up", baseline="yes_ask", by=["tte_bucket"])
    return out.select("tte_bucket", *_round(["auc_model", "auc_baseline", "auc_delta", "logloss_delta", "brier_delta", "accuracy_0p5_delta"]))


QUERIES = {
    "first_signal": first_signal,
    "cooldown_6h": cooldown_6h,
    "cooldown_hot_key": cooldown_hot_key,
    "future_quotes": future_quotes,
    "signals_long": signals_long,
    "threshold_metrics": threshold_metrics,
    "grid_cuts": grid_cuts,
    "latency_grid": latency_grid,
    "stress_costs": stress_costs,
    "break_even_cost": break_even_cost,
    "filter_grid": filter_grid,
    "stability_two_level": stability_two_level,
    "stability_top_markets": stability_top_markets,
    "equity_curve": equity_curve,
    "drawdown": drawdown,
    "settlement_taker": settlement_taker,
    "settlement_taker_by_source": settlement_taker_by_source,
    "settlement_maker": settlement_maker,
    "markout_sanity": markout_sanity,
    "walkforward_folds": walkforward_folds,
    "chosen_thresholds": chosen_thresholds,
    "net_threshold_pnl": net_threshold_pnl,
    "signal_parity": signal_parity,
    "outcome_parity": outcome_parity,
    "parity_p95": parity_p95,
    "model_summary": model_summary,
}


def _r(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def _grid(values, name):
    return f"(VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in values)}) AS t_{name}({name})"


LOOKED = f"""{v.PRED}, q AS (SELECT market_id, sample_ts AS q_ts, yes_bid AS q_yes_bid, no_bid AS q_no_bid, yes_ask AS q_yes_ask, no_ask AS q_no_ask FROM pred),
due AS (SELECT p.*, h.h AS exit_horizon_seconds, p.sample_ts + CAST(h.h AS BIGINT) * INTERVAL 1 SECOND AS due_ts FROM pred p, {_grid(HORIZONS, 'h').replace('t_h(h)', 'h(h)')}),
looked AS (SELECT d.*, CASE WHEN epoch_us(q_ts) - epoch_us(due_ts) <= {TOL * 10**6} THEN q_yes_bid END AS x_yes_bid,
   CASE WHEN epoch_us(q_ts) - epoch_us(due_ts) <= {TOL * 10**6} THEN q_no_bid END AS x_no_bid,
   CASE WHEN epoch_us(q_ts) - epoch_us(due_ts) <= {TOL * 10**6} THEN q_no_ask END AS x_no_ask
  FROM due d ASOF LEFT JOIN q ON q.market_id = d.market_id AND d.due_ts <= q.q_ts)"""

LONG = f"""{LOOKED},
sided AS (SELECT *, 'UP' AS direction, p_up AS signal_probability, yes_ask AS entry_price, x_yes_bid AS exit_price FROM looked
  UNION ALL SELECT *, 'DOWN', p_down, no_ask, x_no_bid FROM looked),
long AS (SELECT s.*, threshold, exit_price - entry_price AS pnl FROM sided s, {_grid(THRESHOLDS, 'threshold')}
  WHERE entry_price IS NOT NULL AND exit_price IS NOT NULL AND signal_probability >= threshold)"""

# greedy cooldown per group, one kept row per group and step
MODE_TRADES = f"""{LONG},
numbered AS (SELECT *, direction || '|' || threshold || '|' || exit_horizon_seconds || '|' || market_id AS g,
   row_number() OVER (PARTITION BY direction, threshold, exit_horizon_seconds, market_id ORDER BY sample_ts, event_id) AS rn FROM long),
kept AS (
  SELECT m.mode, m.cool, g, sample_ts FROM numbered, (VALUES ('cooldown_6h', 21600), ('cooldown_2d', 172800)) m(mode, cool) WHERE rn = 1
  UNION ALL
  SELECT k.mode, k.cool, k.g, min(n.sample_ts) FROM kept k JOIN numbered n ON n.g = k.g AND n.sample_ts >= k.sample_ts + k.cool * INTERVAL 1 SECOND GROUP BY k.mode, k.cool, k.g),
trades AS (SELECT 'all_signals' AS mode, * FROM numbered UNION ALL SELECT 'first_signal_per_market_side', * FROM numbered WHERE rn = 1
  UNION ALL SELECT k.mode, n.* FROM numbered n JOIN kept k ON k.g = n.g AND k.sample_ts = n.sample_ts)"""

KEYS = "mode, direction, threshold, exit_horizon_seconds"


def _walk(keys, order, source="trades"):
    return f"""w1 AS (SELECT *, sum(pnl) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS cum_pnl FROM {source}),
w2 AS (SELECT *, max(cum_pnl) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - cum_pnl AS dd FROM w1)"""


FINE = f"""per AS (
  SELECT {KEYS}, 'overall' AS cut, CAST(NULL AS VARCHAR) AS cut_value, count(*) AS trades, sum(pnl) AS total_pnl, avg(pnl) AS avg_pnl, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM trades GROUP BY ALL
  UNION ALL SELECT {KEYS}, 'date', date, count(*), sum(pnl), avg(pnl), avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) FROM trades GROUP BY {KEYS}, date
  UNION ALL SELECT {KEYS}, 'tte_bucket', tte_bucket, count(*), sum(pnl), avg(pnl), avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) FROM trades GROUP BY {KEYS}, tte_bucket
  UNION ALL SELECT {KEYS}, 'market_id', market_id, count(*), sum(pnl), avg(pnl), avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) FROM trades GROUP BY {KEYS}, market_id)"""

STRESS = f"""stress AS (SELECT {KEYS}, stress_cost, count(*) AS trades, sum(pnl - stress_cost) AS total_pnl, avg(pnl - stress_cost) AS avg_pnl,
   avg(CASE WHEN pnl - stress_cost > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM trades, {_grid(COSTS, 'stress_cost')} GROUP BY ALL)"""

_SIMPLE = f"count(*) AS trades, round(sum(pnl), 6) AS total_pnl, round(avg(pnl), 6) AS avg_pnl, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate"


def _settle(maker: bool) -> str:
    q = "bid" if maker else "ask"
    return f"""{v.PRED},
sided AS (SELECT *, 'YES' AS side, p_up - yes_{q} AS edge, yes_{q} AS entry_price, settled_yes - yes_{q} AS pnl FROM pred
  UNION ALL SELECT *, 'NO', (1.0 - p_up) - no_{q}, no_{q}, (1.0 - settled_yes) - no_{q} FROM pred),
sig AS (SELECT s.*, threshold, CASE WHEN entry_price <> 0 THEN pnl / entry_price END AS roi,
   row_number() OVER (PARTITION BY threshold, market_id, side ORDER BY sample_ts, event_id) AS rn FROM sided s, {_grid((0.0, 0.1, 0.3), 'threshold')} WHERE edge >= threshold),
trades AS (SELECT 'all_signals' AS mode, * FROM sig UNION ALL SELECT 'first_signal_per_market_side', * FROM sig WHERE rn = 1)"""


def _settle_metrics(maker: bool, by: str = "") -> str:
    keys = "mode, side, threshold" + by
    return f"""WITH {_settle(maker)}, {_walk(keys, "sample_ts, event_id")}
      SELECT {keys}, count(*) AS trades, round(avg(entry_price), 5) AS avg_entry_price, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 5) AS win_rate,
        round(sum(pnl), 5) AS total_pnl, round(avg(pnl), 5) AS avg_pnl, round(avg(roi), 5) AS avg_roi, round(quantile_cont(roi, 0.5), 5) AS median_roi,
        round(coalesce(stddev_samp(pnl), 0.0), 5) AS pnl_std, round(CASE WHEN stddev_samp(pnl) > 1e-12 THEN avg(pnl) / stddev_samp(pnl) END, 5) AS sharpe_like,
        round(-max(dd), 5) AS max_drawdown, round(avg(time_to_expiry_seconds), 5) AS avg_time_to_expiry,
        min(time_to_expiry_seconds) AS min_time_to_expiry, max(time_to_expiry_seconds) AS max_time_to_expiry FROM w2 GROUP BY {keys}"""


SCORED = f"""{v.PRED}, scored AS (SELECT *, settled_yes - yes_ask - 0.07 * yes_ask * (1 - yes_ask) - 0.07 * settled_yes * (1.0 - settled_yes) - 0.0025 AS pnl,
   round(p_up - yes_ask, 6) AS pred_edge FROM pred)"""

RUNS = f"""{v.PRED}, kinds AS (SELECT p.*, e.event_type FROM pred p JOIN events e USING (event_id)),
windows AS (SELECT event_id AS window_id, market_id, sample_ts AS center, p_up AS op, p_down AS od FROM kinds WHERE event_type = 'purchase'),
sigs AS (SELECT event_id AS signal_id, market_id, sample_ts, CASE WHEN event_id % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS direction, p_up, p_down FROM kinds WHERE event_type = 'view')"""

OUTCOMES = f"""{RUNS}, qq AS (SELECT market_id, sample_ts AS q_ts, yes_bid, yes_ask, no_bid, no_ask FROM pred),
o AS (SELECT s.*, l.l AS entry_latency_ms, sample_ts + l.l * INTERVAL 1 MILLISECOND AS e_due, sample_ts + l.l * INTERVAL 1 MILLISECOND + INTERVAL 86400 SECOND AS x_due FROM sigs s, (VALUES (0), (3600000)) l(l)),
o2 AS (SELECT o.*, CASE direction WHEN 'UP' THEN e.yes_ask ELSE e.no_ask END AS expected_entry_price, CASE direction WHEN 'UP' THEN x.yes_bid ELSE x.no_bid END AS expected_exit_price
   FROM o ASOF LEFT JOIN qq e ON e.market_id = o.market_id AND o.e_due <= e.q_ts ASOF LEFT JOIN qq x ON x.market_id = o.market_id AND o.x_due <= x.q_ts),
outc AS (SELECT *, expected_exit_price - expected_entry_price AS expected_pnl, abs(expected_entry_price - p_up) AS abs_diff_entry_price,
   abs(expected_exit_price - p_down) AS abs_diff_exit_price, abs(expected_exit_price - expected_entry_price - (p_down - p_up)) AS abs_diff_pnl FROM o2)"""

_AUC = """(SELECT tte_bucket, probability, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc,
   avg(-(y * ln(pc) + (1 - y) * ln(1 - pc))) AS logloss, avg((pc - y) * (pc - y)) AS brier, avg(CASE WHEN (pc >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy_0p5
   FROM (SELECT *, rank() OVER (PARTITION BY tte_bucket, probability ORDER BY pc) + (count(*) OVER (PARTITION BY tte_bucket, probability, pc) - 1) / 2.0 AS r
         FROM (SELECT tte_bucket, 'p_up' AS probability, settled_yes AS y, least(greatest(p_up, 1e-6), 1 - 1e-6) AS pc FROM pred
               UNION ALL SELECT tte_bucket, 'yes_ask', settled_yes, least(greatest(yes_ask, 1e-6), 1 - 1e-6) FROM pred)) GROUP BY 1, 2)"""

_SIDED = f"""{v.PRED}, sided AS (SELECT event_id, market_id, sample_ts, 'UP' AS direction, p_up AS p FROM pred UNION ALL
        SELECT event_id, market_id, sample_ts, 'DOWN', p_down FROM pred)"""

ORACLES = {
    "first_signal": f"""WITH {_SIDED}, r AS (SELECT *, row_number() OVER (PARTITION BY market_id, direction ORDER BY sample_ts, event_id) AS rn FROM sided WHERE p >= 0.7)
      SELECT market_id, direction, event_id, sample_ts FROM r WHERE rn = 1""",
    "cooldown_6h": f"""WITH RECURSIVE {_SIDED}, s AS (SELECT event_id, market_id, direction, sample_ts FROM sided WHERE p >= 0.5),
      kept AS (SELECT market_id, direction, min(sample_ts) AS sample_ts FROM s GROUP BY 1, 2 UNION ALL
        SELECT k.market_id, k.direction, min(s.sample_ts) FROM kept k JOIN s ON s.market_id = k.market_id AND s.direction = k.direction AND s.sample_ts >= k.sample_ts + INTERVAL 6 HOUR GROUP BY k.market_id, k.direction)
      SELECT s.event_id, s.market_id, s.direction, s.sample_ts FROM s JOIN kept k ON k.market_id = s.market_id AND k.direction = s.direction AND k.sample_ts = s.sample_ts""",
    "cooldown_hot_key": """WITH RECURSIVE kept AS (SELECT min(ts) AS ts FROM events UNION ALL
        SELECT * FROM (SELECT min(e.ts) AS ts FROM kept k JOIN events e ON e.ts >= k.ts + INTERVAL 1 HOUR) WHERE ts IS NOT NULL)
      SELECT e.event_id, e.ts FROM events e JOIN kept k ON k.ts = e.ts""",
    "future_quotes": f"""WITH {LOOKED} SELECT event_id,
        {", ".join(f"max(CASE WHEN exit_horizon_seconds = {h} THEN x_yes_bid END) AS future_yes_bid_{h}, max(CASE WHEN exit_horizon_seconds = {h} THEN x_no_ask END) AS future_no_ask_{h}" for h in HORIZONS)}
        FROM looked GROUP BY event_id""",
    "signals_long": f"WITH {LONG} SELECT event_id, direction, threshold, exit_horizon_seconds, signal_probability, entry_price, exit_price, round(pnl, 9) AS pnl FROM long",
    "threshold_metrics": f"""WITH RECURSIVE {MODE_TRADES}, {_walk(KEYS, "market_id, sample_ts, event_id")} SELECT {KEYS}, count(*) AS trades, round(avg(entry_price), 6) AS avg_entry_price,
        round(avg(exit_price), 6) AS avg_exit_price, round(avg(time_to_expiry_seconds), 6) AS avg_time_to_expiry, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
        round(sum(pnl), 6) AS total_pnl, round(avg(pnl), 6) AS avg_pnl, round(coalesce(stddev_samp(pnl), 0.0), 6) AS pnl_std,
        round(CASE WHEN stddev_samp(pnl) > 1e-12 THEN avg(pnl) / stddev_samp(pnl) END, 6) AS sharpe_like, round(quantile_cont(pnl, 0.5), 6) AS median_pnl, round(max(dd), 6) AS max_drawdown
        FROM w2 GROUP BY {KEYS}""",
    "grid_cuts": f"WITH RECURSIVE {MODE_TRADES}, {FINE} SELECT {KEYS}, cut, cut_value, trades, {_r(['total_pnl', 'avg_pnl', 'win_rate'])} FROM per WHERE cut <> 'market_id'",
    "latency_grid": f"""WITH RECURSIVE {cq.silver_sql(14400)}, {v.PRED.replace(v.EV + ",", "", 1)},
      combos AS (SELECT a.a AS lat, h.h AS hor FROM (VALUES (0), (14400)) a(a), (VALUES (21600), (86400)) h(h)),
      due AS (SELECT p.* EXCLUDE (time_to_expiry_seconds), 200000.0 - time_to_expiry_seconds AS tte, lat, hor, p.sample_ts + lat * INTERVAL 1 SECOND AS e_due, p.sample_ts + (lat + hor) * INTERVAL 1 SECOND AS x_due
        FROM pred p, combos WHERE 200000.0 - time_to_expiry_seconds >= lat + hor),
      hit AS (SELECT d.event_id, d.market_id, d.sample_ts, d.lat, d.hor, d.p_up, d.p_down, e.yes_ask AS e_ya, e.no_ask AS e_na, x.yes_bid AS x_yb, x.no_bid AS x_nb,
          e.yes_is_stale OR e.yes_crossed_quote OR x.yes_is_stale OR x.yes_crossed_quote AS bad_yes, e.no_is_stale OR e.no_crossed_quote OR x.no_is_stale OR x.no_crossed_quote AS bad_no
        FROM due d ASOF JOIN silver2 e ON e.market_id = d.market_id AND d.e_due <= e.sample_ts ASOF JOIN silver2 x ON x.market_id = d.market_id AND d.x_due <= x.sample_ts
        WHERE e.sample_ts - d.e_due <= INTERVAL 4 HOUR AND x.sample_ts - d.x_due <= INTERVAL 4 HOUR),
      sided AS (SELECT event_id, market_id, sample_ts, lat, hor, 'UP' AS direction, p_up AS pr, x_yb - e_ya AS pnl FROM hit WHERE NOT bad_yes
        UNION ALL SELECT event_id, market_id, sample_ts, lat, hor, 'DOWN', p_down, x_nb - e_na FROM hit WHERE NOT bad_no),
      numbered AS (SELECT *, direction || '|' || threshold || '|' || lat || '|' || hor || '|' || market_id AS g,
          row_number() OVER (PARTITION BY direction, threshold, lat, hor, market_id ORDER BY sample_ts, event_id) AS rn FROM sided, {_grid(THRESHOLDS, 'threshold')} WHERE pr >= threshold AND pnl IS NOT NULL),
      kept AS (SELECT gap, g, sample_ts FROM numbered, (VALUES (6), (48)) w(gap) WHERE rn = 1 UNION ALL
        SELECT k.gap, k.g, min(n.sample_ts) FROM kept k JOIN numbered n ON n.g = k.g AND n.sample_ts >= k.sample_ts + k.gap * INTERVAL 1 HOUR GROUP BY k.gap, k.g),
      trades AS (SELECT 'all_signals' AS mode, * FROM numbered UNION ALL SELECT 'first_signal_per_market_side', * FROM numbered WHERE rn = 1
        UNION ALL SELECT CASE k.gap WHEN 6 THEN 'cooldown_6h' ELSE 'cooldown_2d' END, n.* FROM numbered n JOIN kept k ON k.g = n.g AND k.sample_ts = n.sample_ts)
      SELECT mode, direction, threshold, CAST(lat AS DOUBLE) AS latency_seconds, CAST(hor AS DOUBLE) AS exit_horizon_seconds, {_SIMPLE} FROM trades GROUP BY ALL""",
    "stress_costs": f"WITH RECURSIVE {MODE_TRADES}, {STRESS} SELECT {KEYS}, stress_cost, trades, {_r(['total_pnl', 'avg_pnl', 'win_rate'])} FROM stress",
    "break_even_cost": f"""WITH RECURSIVE {MODE_TRADES}, {STRESS}, b AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY stress_cost DESC) AS rn FROM stress WHERE avg_pnl >= 0)
      SELECT {KEYS}, stress_cost AS break_even_cost, trades, round(avg_pnl, 6) AS avg_pnl FROM b WHERE rn = 1""",
    "filter_grid": f"""WITH {v.PRED}, x AS (SELECT *, 'UP' AS direction, p_up AS p, round((event_id % 13) / 100.0, 2) AS side_spread, settled_yes - yes_ask AS pnl FROM pred UNION ALL
        SELECT *, 'DOWN', p_down, round((event_id % 13) / 100.0, 2), 1 - settled_yes - no_ask FROM pred),
      f AS (SELECT x.*, prob_threshold, max_spread, max_quote_age, min_time_to_expiry FROM x, {_grid((0.6, 0.8), 'prob_threshold')},
          (VALUES (CAST(0.02 AS DOUBLE)), (CAST(0.05 AS DOUBLE)), (NULL)) s(max_spread), {_grid((2.0, 5.0), 'max_quote_age')}, {_grid((10, 60), 'min_time_to_expiry')}
        WHERE p >= prob_threshold AND (max_spread IS NULL OR side_spread <= max_spread) AND quote_age_seconds <= max_quote_age AND time_to_expiry_seconds >= min_time_to_expiry),
      n AS (SELECT *, row_number() OVER (PARTITION BY direction, prob_threshold, max_spread, max_quote_age, min_time_to_expiry, market_id ORDER BY sample_ts, event_id) AS rn FROM f),
      trades AS (SELECT 'all_signals' AS mode, * FROM n UNION ALL SELECT 'first_signal_per_market_side', * FROM n WHERE rn = 1)
      SELECT mode, direction, prob_threshold, max_spread, max_quote_age, min_time_to_expiry, {_SIMPLE} FROM trades GROUP BY ALL""",
    "stability_two_level": f"""WITH RECURSIVE {MODE_TRADES}, {FINE}, s AS (SELECT {KEYS},
        max(trades) FILTER (cut = 'overall') AS trades, max(total_pnl) FILTER (cut = 'overall') AS total_pnl, max(avg_pnl) FILTER (cut = 'overall') AS avg_pnl, max(win_rate) FILTER (cut = 'overall') AS win_rate,
        count(*) FILTER (cut = 'market_id') AS unique_market_count, count(*) FILTER (cut = 'date' AND total_pnl > 0) AS positive_date_count, count(*) FILTER (cut = 'date' AND total_pnl < 0) AS negative_date_count,
        min(total_pnl) FILTER (cut = 'date') AS worst_date_pnl, max(total_pnl) FILTER (cut = 'date') AS best_date_pnl,
        count(*) FILTER (cut = 'tte_bucket' AND total_pnl > 0) AS positive_tte_bucket_count, count(*) FILTER (cut = 'tte_bucket' AND total_pnl < 0) AS negative_tte_bucket_count,
        max(total_pnl) FILTER (cut = 'market_id') AS top_market_pnl FROM per GROUP BY {KEYS})
      SELECT {KEYS}, trades, unique_market_count, positive_date_count, negative_date_count, positive_tte_bucket_count, negative_tte_bucket_count,
        {_r(['total_pnl', 'avg_pnl', 'win_rate', 'worst_date_pnl', 'best_date_pnl', 'top_market_pnl'])}, round(trades / unique_market_count, 6) AS avg_trades_per_market,
        round(CASE WHEN total_pnl <> 0 THEN abs(top_market_pnl) / greatest(abs(total_pnl), 1e-12) END, 6) AS top_market_pnl_share_abs FROM s""",
    "stability_top_markets": f"""WITH RECURSIVE {MODE_TRADES}, {FINE}, m AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY round(total_pnl, 6) DESC, cut_value) AS rank FROM per WHERE cut = 'market_id')
      SELECT {KEYS}, cut_value AS market_id, rank, trades, {_r(['total_pnl', 'avg_pnl', 'win_rate'])} FROM m WHERE rank <= 5""",
    "equity_curve": f"""WITH RECURSIVE {MODE_TRADES}, {_walk(KEYS, "sample_ts, event_id")},
      i AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY sample_ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY {KEYS}) AS n FROM w2)
      SELECT {KEYS}, event_id, sample_ts, round(cum_pnl, 6) AS cum_pnl, round(dd, 6) AS drawdown FROM i WHERE pos % greatest(1, n // 20) = 0 OR pos = n - 1""",
    "drawdown": f"""WITH a AS (SELECT 'one' AS account, ts, event_id, value - 50 AS pnl FROM events UNION ALL SELECT event_type, ts, event_id, value - 50 FROM events),
      {_walk("account", "ts, event_id", "a")} SELECT account, round(max(dd), 4) AS max_drawdown FROM w2 GROUP BY 1""",
    "settlement_taker": _settle_metrics(False),
    "settlement_taker_by_source": _settle_metrics(False, ", label_source, tte_bucket"),
    "settlement_maker": _settle_metrics(True),
    "markout_sanity": f"""WITH {v.PRED}, b AS (SELECT *, (settled_yes - yes_ask) / 10 AS markout, yes_ask - yes_bid AS s FROM pred),
      sided AS (SELECT tte_bucket, s, 'UP' AS direction, p_up AS p, markout AS m FROM b UNION ALL SELECT tte_bucket, s, 'DOWN', p_down, -markout FROM b)
      SELECT direction, threshold, tte_bucket, count(*) AS signals, round(avg(m), 6) AS mean_markout, round(quantile_cont(m, 0.5), 6) AS median_markout,
        round(avg(CAST(m > 0 AS INTEGER)), 6) AS positive_rate, round(avg(CAST(m > 0.005 AS INTEGER)), 6) AS gt_half_cent_rate, round(avg(CAST(m > 0.01 AS INTEGER)), 6) AS gt_1c_rate,
        round(avg(CAST(m > 0.02 AS INTEGER)), 6) AS gt_2c_rate, round(avg(s), 6) AS avg_spread, round(avg(m - 0.5 * s), 6) AS markout_minus_half_spread, round(avg(m - s), 6) AS markout_minus_full_spread
      FROM sided, {_grid(THRESHOLDS, 'threshold')} WHERE p >= threshold GROUP BY ALL""",
    "walkforward_folds": f"""WITH {v.PRED}, f(fold, a, b, va, te) AS (VALUES {", ".join(str(x) for x in FOLDS)}),
      r AS (SELECT fold, CASE WHEN date BETWEEN a AND b THEN 'train' WHEN date = va THEN 'valid' WHEN date = te THEN 'test' END AS role FROM pred, f),
      c AS (SELECT fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'valid') AS valid_rows, count(*) FILTER (role = 'test') AS test_rows FROM r WHERE role IS NOT NULL GROUP BY 1)
      SELECT *, CASE WHEN least(train_rows, valid_rows, test_rows) < 20 THEN 'skipped' ELSE 'ok' END AS status FROM c""",
    "chosen_thresholds": f"""WITH {SCORED}, trades AS (SELECT s.*, edge_threshold, prob_threshold FROM scored s, {_grid((-0.2, 0.0, 0.2, 0.5), 'edge_threshold')}, {_grid((0.3, 0.5, 0.7), 'prob_threshold')}
          WHERE pred_edge >= edge_threshold AND p_up >= prob_threshold),
      {_walk("label_source, edge_threshold, prob_threshold", "market_id, sample_ts, event_id")},
      g AS (SELECT label_source, edge_threshold, prob_threshold, count(*) AS trades, avg(pnl) - 0.05 * max(dd) AS score FROM w2 GROUP BY 1, 2, 3 HAVING count(*) >= 20),
      b AS (SELECT *, row_number() OVER (PARTITION BY label_source ORDER BY score DESC, edge_threshold, prob_threshold) AS rn FROM g)
      SELECT label_source, edge_threshold, prob_threshold, round(score, 6) AS score, trades FROM b WHERE rn = 1""",
    "net_threshold_pnl": f"WITH {SCORED} SELECT date, threshold, {_SIMPLE} FROM scored, {_grid((0.55, 0.65, 0.75), 'threshold')} WHERE p_up >= threshold GROUP BY ALL",
    "signal_parity": f"""WITH {RUNS}, j AS (SELECT w.*, s.signal_id, s.direction, s.p_up, s.p_down, s.sample_ts, abs(epoch_us(w.center) - epoch_us(s.sample_ts)) AS d,
          row_number() OVER (PARTITION BY window_id ORDER BY abs(epoch_us(w.center) - epoch_us(s.sample_ts)), s.sample_ts) AS rn FROM windows w LEFT JOIN sigs s ON s.market_id = w.market_id)
      SELECT window_id, market_id, signal_id, direction, sample_ts IS NOT NULL AS signal_found, round(d / 1000.0, 3) AS abs_ms, round(abs(p_up - op), 6) AS abs_diff_p_up, round(abs(p_down - od), 6) AS abs_diff_p_down FROM j WHERE rn = 1""",
    "outcome_parity": f"""WITH {OUTCOMES} SELECT signal_id, entry_latency_ms, {_r(["expected_entry_price", "expected_exit_price", "expected_pnl", "abs_diff_entry_price", "abs_diff_exit_price", "abs_diff_pnl"])} FROM outc""",
    "parity_p95": f"""WITH {OUTCOMES}, l AS (SELECT direction, count(*) AS rows, list_sort(list(abs_diff_entry_price) FILTER (abs_diff_entry_price IS NOT NULL)) AS a,
        list_sort(list(round(abs_diff_pnl, 6)) FILTER (abs_diff_pnl IS NOT NULL)) AS b FROM outc GROUP BY 1)
      SELECT direction, rows, round(a[CAST(floor((len(a) - 1) * 0.95 + 0.5) AS BIGINT) + 1], 6) AS abs_diff_entry_price_p95, round(b[CAST(floor((len(b) - 1) * 0.95 + 0.5) AS BIGINT) + 1], 6) AS abs_diff_pnl_p95 FROM l""",
    "model_summary": f"""WITH {v.PRED}, m AS {_AUC}
      SELECT a.tte_bucket, round(a.auc, 6) AS auc_model, round(b.auc, 6) AS auc_baseline, round(a.auc - b.auc, 6) AS auc_delta, round(a.logloss - b.logloss, 6) AS logloss_delta,
        round(a.brier - b.brier, 6) AS brier_delta, round(a.accuracy_0p5 - b.accuracy_0p5, 6) AS accuracy_0p5_delta
      FROM m a JOIN m b ON a.tte_bucket = b.tte_bucket AND a.probability = 'p_up' AND b.probability = 'yes_ask'""",
}
