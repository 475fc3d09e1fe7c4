"""Queries on the instrument grid and the labelled sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import quotes as cq
from tidemark.catalog import views as v
from tidemark.functions import scalars as fn
from tidemark.operators import rank
from tidemark.operators.rowwindows import in_blocks, rolling
from tidemark.operators.scan import row_index
from tidemark.plans import gold as g
from tidemark.plans import instrument as ins
from tidemark.session import stage

STEP = 300
RET = (1, 3, 6)
VOL = (6, 12)
FLOW = (1, 3, 6)


def _round(cols, digits=6):
    return [F.round(c, digits).alias(c) for c in cols]


def series_frame(spark, sf):
    return ins.instrument_silver(
        v.ticks(spark, sf), v.trades(spark, sf), step_seconds=STEP, flow_windows=FLOW, return_steps=RET,
        vol_windows=VOL, bucket_seconds=86_400, tie=["event_id"],
    )


def instrument_silver(spark, sf):
    s = series_frame(spark, sf)
    return s.select(
        v.naive("sample_ts"), "symbol", "bid_price", "ask_price", "bid_qty", "ask_qty", "mid_price", "spread",
        *_round(["microprice", "microprice_minus_mid"], 8),
        *_round([f"return_{k}" for k in RET] + [f"realized_vol_{k}" for k in VOL], 8),
        *[f"{c}_{k}" for k in FLOW for c in ("buy_volume", "sell_volume", "net_volume", "total_volume", "trade_count")],
        *_round([f"trade_imbalance_{k}" for k in FLOW], 8),
        "date",
    )


def trade_flow_rolling(spark, sf):
    """Flow per hour and user group, rolling over full windows only."""
    tr = v.trades(spark, sf).withColumn("symbol", F.col("side"))
    flow = ins.flow_per_step(tr, step_seconds=3_600)
    idx = flow.withColumn("hour_idx", (F.unix_timestamp("sample_ts") / 3600).cast("bigint"))
    idx = row_index(idx, keys=["symbol"], bucket=F.col("hour_idx") - F.col("hour_idx") % 24, order=["hour_idx"], name="row_idx")
    out = in_blocks(
        idx, keys=["symbol"], index="row_idx", before=4, block=64,
        compute=lambda w: {f"total_{n}": rolling(F.sum, "total_volume", n, w) for n in (1, 3, 5)},
    )
    return out.select("symbol", v.naive("sample_ts"), "trade_count", "total_1", "total_3", "total_5")


def returns_realized_vol(spark, sf):
    """Log returns and volatility over the last 20 ticks of the single instrument."""
    t = v.ticks(spark, sf)
    out = ins.tick_volatility(t, keys=["symbol"], value="bid_price", n=20, tie=["event_id"])
    return out.select("event_id", *_round(["log_return", "vol_20_ticks"], 8))


def realized_vol_seconds(spark, sf):
    """Volatility over the ticks of the last two hours and of the last day."""
    out = ins.second_volatility(v.ticks(spark, sf), keys=["symbol"], value="bid_price", seconds=(7_200, 86_400), tie=["event_id"])
    return out.select("event_id", *_round(["log_return", "vol_7200s", "vol_86400s"], 8))


def direction_labels(spark, sf):
    d = ins.direction_labels(series_frame(spark, sf), horizons=(1, 3, 12), threshold=0.02)
    return d.select(
        v.naive("sample_ts"), *_round([f"future_return_{k}" for k in (1, 3, 12)], 8),
        *[f"label_direction_{k}" for k in (1, 3, 12)],
    )


def sliding_flow(spark, sf):
    out = ins.sliding_flow(v.trades(spark, sf), keys=["symbol"], seconds=(600, 3_600))
    return out.select(
        "event_id", *[f"{c}_{s}s" for s in (600, 3600) for c in ("buy", "sell", "net", "count")],
        *_round([f"imbalance_{s}s" for s in (600, 3600)], 8),
    )


def lag_values(spark, sf):
    out = ins.lag_value(v.ticks(spark, sf), keys=["symbol"], ts="ts_event", value="bid_price", seconds=(60, 3_600), tie=["event_id"])
    return out.select("event_id", "bid_price", "bid_price_lag_60s", "bid_price_lag_3600s")


def entity_time_split(spark, sf):
    ev = v.table(spark, sf, "events")
    return rank.entity_split_map(ev, entity="user_id", ts="ts")


def row_time_split(spark, sf):
    ev = v.table(spark, sf, "events").select("event_id", "ts")
    return rank.time_split(ev, ts="ts", tie=["event_id"]).select("event_id", "split")


def open_close_asof(spark, sf):
    ticks = v.ticks(spark, sf).select(F.col("ts_event").alias("sample_ts"), F.col("bid_price").alias("mid_price"))
    m = v.markets(spark, sf).select("market_id", "market_start_ts", "market_end_ts")
    oc = g.open_close(m, ticks)
    return oc.select(
        "market_id", v.naive("market_start_ts"), v.naive("market_end_ts"), "open_price", "close_price",
        fn.settled_up("open_price", "close_price").alias("settled_yes"),
    )


def formula_prob(spark, sf):
    ev = v.events(spark, sf)
    p = fn.formula_probability(F.col("value") + 100, F.lit(150.0), (F.col("k") + 1) / 100, F.col("k").cast("double"))
    return ev.select("event_id", F.round(p, 6).alias("p_yes"), F.round(fn.normal_cdf((F.col("k") - 50) / 10), 6).alias("cdf"))


def _silver(spark, sf):
    return stage(cq.market_silver_frame(spark, sf, 14_400), "market_silver")


def _series(spark, sf):
    return stage(series_frame(spark, sf), "instrument_silver")


def terminal_gold(spark, sf):
    out = g.terminal_gold(
        _silver(spark, sf), _series(spark, sf), series_columns=["trade_imbalance_3"], sigma="realized_vol_12",
        stale_seconds=600, bucket_seconds=86_400,
    )
    return out.select(
        "market_id", v.naive("sample_ts"), v.naive("market_start_ts"), v.naive("matched_series_ts"),
        "series_age_seconds", "current_price", "open_price", "close_price",
        *_round(["return_since_open", "distance_to_open", "formula_p_yes", "edge_to_yes_ask", "edge_to_no_ask"]),
        "settled_yes", "label_source", "split",
    )


def repricing_gold(spark, sf):
    out = g.repricing_gold(
        _silver(spark, sf), _series(spark, sf), series_columns=["return_1"], sigma="realized_vol_12",
        stale_seconds=600, steps=(1, 3), threshold=0.05, bucket_seconds=86_400,
    )
    return out.select(
        "market_id", v.naive("sample_ts"), *_round(["yes_mid", "future_yes_mid_1", "future_yes_mid_3", "markout_1", "markout_3"]),
        "label_reprice_1", "label_reprice_3", "split",
    )


LAT = (0, 14_400_000)
HOR = (14_400_000, 43_200_000)


def executable_frame(spark, sf):
    s = _silver(spark, sf)
    base = s.where("NOT yes_is_stale AND NOT no_is_stale").select("market_id", "sample_ts", "time_to_expiry_seconds", "date")
    return g.executable_gold(base, s, latencies_ms=LAT, horizons_ms=HOR, tolerance=1.0, bucket_seconds=5 * 86_400)


def executable_grid(spark, sf):
    out = executable_frame(spark, sf)
    return out.select(
        "market_id", v.naive("sample_ts"), "latency_seconds", "exit_horizon_seconds", v.naive("entry_quote_ts"),
        v.naive("exit_quote_ts"), *_round(["pnl_up", "roi_up", "pnl_down", "roi_down"]),
        "label_up_profitable", "label_down_profitable",
    )


def executable_label_rates(spark, sf):
    out = g.label_rates(executable_frame(spark, sf))
    return out.select(
        "latency_seconds", "exit_horizon_seconds", "rows",
        *_round(["up_profitable_rate", "avg_pnl_up", "down_profitable_rate", "avg_pnl_down"]),
    )


def event_time_grid(spark, sf):
    s = _silver(spark, sf)
    out = g.event_time_gold(
        cq.quote_events(spark, sf), s, s, feature_columns=["time_to_expiry_seconds", "yes_mid"],
        latencies_ms=(0, 3_600_000), horizons_ms=(14_400_000, 28_800_000), feature_tolerance=14_400,
        tolerance=14_400, bucket_seconds=5 * 86_400,
    )
    return out.select(
        "market_id", v.naive("sample_ts"), "latency_seconds", "exit_horizon_seconds", v.naive("entry_quote_ts"),
        v.naive("exit_quote_ts"), *_round(["pnl_up", "pnl_down"]), "label_up_profitable", "label_down_profitable",
    )


QUERIES = {
    "instrument_silver": instrument_silver,
    "trade_flow_rolling": trade_flow_rolling,
    "returns_realized_vol": returns_realized_vol,
    "realized_vol_seconds": realized_vol_seconds,
    "three_way_labels": direction_labels,
    "sliding_flow": sliding_flow,
    "lag_values": lag_values,
    "entity_time_split": entity_time_split,
    "row_time_split": row_time_split,
    "open_close_asof": open_close_asof,
    "formula_prob": formula_prob,
    "terminal_gold": terminal_gold,
    "repricing_gold": repricing_gold,
    "executable_grid": executable_grid,
    "executable_label_rates": executable_label_rates,
    "event_time_grid": event_time_grid,
}

_roll = lambda c, n, name: (
    f"CASE WHEN count({c}) OVER (ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} "
    f"THEN sum({c}) OVER (ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS {name}_{n}"
)

SERIES = f"""{v.TICKS},
bounds AS (SELECT min(epoch_us(ts_event)) // {STEP * 10**6} AS a, max(epoch_us(ts_event)) // {STEP * 10**6} AS b FROM ticks),
sgrid AS (SELECT i, make_timestamp((a + i) * {STEP * 10**6}) AS sample_ts FROM bounds, LATERAL (SELECT unnest(generate_series(0, b - a)) AS i)),
flow AS (SELECT make_timestamp(epoch_us(ts_event) // {STEP * 10**6} * {STEP * 10**6}) AS sample_ts,
   sum(CASE side WHEN 'buy_aggressor' THEN qty ELSE 0 END) AS bv, sum(CASE side WHEN 'sell_aggressor' THEN qty ELSE 0 END) AS sv,
   sum(qty) AS tv, count(*) AS tc FROM trades GROUP BY 1),
priced AS (SELECT *, (bid_price + ask_price) / 2.0 AS mid_price, ask_price - bid_price AS spread,
   CASE WHEN bid_qty + ask_qty > 0 THEN (ask_price * bid_qty + bid_price * ask_qty) / (bid_qty + ask_qty) END AS microprice FROM ticks),
s0 AS (SELECT g.i, g.sample_ts, p.* EXCLUDE (ts_event, event_id), coalesce(bv, 0) AS bv, coalesce(sv, 0) AS sv, coalesce(tv, 0) AS tv, CAST(coalesce(tc, 0) AS BIGINT) AS tc
   FROM sgrid g ASOF LEFT JOIN priced p ON g.sample_ts >= p.ts_event LEFT JOIN flow f ON f.sample_ts = g.sample_ts),
s1 AS (SELECT *, ln(mid_price) - ln(lag(mid_price) OVER (ORDER BY i)) AS lr,
   {", ".join(f"mid_price / lag(mid_price, {k}) OVER (ORDER BY i) - 1.0 AS return_{k}" for k in RET)},
   {", ".join(_roll("bv", n, "buy_volume") + "," + _roll("sv", n, "sell_volume") + "," + _roll("tv", n, "total_volume") + "," + _roll("tc", n, "trade_count") for n in FLOW)}
   FROM s0),
series AS (SELECT *, 'ALL' AS symbol, microprice - mid_price AS microprice_minus_mid, strftime(sample_ts, '%Y-%m-%d') AS date,
   {", ".join(f"buy_volume_{n} - sell_volume_{n} AS net_volume_{n}, CASE WHEN total_volume_{n} > 0 THEN (buy_volume_{n} - sell_volume_{n}) / total_volume_{n} END AS trade_imbalance_{n}" for n in FLOW)},
   {", ".join(f"CASE WHEN count(lr) OVER (ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN stddev_samp(lr) OVER (ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS realized_vol_{n}" for n in VOL)}
   FROM s1)"""


def _r(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def _erf(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x})))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"(sign({x}) * (1.0 - {poly} * exp(-abs({x}) * abs({x}))))"


def cdf_sql(x: str) -> str:
    return f"(0.5 * (1.0 + {_erf(f'(({x}) / sqrt(2.0))')}))"


def formula_sql(c, o, s, t) -> str:
    z = f"(ln({c} / {o}) / (greatest({s}, 1e-6) * sqrt(greatest({t}, 1.0))))"
    return f"CASE WHEN {c} > 0 AND {o} > 0 AND {s} IS NOT NULL AND {t} IS NOT NULL THEN least(0.999, greatest(0.001, {cdf_sql(z)})) END"


def _split(n="n", i="i") -> str:
    return (
        f"CASE WHEN {i} < CAST(trunc({n} * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train' "
        f"WHEN {i} < CAST(trunc({n} * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS BIGINT) THEN 'valid' ELSE 'test' END AS split"
    )


SILVER_SERIES = (
    cq.silver_sql(14400)
    + ", "
    + SERIES.replace(v.EV + ",\n", "", 1)
)

FRESH_JOIN = """
fresh AS (SELECT * FROM silver2 WHERE NOT yes_is_stale AND NOT no_is_stale {extra}),
joined AS (SELECT f.*, s.sample_ts AS matched_series_ts, s.mid_price, s.realized_vol_12,
    CAST((epoch_us(f.sample_ts) - epoch_us(s.sample_ts)) // 1000 AS DOUBLE) / 1000.0 AS series_age_seconds
  FROM fresh f ASOF LEFT JOIN series s ON f.sample_ts >= s.sample_ts),
ready AS (SELECT * FROM joined WHERE series_age_seconds <= 600),
firsts AS (SELECT market_id, min(market_start_ts) AS market_start_ts, min(market_end_ts) AS market_end_ts FROM ready GROUP BY 1),
splits AS (SELECT market_id, {split} FROM (SELECT market_id, row_number() OVER (ORDER BY market_start_ts, market_id) - 1 AS i, count(*) OVER () AS n FROM firsts))
""".replace("{split}", _split())

EXEC = f"""{cq.silver_sql(14400)},
combos AS (SELECT a.l AS lat, h.h AS hor FROM (VALUES (0), (14400)) a(l), (VALUES (14400), (43200)) h(h)),
leftside AS (SELECT market_id, sample_ts, time_to_expiry_seconds, lat, hor,
   sample_ts + lat * INTERVAL 1 SECOND AS entry_time, sample_ts + (lat + hor) * INTERVAL 1 SECOND AS exit_time
   FROM silver2, combos WHERE NOT yes_is_stale AND NOT no_is_stale AND time_to_expiry_seconds >= lat + hor),
ex AS (SELECT l.*, e.sample_ts AS entry_quote_ts, x.sample_ts AS exit_quote_ts, e.yes_ask AS entry_yes_ask, e.no_ask AS entry_no_ask,
   x.yes_bid AS exit_yes_bid, x.no_bid AS exit_no_bid, x.yes_bid - e.yes_ask AS pnl_up, x.no_bid - e.no_ask AS pnl_down
   FROM leftside l JOIN silver2 e ON e.market_id = l.market_id AND e.sample_ts = l.entry_time
   JOIN silver2 x ON x.market_id = l.market_id AND x.sample_ts = l.exit_time
   WHERE e.yes_ask > 0 AND e.yes_ask <= 1 AND e.no_ask > 0 AND e.no_ask <= 1 AND x.yes_bid IS NOT NULL AND x.no_bid IS NOT NULL
     AND NOT (e.yes_is_stale OR e.no_is_stale OR x.yes_is_stale OR x.no_is_stale OR e.yes_crossed_quote OR e.no_crossed_quote OR x.yes_crossed_quote OR x.no_crossed_quote)),
exe AS (SELECT *, CAST(lat AS DOUBLE) AS latency_seconds, CAST(hor AS DOUBLE) AS exit_horizon_seconds,
   pnl_up / entry_yes_ask AS roi_up, pnl_down / entry_no_ask AS roi_down,
   CAST(pnl_up > 0 AS INTEGER) AS label_up_profitable, CAST(pnl_down > 0 AS INTEGER) AS label_down_profitable FROM ex)"""

ORACLES = {
    "instrument_silver": f"""WITH {SERIES} SELECT sample_ts, symbol, bid_price, ask_price, bid_qty, ask_qty, mid_price, spread,
        {_r(["microprice", "microprice_minus_mid"], 8)}, {_r([f"return_{k}" for k in RET] + [f"realized_vol_{k}" for k in VOL], 8)},
        {", ".join(f"{c}_{k}" for k in FLOW for c in ("buy_volume", "sell_volume", "net_volume", "total_volume"))},
        {", ".join(f"CAST(trade_count_{k} AS BIGINT) AS trade_count_{k}" for k in FLOW)},
        {_r([f"trade_imbalance_{k}" for k in FLOW], 8)}, date FROM series""",
    "trade_flow_rolling": f"""WITH {v.TICKS}, f AS (SELECT side AS symbol, date_trunc('hour', ts_event) AS sample_ts, sum(qty) AS tv, count(*) AS trade_count
        FROM trades GROUP BY ALL)
      SELECT symbol, sample_ts, trade_count, {", ".join(f"CASE WHEN count(tv) OVER (PARTITION BY symbol ORDER BY sample_ts ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW) = {n} THEN sum(tv) OVER (PARTITION BY symbol ORDER BY sample_ts ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW) END AS total_{n}" for n in (1, 3, 5))} FROM f""",
    "returns_realized_vol": f"""WITH {v.TICKS}, r AS (SELECT event_id, ts_event, ln(bid_price) - ln(lag(bid_price) OVER (ORDER BY ts_event, event_id)) AS log_return FROM ticks)
      SELECT event_id, round(log_return, 8) AS log_return, round(stddev_samp(log_return) OVER (ORDER BY ts_event, event_id ROWS BETWEEN 18 PRECEDING AND CURRENT ROW), 8) AS vol_20_ticks FROM r""",
    "realized_vol_seconds": f"""WITH {v.TICKS}, r AS (SELECT event_id, ts_event, ln(bid_price) - ln(lag(bid_price) OVER (ORDER BY ts_event, event_id)) AS log_return FROM ticks WHERE bid_price > 0)
      SELECT event_id, round(log_return, 8) AS log_return, {", ".join(f"round(stddev_samp(log_return) OVER (ORDER BY ts_event RANGE BETWEEN INTERVAL {s} SECOND PRECEDING AND CURRENT ROW), 8) AS vol_{s}s" for s in (7200, 86400))} FROM r""",
    "three_way_labels": f"""WITH {SERIES}, d AS (SELECT sample_ts, {", ".join(f"lead(mid_price, {k}) OVER (ORDER BY i) / mid_price - 1.0 AS future_return_{k}" for k in (1, 3, 12))} FROM series)
      SELECT sample_ts, {_r([f"future_return_{k}" for k in (1, 3, 12)], 8)},
        {", ".join(f"CASE WHEN future_return_{k} > 0.02 THEN 'UP' WHEN future_return_{k} < -0.02 THEN 'DOWN' ELSE 'FLAT' END AS label_direction_{k}" for k in (1, 3, 12))} FROM d""",
    "sliding_flow": f"""WITH {v.TICKS}, t AS (SELECT *, CASE side WHEN 'buy_aggressor' THEN qty ELSE 0 END AS b, CASE side WHEN 'sell_aggressor' THEN qty ELSE 0 END AS x FROM trades)
      SELECT event_id, {", ".join(f"sum(b) OVER w{s} AS buy_{s}s, sum(x) OVER w{s} AS sell_{s}s, sum(b) OVER w{s} - sum(x) OVER w{s} AS net_{s}s, count(*) OVER w{s} AS count_{s}s, CASE WHEN sum(qty) OVER w{s} > 0 THEN round((sum(b) OVER w{s} - sum(x) OVER w{s}) / (sum(b) OVER w{s} + sum(x) OVER w{s}), 8) END AS imbalance_{s}s" for s in (600, 3600))}
      FROM t WINDOW {", ".join(f"w{s} AS (ORDER BY ts_event RANGE BETWEEN INTERVAL {s} SECOND PRECEDING AND CURRENT ROW)" for s in (600, 3600))}""",
    "lag_values": f"""WITH {v.TICKS} SELECT t.event_id, t.bid_price, a.bid_price AS bid_price_lag_60s, b.bid_price AS bid_price_lag_3600s
      FROM ticks t ASOF LEFT JOIN ticks a ON t.ts_event - INTERVAL 60 SECOND >= a.ts_event
      ASOF LEFT JOIN ticks b ON t.ts_event - INTERVAL 3600 SECOND >= b.ts_event""",
    "entity_time_split": f"""WITH f AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1),
      r AS (SELECT user_id, row_number() OVER (ORDER BY t, user_id) - 1 AS i, count(*) OVER () AS n FROM f) SELECT user_id, {_split()} FROM r""",
    "row_time_split": f"""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, {_split()} FROM r""",
    "open_close_asof": f"""WITH {v.TICKS}, {v.MARKETS} SELECT m.market_id, m.market_start_ts, m.market_end_ts, a.bid_price AS open_price, b.bid_price AS close_price,
      CASE WHEN a.bid_price IS NOT NULL AND b.bid_price IS NOT NULL THEN CAST(b.bid_price > a.bid_price AS INTEGER) END AS settled_yes
      FROM markets m ASOF LEFT JOIN ticks a ON m.market_start_ts >= a.ts_event ASOF LEFT JOIN ticks b ON m.market_end_ts >= b.ts_event""",
    "formula_prob": f"""WITH {v.EV} SELECT event_id, round({formula_sql("(value + 100)", "150.0", "((k + 1) / 100.0)", "CAST(k AS DOUBLE)")}, 6) AS p_yes,
      round({cdf_sql("(k - 50) / 10.0")}, 6) AS cdf FROM ev""",
    "terminal_gold": f"""WITH {SILVER_SERIES}, {FRESH_JOIN.replace("{extra}", "AND time_to_expiry_seconds > 0 AND time_elapsed_seconds >= 0")},
      oc AS (SELECT f.market_id, a.mid_price AS open_price, b.mid_price AS close_price FROM firsts f
        ASOF LEFT JOIN series a ON f.market_start_ts >= a.sample_ts ASOF LEFT JOIN series b ON f.market_end_ts >= b.sample_ts),
      t AS (SELECT r.*, oc.open_price, oc.close_price, {formula_sql("mid_price", "oc.open_price", "realized_vol_12", "time_to_expiry_seconds")} AS formula_p_yes FROM ready r LEFT JOIN oc USING (market_id))
      SELECT market_id, sample_ts, market_start_ts, matched_series_ts, series_age_seconds, mid_price AS current_price, open_price, close_price,
        round(mid_price / open_price - 1.0, 6) AS return_since_open, round(mid_price - open_price, 6) AS distance_to_open,
        round(formula_p_yes, 6) AS formula_p_yes, round(formula_p_yes - yes_ask, 6) AS edge_to_yes_ask, round(1.0 - formula_p_yes - no_ask, 6) AS edge_to_no_ask,
        CASE WHEN open_price IS NOT NULL AND close_price IS NOT NULL THEN CAST(close_price > open_price AS INTEGER) END AS settled_yes, 'proxy' AS label_source, split
      FROM t LEFT JOIN splits USING (market_id)""",
    "repricing_gold": f"""WITH {SILVER_SERIES}, {FRESH_JOIN.replace("{extra}", "")},
      l AS (SELECT *, lead(yes_mid, 1) OVER w AS f1, lead(yes_mid, 3) OVER w AS f3 FROM ready WINDOW w AS (PARTITION BY market_id ORDER BY sample_ts))
      SELECT market_id, sample_ts, round(yes_mid, 6) AS yes_mid, round(f1, 6) AS future_yes_mid_1, round(f3, 6) AS future_yes_mid_3,
        round(f1 - yes_mid, 6) AS markout_1, round(f3 - yes_mid, 6) AS markout_3,
        CASE WHEN f1 - yes_mid > 0.05 THEN 'UP' WHEN f1 - yes_mid < -0.05 THEN 'DOWN' ELSE 'FLAT' END AS label_reprice_1,
        CASE WHEN f3 - yes_mid > 0.05 THEN 'UP' WHEN f3 - yes_mid < -0.05 THEN 'DOWN' ELSE 'FLAT' END AS label_reprice_3, split
      FROM l LEFT JOIN splits USING (market_id)""",
    "executable_grid": f"""WITH {EXEC} SELECT market_id, sample_ts, latency_seconds, exit_horizon_seconds, entry_quote_ts, exit_quote_ts,
        {_r(["pnl_up", "roi_up", "pnl_down", "roi_down"])}, label_up_profitable, label_down_profitable FROM exe""",
    "executable_label_rates": f"""WITH {EXEC} SELECT latency_seconds, exit_horizon_seconds, count(*) AS rows, round(avg(label_up_profitable), 6) AS up_profitable_rate,
        round(avg(pnl_up), 6) AS avg_pnl_up, round(avg(label_down_profitable), 6) AS down_profitable_rate, round(avg(pnl_down), 6) AS avg_pnl_down FROM exe GROUP BY 1, 2""",
    "event_time_grid": f"""WITH {cq.silver_sql(14400)},
      times AS (SELECT DISTINCT market_id, ts_event AS sample_ts FROM quotes WHERE update_bid IS NOT NULL OR update_ask IS NOT NULL),
      based AS (SELECT t.market_id, t.sample_ts, s.time_to_expiry_seconds FROM times t ASOF JOIN silver2 s ON s.market_id = t.market_id AND t.sample_ts >= s.sample_ts
                WHERE t.sample_ts - s.sample_ts <= INTERVAL 4 HOUR),
      combos AS (SELECT a.l AS lat, h.h AS hor FROM (VALUES (0), (3600)) a(l), (VALUES (14400), (28800)) h(h)),
      leftside AS (SELECT *, sample_ts + lat * INTERVAL 1 SECOND AS entry_time, sample_ts + (lat + hor) * INTERVAL 1 SECOND AS exit_time
        FROM based, combos WHERE time_to_expiry_seconds >= lat + hor),
      ex AS (SELECT l.*, e.sample_ts AS entry_quote_ts, x.sample_ts AS exit_quote_ts, x.yes_bid - e.yes_ask AS pnl_up, x.no_bid - e.no_ask AS pnl_down
        FROM leftside l ASOF JOIN silver2 e ON e.market_id = l.market_id AND l.entry_time <= e.sample_ts
        ASOF JOIN silver2 x ON x.market_id = l.market_id AND l.exit_time <= x.sample_ts
        WHERE e.sample_ts - l.entry_time <= INTERVAL 4 HOUR AND x.sample_ts - l.exit_time <= INTERVAL 4 HOUR
          AND e.yes_ask IS NOT NULL AND e.no_ask IS NOT NULL AND x.yes_bid IS NOT NULL AND x.no_bid IS NOT NULL
          AND NOT (e.yes_is_stale OR e.no_is_stale OR x.yes_is_stale OR x.no_is_stale OR e.yes_crossed_quote OR e.no_crossed_quote OR x.yes_crossed_quote OR x.no_crossed_quote))
      SELECT market_id, sample_ts, CAST(lat AS DOUBLE) AS latency_seconds, CAST(hor AS DOUBLE) AS exit_horizon_seconds, entry_quote_ts, exit_quote_ts,
        {_r(["pnl_up", "pnl_down"])}, CAST(pnl_up > 0 AS INTEGER) AS label_up_profitable, CAST(pnl_down > 0 AS INTEGER) AS label_down_profitable FROM ex""",
}
