"""Queries on quote state, grids and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import views as v
from tidemark.functions import scalars as fn
from tidemark.operators.asof import asof_join, nearest_join
from tidemark.operators.scan import forward_fill
from tidemark.plans import quotes as q
from tidemark.session import stage

TTL = 86_400
GRID = 1_800


def quote_events(spark, sf):
    return q.normalize_quote_events(v.snapshots(spark, sf), v.changes(spark, sf))


def quote_events_normalized(spark, sf):
    return quote_events(spark, sf).select(
        "market_id", "asset_id", v.naive("ts_event"), "source", "update_bid", "update_ask",
        "update_bid_size", "update_ask_size", "last_trade_price",
    )


def quote_state_ffill(spark, sf):
    st = q.asset_quote_state(quote_events(spark, sf), bucket_seconds=None)
    return st.select(
        "market_id", "asset_id", v.naive("ts_event"), "source", "current_bid", "current_ask",
        "current_bid_size", "current_ask_size", "mid", "spread", "crossed_quote",
        v.naive("last_quote_update_ts"), "last_trade_price",
    )


def grid_stale_rate(spark, sf):
    """Hourly samples of every asset's last quote: stale and crossed rates per day."""
    m = v.markets(spark, sf)
    assets = m.select("market_id", "market_start_ts", "market_end_ts", F.explode(F.array("yes_asset_id", "no_asset_id")).alias("asset_id"))
    state = stage(q.asset_quote_state(quote_events(spark, sf)), "asset_state")
    on_grid = q.state_on_spans(
        assets, state, start="market_start_ts", end="market_end_ts", step_seconds=3_600, ttl_seconds=TTL, bucket_seconds=5 * 86_400
    )
    return on_grid.groupBy(F.date_format("sample_ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("samples"),
        F.round(F.avg(F.col("is_stale").cast("double")), 6).alias("stale_rate"),
        F.round(F.avg(F.col("crossed_quote").cast("double")), 6).alias("crossed_rate"),
        F.round(F.avg("quote_age_seconds"), 3).alias("avg_age"),
    )


def market_silver_frame(spark, sf, step=GRID):
    return q.market_silver(
        v.markets(spark, sf), quote_events(spark, sf), ttl_seconds=TTL, step_seconds=step, bucket_seconds=5 * 86_400,
        stage=stage,
    )


def market_silver(spark, sf):
    s = market_silver_frame(spark, sf, 14_400)
    return s.select(
        v.naive("sample_ts"), "market_id", "yes_asset_id", "no_asset_id", "yes_bid", "yes_ask", "yes_mid", "yes_spread",
        "yes_bid_size", "yes_ask_size", F.round("yes_size_imbalance_1", 9).alias("yes_size_imbalance_1"),
        "yes_quote_age_seconds", "yes_is_stale", "no_bid", "no_ask", "no_mid", "no_quote_age_seconds", "no_is_stale",
        F.round("pair_bid_sum", 9).alias("pair_bid_sum"), F.round("pair_ask_sum", 9).alias("pair_ask_sum"),
        F.round("pair_mid_sum", 9).alias("pair_mid_sum"), "seconds_since_last_update",
        F.round("yes_mid_change_1_past", 9).alias("yes_mid_change_1_past"),
        F.round("yes_mid_change_5_past", 9).alias("yes_mid_change_5_past"),
        "time_elapsed_seconds", "time_to_expiry_seconds", v.naive("yes_last_quote_update_ts"),
        "yes_crossed_quote", "no_crossed_quote", "quote_state_available", "date",
    )


def asof_backward_user(spark, sf):
    """Each purchase with the user's last view at or before it."""
    ev = v.table(spark, sf, "events")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    out = asof_join(left, right, on=["user_id"], left_ts="ts", right_ts="view_ts", match_ts="matched_ts")
    return out.select("event_id", "user_id", v.naive("ts"), v.naive("matched_ts"), "view_value")


def asof_backward_tol(spark, sf):
    ev = v.table(spark, sf, "events")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    out = asof_join(
        left, right, on=["user_id"], left_ts="ts", right_ts="view_ts", tolerance=43_200, match_ts="matched_ts"
    )
    return out.select("event_id", v.naive("matched_ts"), "view_value")


def asof_forward_tol(spark, sf):
    """Each view with the user's next click within two days."""
    ev = v.table(spark, sf, "events")
    left = ev.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("value").alias("click_value"))
    out = asof_join(
        left, right, on=["user_id"], left_ts="ts", right_ts="click_ts", direction="forward",
        tolerance=172_800, match_ts="matched_ts",
    )
    return out.select("event_id", "user_id", v.naive("matched_ts"), "click_value")


def asof_forward_open(spark, sf):
    ev = v.table(spark, sf, "events")
    left = ev.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("value").alias("click_value"))
    out = asof_join(
        left, right, on=["user_id"], left_ts="ts", right_ts="click_ts", direction="forward", match_ts="matched_ts"
    )
    return out.select("event_id", v.naive("matched_ts"), "click_value")


def asof_bucketed_single(spark, sf):
    """One hot series: every view gets the last purchase of anybody."""
    ev = v.table(spark, sf, "events")
    left = ev.where("event_type = 'view'").select("event_id", "ts")
    right = ev.where("event_type = 'purchase'").select(F.col("ts").alias("p_ts"), F.col("value").alias("p_value"))
    out = asof_join(left, right, left_ts="ts", right_ts="p_ts", match_ts="matched_ts")
    return out.select("event_id", v.naive("matched_ts"), "p_value")


def nearest_match(spark, sf):
    """Each purchase with the user's nearest view in time."""
    ev = v.table(spark, sf, "events")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    out = nearest_join(left, right, on=["user_id"], left_ts="ts", right_ts="view_ts", right_cols=["view_value"])
    return out.select("event_id", v.naive("nearest_ts"), F.round("abs_ms", 3).alias("abs_ms"), "view_value")


def fill_signup_value(spark, sf):
    """Running last sign-up value and time on one series without a key."""
    ev = v.table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    up = F.col("event_type") == "signup"
    out = forward_fill(
        ev, keys=[], ts="ts", tie=["event_id"],
        fills={"last_signup_value": F.when(up, F.col("value")), "last_signup_ts": F.when(up, F.col("ts"))},
    )
    return out.select("event_id", "last_signup_value", v.naive("last_signup_ts"))


def quote_pair_constraints(spark, sf):
    """Sums, complements and differences of the two sides per market."""
    s = q.add_quote_derived(
        market_silver_frame(spark, sf, 14_400).drop("pair_bid_sum", "pair_ask_sum", "pair_mid_sum")
    )
    cols = ["pair_bid_sum", "pair_ask_sum", "pair_mid_sum", "yes_bid_vs_no_ask_complement",
            "yes_ask_vs_no_bid_complement", "yes_bid_minus_no_bid", "yes_ask_minus_no_ask", "yes_mid_minus_no_mid"]
    return s.groupBy("market_id").agg(
        *[F.round(F.avg(c), 6).alias(c) for c in cols],
        F.round(F.sum(F.abs("yes_mid_change_1_past")), 6).alias("yes_abs_change"),
    )


GRID_SQL = """, grid AS (
  SELECT m.*, g.i AS grid_idx, m.market_start_ts + g.i * INTERVAL {step} SECOND AS sample_ts
  FROM markets m, LATERAL (SELECT unnest(generate_series(0, CAST(epoch(m.market_end_ts) - epoch(m.market_start_ts) AS BIGINT) // {step})) AS i) g
)"""

_AGE = "CAST((epoch_us(sample_ts) - epoch_us({c})) // 1000 AS DOUBLE) / 1000.0"

SILVER_SQL = f"""{v.STATE}, {v.MARKETS}""" + GRID_SQL + """,
sampled AS (
  SELECT g.*, y.current_bid AS yes_bid, y.current_ask AS yes_ask, (y.current_bid + y.current_ask) / 2.0 AS yes_mid,
    y.current_ask - y.current_bid AS yes_spread, y.current_bid_size AS yes_bid_size, y.current_ask_size AS yes_ask_size,
    y.last_quote_update_ts AS yes_last_quote_update_ts, coalesce(y.current_bid > y.current_ask, false) AS yes_crossed_quote,
    n.current_bid AS no_bid, n.current_ask AS no_ask, (n.current_bid + n.current_ask) / 2.0 AS no_mid,
    n.last_quote_update_ts AS no_last_quote_update_ts, coalesce(n.current_bid > n.current_ask, false) AS no_crossed_quote,
    greatest(coalesce(y.ts_event, n.ts_event), coalesce(n.ts_event, y.ts_event)) AS last_market_update_ts
  FROM grid g
  ASOF LEFT JOIN state y ON y.asset_id = g.yes_asset_id AND g.sample_ts >= y.ts_event
  ASOF LEFT JOIN state n ON n.asset_id = g.no_asset_id AND g.sample_ts >= n.ts_event
),
silver AS (
  SELECT *, """ + _AGE.format(c="yes_last_quote_update_ts") + """ AS yes_quote_age_seconds,
    """ + _AGE.format(c="no_last_quote_update_ts") + """ AS no_quote_age_seconds,
    """ + _AGE.format(c="last_market_update_ts") + """ AS seconds_since_last_update,
    CASE WHEN yes_bid_size + yes_ask_size > 0 THEN (yes_bid_size - yes_ask_size) / (yes_bid_size + yes_ask_size) END AS yes_size_imbalance_1,
    yes_bid + no_bid AS pair_bid_sum, yes_ask + no_ask AS pair_ask_sum, yes_mid + no_mid AS pair_mid_sum,
    yes_mid - lag(yes_mid, 1) OVER w AS yes_mid_change_1_past, yes_mid - lag(yes_mid, 5) OVER w AS yes_mid_change_5_past,
    CAST(epoch(sample_ts) - epoch(market_start_ts) AS DOUBLE) AS time_elapsed_seconds,
    CAST(epoch(market_end_ts) - epoch(sample_ts) AS DOUBLE) AS time_to_expiry_seconds,
    yes_last_quote_update_ts IS NOT NULL AND no_last_quote_update_ts IS NOT NULL AS quote_state_available,
    strftime(sample_ts, '%Y-%m-%d') AS date
  FROM sampled WINDOW w AS (PARTITION BY market_id ORDER BY grid_idx)
),
silver2 AS (
  SELECT *,
    yes_bid IS NULL OR yes_ask IS NULL OR yes_last_quote_update_ts IS NULL OR yes_quote_age_seconds > {ttl} AS yes_is_stale,
    no_bid IS NULL OR no_ask IS NULL OR no_last_quote_update_ts IS NULL OR no_quote_age_seconds > {ttl} AS no_is_stale
  FROM silver
)"""


def silver_sql(step: int, ttl: int = TTL) -> str:
    return SILVER_SQL.replace("{step}", str(step)).replace("{ttl}", str(ttl))


QUERIES = {
    "quote_events_normalized": quote_events_normalized,
    "quote_state_ffill": quote_state_ffill,
    "grid_stale_rate": grid_stale_rate,
    "market_silver": market_silver,
    "asof_backward_user": asof_backward_user,
    "asof_backward_tol": asof_backward_tol,
    "asof_forward_tol": asof_forward_tol,
    "asof_forward_open": asof_forward_open,
    "asof_bucketed_single": asof_bucketed_single,
    "nearest_match": nearest_match,
    "fill_signup_value": fill_signup_value,
    "quote_pair_constraints": quote_pair_constraints,
}

_PURCHASE_VIEW = """p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
  w AS (SELECT user_id, ts AS view_ts, value AS view_value FROM events WHERE event_type = 'view')"""
_VIEW_CLICK = """p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
  w AS (SELECT user_id, ts AS click_ts, value AS click_value FROM events WHERE event_type = 'click')"""

ORACLES = {
    "quote_events_normalized": f"WITH {v.QUOTES} SELECT * FROM quotes",
    "quote_state_ffill": f"""WITH {v.STATE} SELECT *, (current_bid + current_ask) / 2.0 AS mid,
        current_ask - current_bid AS spread, coalesce(current_bid > current_ask, false) AS crossed_quote FROM state""",
    "grid_stale_rate": f"""WITH {v.STATE}, {v.MARKETS}{GRID_SQL.replace("{step}", "3600")},
      assets AS (SELECT market_id, sample_ts, yes_asset_id AS asset_id FROM grid UNION ALL SELECT market_id, sample_ts, no_asset_id FROM grid),
      j AS (SELECT a.sample_ts, s.current_bid, s.current_ask, s.last_quote_update_ts,
              {_AGE.format(c="s.last_quote_update_ts").replace("sample_ts", "a.sample_ts")} AS age
            FROM assets a ASOF LEFT JOIN state s ON s.asset_id = a.asset_id AND a.sample_ts >= s.ts_event)
      SELECT strftime(sample_ts, '%Y-%m-%d') AS day, count(*) AS samples,
        round(avg(CASE WHEN current_bid IS NULL OR current_ask IS NULL OR last_quote_update_ts IS NULL OR age > {TTL} THEN 1.0 ELSE 0.0 END), 6) AS stale_rate,
        round(avg(CASE WHEN current_bid > current_ask THEN 1.0 ELSE 0.0 END), 6) AS crossed_rate,
        round(avg(age), 3) AS avg_age FROM j GROUP BY 1""",
    "market_silver": f"""WITH {silver_sql(14400)} SELECT sample_ts, market_id, yes_asset_id, no_asset_id, yes_bid, yes_ask, yes_mid,
        yes_spread, yes_bid_size, yes_ask_size, round(yes_size_imbalance_1, 9) AS yes_size_imbalance_1, yes_quote_age_seconds,
        yes_is_stale, no_bid, no_ask, no_mid, no_quote_age_seconds, no_is_stale, round(pair_bid_sum, 9) AS pair_bid_sum,
        round(pair_ask_sum, 9) AS pair_ask_sum, round(pair_mid_sum, 9) AS pair_mid_sum, seconds_since_last_update,
        round(yes_mid_change_1_past, 9) AS yes_mid_change_1_past, round(yes_mid_change_5_past, 9) AS yes_mid_change_5_past,
        time_elapsed_seconds, time_to_expiry_seconds, yes_last_quote_update_ts, yes_crossed_quote, no_crossed_quote,
        quote_state_available, date FROM silver2""",
    "asof_backward_user": f"""WITH {_PURCHASE_VIEW} SELECT p.event_id, p.user_id, p.ts, w.view_ts AS matched_ts, w.view_value
        FROM p ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.ts >= w.view_ts""",
    "asof_backward_tol": f"""WITH {_PURCHASE_VIEW} SELECT p.event_id,
        CASE WHEN epoch_us(p.ts) - epoch_us(w.view_ts) <= 43200000000 THEN w.view_ts END AS matched_ts,
        CASE WHEN epoch_us(p.ts) - epoch_us(w.view_ts) <= 43200000000 THEN w.view_value END AS view_value
        FROM p ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.ts >= w.view_ts""",
    "asof_forward_tol": f"""WITH {_VIEW_CLICK} SELECT p.event_id, p.user_id,
        CASE WHEN epoch_us(w.click_ts) - epoch_us(p.ts) <= 172800000000 THEN w.click_ts END AS matched_ts,
        CASE WHEN epoch_us(w.click_ts) - epoch_us(p.ts) <= 172800000000 THEN w.click_value END AS click_value
        FROM p ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.ts <= w.click_ts""",
    "asof_forward_open": f"""WITH {_VIEW_CLICK} SELECT p.event_id, w.click_ts AS matched_ts, w.click_value
        FROM p ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.ts <= w.click_ts""",
    "asof_bucketed_single": """WITH p AS (SELECT ts AS p_ts, value AS p_value FROM events WHERE event_type = 'purchase')
        SELECT e.event_id, p.p_ts AS matched_ts, p.p_value FROM (SELECT event_id, ts FROM events WHERE event_type = 'view') e
        ASOF LEFT JOIN p ON e.ts >= p.p_ts""",
    "nearest_match": f"""WITH {_PURCHASE_VIEW},
        j AS (SELECT p.event_id, w.view_ts, w.view_value, abs(epoch_us(p.ts) - epoch_us(w.view_ts)) AS d,
                row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(w.view_ts)), w.view_ts) AS rn
              FROM p LEFT JOIN w ON p.user_id = w.user_id)
        SELECT event_id, view_ts AS nearest_ts, round(d / 1000.0, 3) AS abs_ms, view_value FROM j WHERE rn = 1""",
    "fill_signup_value": """SELECT event_id,
        last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER w AS last_signup_value,
        last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER w AS last_signup_ts
        FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "quote_pair_constraints": f"""WITH {silver_sql(14400)} SELECT market_id, round(avg(pair_bid_sum), 6) AS pair_bid_sum,
        round(avg(pair_ask_sum), 6) AS pair_ask_sum, round(avg(pair_mid_sum), 6) AS pair_mid_sum,
        round(avg(yes_bid + no_ask), 6) AS yes_bid_vs_no_ask_complement, round(avg(yes_ask + no_bid), 6) AS yes_ask_vs_no_bid_complement,
        round(avg(yes_bid - no_bid), 6) AS yes_bid_minus_no_bid, round(avg(yes_ask - no_ask), 6) AS yes_ask_minus_no_ask,
        round(avg(yes_mid - no_mid), 6) AS yes_mid_minus_no_mid, round(sum(abs(yes_mid_change_1_past)), 6) AS yes_abs_change
        FROM silver2 GROUP BY market_id""",
}
