"""The given tables seen as quotes, trades, markets and predictions.

Each Spark view has a twin as a DuckDB common table expression, written from the
same rule, so a query and its SQL check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as fn
from tidemark.session import configure


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, with zone-less timestamps read as UTC."""
    configure(spark)
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EV = "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def naive(col: str):
    """A timestamp as DuckDB shows it: without zone."""
    return F.col(col).cast("timestamp_ntz").alias(col)


# --- quotes: market = user, asset = parity of the event id ------------------------


def _asset():
    return F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "-Y").otherwise("-N"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """``view`` events: both sides of the book."""
    return events(spark, sf).where("event_type = 'view'").select(
        F.col("user_id").cast("string").alias("market_id"),
        _asset().alias("asset_id"),
        F.col("ts").alias("ts_event"),
        F.col("ts").alias("ts_recv"),
        (F.col("value") / 500).alias("best_bid"),
        (F.col("value") / 500 + 0.02).alias("best_ask"),
        F.col("k").cast("double").alias("bid_size_1"),
        (F.col("k") % 7 + 1).cast("double").alias("ask_size_1"),
        F.lit("snapshots").alias("source_file"),
    )


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """``click`` events move the ask only, ``error`` events are trades."""
    click = F.col("event_type") == "click"
    return events(spark, sf).where("event_type IN ('click', 'error')").select(
        F.col("user_id").cast("string").alias("market_id"),
        _asset().alias("asset_id"),
        F.col("ts").alias("ts_event"),
        F.col("ts").alias("ts_recv"),
        F.lit(None).cast("double").alias("best_bid"),
        F.when(click, F.col("value") / 500 + 0.01).alias("best_ask"),
        F.when(~click, F.col("value") / 500).alias("price"),
        F.lit("price_change").alias("event_type"),
        F.lit("changes").alias("source_file"),
    )


QUOTES = f"""{EV},
quotes AS (
  SELECT CAST(user_id AS VARCHAR) AS market_id,
         CAST(user_id AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '-Y' ELSE '-N' END AS asset_id,
         ts AS ts_event,
         CASE event_type WHEN 'view' THEN 'orderbook' ELSE 'price_change' END AS source,
         CASE WHEN event_type = 'view' AND value / 500 BETWEEN 0 AND 1 THEN value / 500 END AS update_bid,
         CASE WHEN event_type = 'view' AND value / 500 + 0.02 BETWEEN 0 AND 1 THEN value / 500 + 0.02
              WHEN event_type = 'click' AND value / 500 + 0.01 BETWEEN 0 AND 1 THEN value / 500 + 0.01 END AS update_ask,
         CASE WHEN event_type = 'view' THEN CAST(k AS DOUBLE) END AS update_bid_size,
         CASE WHEN event_type = 'view' THEN CAST(k % 7 + 1 AS DOUBLE) END AS update_ask_size,
         CASE WHEN event_type = 'error' AND value / 500 BETWEEN 0 AND 1 THEN value / 500 END AS last_trade_price
  FROM ev WHERE event_type IN ('view', 'click', 'error')
)"""

# forward-filled state per asset, the plain window way
STATE = f"""{QUOTES},
state AS (
  SELECT market_id, asset_id, ts_event, source,
    last_value(update_bid IGNORE NULLS) OVER w AS current_bid,
    last_value(update_ask IGNORE NULLS) OVER w AS current_ask,
    last_value(update_bid_size IGNORE NULLS) OVER w AS current_bid_size,
    last_value(update_ask_size IGNORE NULLS) OVER w AS current_ask_size,
    last_value(CASE WHEN update_bid IS NOT NULL OR update_ask IS NOT NULL THEN ts_event END IGNORE NULLS) OVER w AS last_quote_update_ts,
    last_value(last_trade_price IGNORE NULLS) OVER w AS last_trade_price
  FROM quotes
  WINDOW w AS (PARTITION BY market_id, asset_id ORDER BY ts_event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def markets(spark: SparkSession, sf: str) -> DataFrame:
    """One market per user, from midnight of its first event to midnight after its last."""
    ev = table(spark, sf, "events")
    span = ev.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    m = F.col("user_id").cast("string")
    return span.select(
        m.alias("market_id"),
        F.concat(m, F.lit("-Y")).alias("yes_asset_id"),
        F.concat(m, F.lit("-N")).alias("no_asset_id"),
        F.lit("ok").alias("mapping_status"),
        F.date_trunc("day", "first_ts").alias("market_start_ts"),
        F.date_trunc("day", F.col("last_ts") + F.expr("INTERVAL 1 DAY")).alias("market_end_ts"),
    )


MARKETS = """markets AS (
  SELECT CAST(user_id AS VARCHAR) AS market_id,
         CAST(user_id AS VARCHAR) || '-Y' AS yes_asset_id,
         CAST(user_id AS VARCHAR) || '-N' AS no_asset_id,
         date_trunc('day', min(ts)) AS market_start_ts,
         date_trunc('day', max(ts)) + INTERVAL 1 DAY AS market_end_ts
  FROM events GROUP BY user_id
)"""


# --- one instrument: every event is a tick ----------------------------------------


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Best quotes of a single instrument: one hot key."""
    price = F.col("value") + 100
    return events(spark, sf).select(
        F.col("ts").alias("ts_event"),
        F.lit("ALL").alias("symbol"),
        price.alias("bid_price"),
        (price + 0.5).alias("ask_price"),
        (F.col("k") + 1).cast("double").alias("bid_qty"),
        (F.lit(100) - F.col("k")).cast("double").alias("ask_qty"),
        "event_id",
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("event_type IN ('purchase', 'signup')").select(
        F.col("ts").alias("ts_event"),
        F.lit("ALL").alias("symbol"),
        F.when(F.col("event_type") == "purchase", "buy_aggressor").otherwise("sell_aggressor").alias("side"),
        F.col("k").cast("double").alias("qty"),
        F.col("value").alias("price"),
        "event_id",
    )


TICKS = f"""{EV},
ticks AS (SELECT ts AS ts_event, value + 100 AS bid_price, value + 100 + 0.5 AS ask_price,
                 CAST(k + 1 AS DOUBLE) AS bid_qty, CAST(100 - k AS DOUBLE) AS ask_qty, event_id FROM ev),
trades AS (SELECT ts AS ts_event, CASE event_type WHEN 'purchase' THEN 'buy_aggressor' ELSE 'sell_aggressor' END AS side,
                  CAST(k AS DOUBLE) AS qty, value AS price, event_id
           FROM ev WHERE event_type IN ('purchase', 'signup'))"""


# --- predictions -------------------------------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One scored sample per event: probabilities, executable quotes, outcome, time left.

    Values are exponential with mean 50, so ``p_up`` is close to uniform; it is rounded
    to 4 digits and therefore has many ties.
    """
    p = F.round(1 - F.exp(-F.col("value") / 50), 4)
    ask = (F.col("k") + 1) / 102
    left = 300 - (F.unix_timestamp("ts") % 300)
    return events(spark, sf).select(
        "event_id",
        F.col("user_id").cast("string").alias("market_id"),
        F.col("ts").alias("sample_ts"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        left.cast("double").alias("time_to_expiry_seconds"),
        fn.bucket_label(left, fn.TIME_LEFT).alias("tte_bucket"),
        p.alias("p_up"),
        F.round(1 - p, 4).alias("p_down"),
        ask.alias("yes_ask"),
        F.greatest(ask - 0.02, F.lit(0.0)).alias("yes_bid"),
        (1 - F.greatest(ask - 0.02, F.lit(0.0))).alias("no_ask"),
        (1 - ask).alias("no_bid"),
        (F.col("k") % 2).alias("settled_yes"),
        F.when(F.col("user_id") % 3 == 0, "real").otherwise("proxy").alias("label_source"),
        (F.col("k") % 10).cast("double").alias("quote_age_seconds"),
    )


# first bucket that fits, as in the bucket table
TTE_CASE = """CASE WHEN {c} BETWEEN 240 AND 300 THEN '[240,300]' WHEN {c} >= 180 AND {c} < 240 THEN '[180,240)'
  WHEN {c} >= 120 AND {c} < 180 THEN '[120,180)' WHEN {c} >= 60 AND {c} < 120 THEN '[60,120)'
  WHEN {c} >= 30 AND {c} < 60 THEN '[30,60)' WHEN {c} >= 10 AND {c} < 30 THEN '[10,30)'
  WHEN {c} >= 0 AND {c} < 10 THEN '[0,10)' END"""

PRED = f"""{EV},
pred0 AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS market_id, ts AS sample_ts, strftime(ts, '%Y-%m-%d') AS date,
    CAST(300 - (CAST(floor(epoch(ts)) AS BIGINT) % 300) AS DOUBLE) AS time_to_expiry_seconds,
    round(1 - exp(-value / 50), 4) AS p_up,
    round(1 - round(1 - exp(-value / 50), 4), 4) AS p_down,
    CAST(k + 1 AS DOUBLE) / 102 AS yes_ask,
    greatest(CAST(k + 1 AS DOUBLE) / 102 - 0.02, 0.0) AS yes_bid,
    1 - greatest(CAST(k + 1 AS DOUBLE) / 102 - 0.02, 0.0) AS no_ask,
    1 - CAST(k + 1 AS DOUBLE) / 102 AS no_bid,
    k % 2 AS settled_yes,
    CASE WHEN user_id % 3 = 0 THEN 'real' ELSE 'proxy' END AS label_source,
    CAST(k % 10 AS DOUBLE) AS quote_age_seconds
  FROM ev),
pred AS (SELECT *, {TTE_CASE.format(c='time_to_expiry_seconds')} AS tte_bucket FROM pred0)"""
