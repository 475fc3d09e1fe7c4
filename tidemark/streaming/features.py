"""The live feature row: both sides of a market after every event, and plain columns on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import scalars as fn
from tidemark.operators.asof import asof_join
from tidemark.operators.scan import micros
from tidemark.session import stage
from tidemark.streaming.state import pair_state

SIDES = ("yes", "no")


def live_features(events: DataFrame, *, ttl_seconds: float, tie: str = "row_id") -> DataFrame:
    """One row per quote event with the base features of its market.

    Side features (mid, spread, size imbalance, quote age, stale, crossed) and pair features
    (sums, differences) are columns over ``pair_state``; derived features can be added to the
    result like to a table.
    """
    out = pair_state(events, tie=tie)
    made: dict[str, Column] = {}
    for side in SIDES:
        bid, ask, updated = F.col(f"{side}_bid"), F.col(f"{side}_ask"), F.col(f"{side}_update_us")
        age = (F.col("ts_us") - updated) / 1e6
        made[f"{side}_mid"] = fn.mid_price(f"{side}_bid", f"{side}_ask")
        made[f"{side}_spread"] = ask - bid
        made[f"{side}_size_imbalance"] = fn.imbalance(f"{side}_bid_size", f"{side}_ask_size")
        made[f"{side}_quote_age_seconds"] = age
        made[f"{side}_is_stale"] = bid.isNull() | ask.isNull() | updated.isNull() | (age > ttl_seconds)
        made[f"{side}_crossed"] = F.coalesce(bid > ask, F.lit(False))
    out = out.withColumns(made)
    pair = {f"pair_{kind}_sum": F.col(f"yes_{kind}") + F.col(f"no_{kind}") for kind in ("bid", "ask", "mid")}
    pair["mid_difference"] = F.col("yes_mid") - F.col("no_mid")
    pair["quote_bad"] = F.col("yes_is_stale") | F.col("no_is_stale") | F.col("yes_crossed") | F.col("no_crossed")
    return out.withColumns(pair)


def market_opens(
    prices: DataFrame, markets: DataFrame, path: str, checkpoint: str, *, on: str, ts: str, tie: str, price: str
) -> StreamingQuery:
    """The first price seen inside each market's window: one row per market, as it opens.

    ``prices`` is a stream keyed by ``on``; ``markets`` a table (``on``, market_id,
    market_start_ts, market_end_ts). Each micro-batch looks up the markets that are not open yet
    with one forward as-of join, so no price meets every market of its key, and writes those that
    open to ``path``; a repeated batch replaces itself. Read the rows with ``opened_markets``.
    """
    spark = prices.sparkSession
    schema = _opened_schema(prices, markets, ts, price)
    begins, ends = micros("market_start_ts"), micros("market_end_ts")
    windows = stage(markets.select(on, "market_id", "market_start_ts", "market_end_ts").where(F.col(on).isNotNull() & (begins < ends)), "market_windows")

    def write(batch: DataFrame, batch_id: int) -> None:
        first = F.min(F.struct(F.col(tie).isNull(), F.col(tie), F.col(price).alias("open_price"))).alias("__first")
        seen = batch.where(F.col(on).isNotNull() & F.col(ts).isNotNull()).groupBy(on, F.col(ts).alias("open_seen_ts")).agg(first)
        seen = stage(seen, "market_prices")
        waiting = windows
        if batch_id:
            done = spark.read.schema(schema).parquet(*[f"{path}/batch={i}" for i in range(batch_id)]).select(F.col("market_id").alias("__done"))
            waiting = windows.join(done, F.col("market_id").eqNullSafe(F.col("__done")), "left_anti")
        found = asof_join(
            waiting, seen, on=[on], left_ts="market_start_ts", right_ts="open_seen_ts", direction="forward", right_cols=["__first"], match_ts="open_seen_ts"
        ).where(micros("open_seen_ts") < ends)
        row = F.struct(micros("open_seen_ts"), F.col("__first"), F.col("open_seen_ts").alias("at"))
        best = found.groupBy("market_id").agg(F.min(row).alias("__row"))
        out = best.select("market_id", F.col("__row.at").alias("open_seen_ts"), F.col("__row.__first.open_price").alias("open_price"))
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return prices.select(on, ts, tie, price).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _opened_schema(prices: DataFrame, markets: DataFrame, ts: str, price: str) -> T.StructType:
    return T.StructType([
        T.StructField("market_id", markets.schema["market_id"].dataType), T.StructField("open_seen_ts", prices.schema[ts].dataType),
        T.StructField("open_price", prices.schema[price].dataType),
    ])


def opened_markets(prices: DataFrame, markets: DataFrame, path: str, *, ts: str, price: str) -> DataFrame:
    """Rows written by ``market_opens``: market_id, open_seen_ts, open_price."""
    return prices.sparkSession.read.schema(_opened_schema(prices, markets, ts, price)).parquet(path).drop("batch")
