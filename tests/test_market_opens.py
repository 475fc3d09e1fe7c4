"""Market opens: one row a market, without a pair of every price and every market of a symbol."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import features, sources

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def opened(spark, folder, batches, markets):
    schema = "symbol string, ts timestamp, id long, px double"
    for rows in batches:
        data = [(s, None if t is None else T0 + dt.timedelta(seconds=t), i, p) for s, t, i, p in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    prices = sources.file_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    query = features.market_opens(prices, markets, f"{folder}/out", f"{folder}/cp", on="symbol", ts="ts", tie="id", price="px")
    query.awaitTermination()
    return features.opened_markets(prices, markets, f"{folder}/out", ts="ts", price="px")


def test_first_price_inside_the_window(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("s", "a", at(0), at(100)), ("s", "b", at(50), at(60)), ("s", "c", at(70), at(200)), ("s", None, at(10), at(99)), (None, "d", at(0), at(99)), ("u", "e", at(0), at(99))]
    markets = spark.createDataFrame(rows, "symbol string, market_id string, market_start_ts timestamp, market_end_ts timestamp")
    batches = [[("s", 5, 2, 2.0), ("s", 5, 1, 1.0), ("s", None, 0, 9.0), (None, 5, 4, 9.0)], [("s", 20, 5, 3.0), ("s", 60, 6, 4.0)], [("s", 70, 8, None), ("s", 80, 9, 5.0)]]
    got = {r.market_id: ((r.open_seen_ts.replace(tzinfo=dt.timezone.utc) - T0).total_seconds(), r.open_price) for r in opened(spark, str(tmp_path), batches, markets).collect()}
    assert got == {"a": (5, 1.0), None: (20, 3.0), "c": (70, None)}


def test_no_pairs_of_prices_and_markets(spark, tmp_path):
    """20,000 prices and 20,000 markets of one symbol: their pairs would be 200 million rows."""
    n = 20_000
    second = lambda c: F.timestamp_seconds(F.unix_timestamp(F.lit(T0)) + c)
    ids = spark.range(n)
    ids.select(F.lit("s").alias("symbol"), second(F.col("id")).alias("ts"), "id", F.col("id").cast("double").alias("px")).coalesce(1).write.parquet(f"{tmp_path}/in")
    markets = ids.select(F.lit("s").alias("symbol"), F.col("id").cast("string").alias("market_id"), second(F.col("id")).alias("market_start_ts"), second(F.col("id") + n).alias("market_end_ts"))
    out = opened(spark, str(tmp_path), [], markets)
    assert out.count() == n and out.where(F.col("market_id").cast("double") != F.col("open_price")).count() == 0
