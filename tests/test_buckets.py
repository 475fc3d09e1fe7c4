"""Keys dealt to buckets: Python and the state store see buckets, not keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import sources, state, vector

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def drained(spark, folder, out):
    query = sources.append_table(out, f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.schema(out.schema).parquet(f"{folder}/out"), max(held)


def quotes(spark, folder, n):
    """Two batches of one row a market; the second moves the ask only."""
    for second, ask in ((0, 0.5), (60, 0.6)):
        bid = F.lit(None).cast("double") if second else (F.col("id") % 7 / 10)
        spark.range(n).select(
            F.when(F.col("id") > 0, F.concat(F.lit("m"), "id")).alias("market_id"), F.lit("a").alias("asset_id"), (F.lit(T0) + F.expr(f"INTERVAL {second} SECOND")).alias("ts_event"),
            (F.col("id") + second * n).alias("row_id"), F.lit("orderbook").alias("source"), bid.alias("update_bid"), F.lit(ask).alias("update_ask"),
            F.lit(1.0).alias("update_bid_size"), F.lit(None).cast("double").alias("update_ask_size"), F.lit(None).cast("double").alias("last_trade_price"), F.lit("UP").alias("direction"),
        ).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return sources.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_batch=1)


@pytest.mark.parametrize("what", ["quote", "pair", "throttle", "first"])
def test_state_rows_do_not_grow_with_the_keys(spark, tmp_path, what):
    n = state.BUCKETS * 4
    rows = quotes(spark, str(tmp_path), n)
    of = {"keys": ["market_id", "asset_id"], "ts": "ts_event", "tie": "row_id"}
    out = {
        "quote": lambda: state.quote_state(rows), "pair": lambda: state.pair_state(rows),
        "throttle": lambda: state.throttle(rows, **of, seconds=60), "first": lambda: state.first_only(rows, **of),
    }[what]()
    made, held = drained(spark, str(tmp_path), out)
    assert held <= state.BUCKETS
    assert made.count() == (n if what == "first" else 2 * n)
    if what in ("quote", "pair"):
        bid, ask, updated = ("current_bid", "current_ask", "last_quote_update_us") if what == "quote" else ("yes_bid", "yes_ask", "yes_update_us")
        wrong = ~F.col(bid).eqNullSafe(F.col("row_id") % n % 7 / 10) | (F.col(ask) != F.when(F.col("row_id") < n, 0.5).otherwise(0.6)) | (F.col(updated) != F.col("ts_us"))
        assert made.where(wrong).count() == 0 and made.where("market_id IS NULL").count() == 2


def test_tick_features_keep_histories_apart(spark, tmp_path):
    n = state.BUCKETS * 2
    for batch in (0, 1):
        spark.range(n).select(
            "id", (F.lit(T0) + F.expr(f"INTERVAL {batch * 10} SECOND")).alias("ts"), (F.col("id") + 1 + batch).cast("double").alias("price"), (F.col("id") + batch * n).alias("row_id"),
        ).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = sources.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_batch=1)
    out = state.tick_features(rows.withColumns({"qty": F.lit(1.0), "side": F.lit(1)}), key="id", ts="ts", tie="row_id", price="price", qty="qty", side="side", lags_s=(10,), flows_s=(10,), history_s=60)
    made, held = drained(spark, str(tmp_path), out)
    assert held <= state.BUCKETS and made.count() == 2 * n
    later = made.where(F.col("row_id") >= n)
    assert later.where((F.col("price_lag_10s") != F.col("price") - 1) | (F.col("buy_10s") != 2) | (F.col("history_rows") != 2)).count() == 0


def test_markets_of_a_bucket_share_its_state(spark, tmp_path):
    n = vector.BUCKETS * 2
    at = lambda s: F.lit(T0) + F.expr(f"INTERVAL {s} SECOND")
    spark.range(n).select("id", at(20).alias("ts"), F.lit("q").alias("kind")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.range(n).select("id", at(10).alias("ts"), F.lit("t").alias("kind")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for s in (500, 501):
        spark.range(1).select("id", at(s).alias("ts"), F.lit("c").alias("kind")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = sources.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_batch=1)
    half, name = F.lit(0.5), F.col("id").cast("string")
    quo = rows.where("kind = 'q'").select(name.alias("market_id"), F.col("id").alias("row_id"), "ts", F.lit("yes").alias("side"), F.lit(0).alias("prio"), *[half.alias(c) for c in vector.QUOTE])
    tic = rows.where("kind = 't'").select(name.alias("instrument"), F.col("id").alias("row_id"), "ts", *[(F.col("id") + 1).cast("double").alias(c) for c in vector.TICK])
    markets = spark.range(n).select(name.alias("market_id"), name.alias("instrument"), at(0).alias("start_ts"), at(100).alias("end_ts"))
    made, held = drained(spark, str(tmp_path), vector.live_state(quo, tic, markets, delay="30 seconds", clock=rows.where("kind = 'c'").select("ts")))
    assert held <= vector.BUCKETS and made.count() == n
    assert made.where((F.col("ref_price") != F.col("row_id") + 1) | (F.col("open_price") != F.col("row_id") + 1) | (F.col("market_id") != F.col("row_id").cast("string"))).count() == 0
