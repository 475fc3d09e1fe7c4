import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import sources, state

SCHEMA = "id long, k string, ts timestamp, v double"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def stream_of(spark, path, batches):
    for rows in batches:
        data = [(i, k, T0 + dt.timedelta(seconds=s), float(v)) for i, k, s, v in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return sources.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def test_throttle_keeps_state_between_batches(spark, tmp_path):
    s = stream_of(spark, str(tmp_path / "in"), [[(1, "a", 0, 0), (2, "a", 5, 0)], [(3, "a", 9, 0), (4, "a", 10, 0), (5, "b", 1, 0)]])
    out = sources.drain(state.throttle(s, keys=["k"], ts="ts", tie="id", seconds=10), "t")
    assert sorted(r.id for r in out.collect()) == [1, 4, 5]


def test_hourly_limit_equals_the_loop(spark, tmp_path):
    rows = [(i, "a", i * 7, 0) for i in range(40)]
    s = stream_of(spark, str(tmp_path / "in"), [rows[:15], rows[15:]])
    got = sorted(r.id for r in sources.drain(state.hourly_limit(s, keys=["k"], ts="ts", tie="id", limit=3, window_seconds=60), "h").collect())
    kept, want = [], []
    for i, _, t, _ in rows:
        kept = [x for x in kept if x >= t - 60]
        if len(kept) < 3:
            kept.append(t)
            want.append(i)
    assert got == want


def test_outcomes_resolve_or_expire(spark, tmp_path):
    sig = stream_of(spark, str(tmp_path / "s"), [[(1, "m", 0, 0), (2, "m", 100, 0)]]).select(F.col("k").alias("market_id"), F.col("id").alias("signal_id"), "ts")
    quo = stream_of(spark, str(tmp_path / "q"), [[(10, "m", 1, 0.4), (11, "m", 6, 0.5), (12, "m", 90, 0.6), (13, "m", 300, 0.7)]]).select(
        F.col("k").alias("market_id"), F.col("id").alias("row_id"), "ts", F.col("v").alias("bid"), (F.col("v") + 0.02).alias("ask")
    )
    out = {r.signal_id: r for r in sources.drain(state.resolve_outcomes(sig, quo, latency_ms=1_000, horizon_s=5), "o").collect()}
    assert (out[1].entry_price, out[1].exit_price) == (0.4 + 0.02, 0.5)
    # the first quote after the second signal is both entry and exit
    assert (out[2].entry_us, out[2].exit_us) == (out[2].resolved_us, out[2].resolved_us)


def test_line_stream_is_parsed_like_a_batch(spark, tmp_path):
    d = tmp_path / "20240101"
    d.mkdir()
    (d / "a.jsonl").write_text('{"raw":{"market":"m","timestamp":"1704067200000","event_type":"price_change","price_changes":[{"asset_id":"y","best_ask":"0.5"}]}}\n{bad\n')
    books, changes = sources.quote_updates(sources.line_stream(spark, str(tmp_path)))
    got = sources.drain(changes, "lines").collect()
    assert [(r.market_id, r.asset_id, r.best_ask) for r in got] == [("m", "y", 0.5)]
    assert books.isStreaming


def test_queue_rows_are_json(spark, tmp_path):
    s = stream_of(spark, str(tmp_path / "in"), [[(1, "a", 0, 0)]])
    sources.append_queue(s, str(tmp_path / "queue"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.json(str(tmp_path / "queue")).collect()
    assert rows[0].id == 1 and rows[0].queue_write_ts


def test_settlement_keeps_the_open_price_between_batches(spark, tmp_path):
    rows = [(1, "p", 0, 100), (2, "p", 40, 90), (3, "p", 70, 110), (4, "s", 75, 0), (5, "p", 130, 120), (6, "p", 200, 80)]
    got = []
    for n, batches in enumerate(([rows], [rows[:2], rows[2:3], rows[3:5], rows[5:]])):
        both = stream_of(spark, str(tmp_path / f"in{n}"), batches)
        px = both.where("k = 'p'").select(F.lit("x").alias("series"), F.col("id").alias("row_id"), "ts", F.col("v").alias("price"))
        start, end = (F.lit(T0 + dt.timedelta(seconds=s)) for s in (10, 120))
        sig = both.where("k = 's'").select(
            F.lit("x").alias("series"), F.col("id").alias("signal_id"), F.lit("m").alias("market_id"), F.lit("UP").alias("direction"),
            F.lit(0.5).alias("entry_price"), start.alias("start_ts"), end.alias("end_ts"), "ts",
        )
        out = sources.drain(state.settle_at_end(sig, px, span_s=300), f"s{n}")
        got.append([(r.signal_id, r.open_price, r.close_price, r.settled_yes, r.pnl) for r in out.collect()])
    # opened at 100 (second 0, before the market began), closed at 110
    assert got[0] == got[1] == [(4, 100.0, 110.0, 1, 0.5)]


def test_open_signals_come_out_with_nulls(spark):
    signals = spark.createDataFrame([(1, "a"), (2, "b")], "signal_id long, market_id string")
    done = spark.createDataFrame([(1, "a", 0.5)], "signal_id long, market_id string, pnl double")
    assert sorted(map(tuple, state.with_open(done, signals).collect())) == [(1, "a", 0.5), (2, "b", None)]
