"""Delayed outcomes: order of arrival, timers, late rows, state at the end."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import outcomes, sources, state

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "kind string, market_id string, id long, s double, bid double, ask double, stale boolean, direction string"
LAT, HOR, EXP = 1, 5, 2
# market "quiet" has no quote after its signal; in "gap" the next one comes after the expiry
ROWS = [
    ("s", "m", 1, 0, None, None, None, "UP"), ("s", "m", 2, 3, None, None, None, "DOWN"), ("q", "m", 10, 1, 0.4, 0.42, True, None),
    ("q", "m", 11, 2, None, 0.5, False, None), ("q", "m", 12, 6, 0.45, None, False, None), ("q", "m", 13, 10, 0.6, 0.62, None, None),
    ("q", "quiet", 20, 0, 0.3, 0.32, False, None), ("s", "quiet", 3, 1, None, None, None, "UP"),
    ("s", "gap", 4, 0, None, None, None, "UP"), ("q", "gap", 30, 1, 0.2, 0.22, False, None), ("q", "gap", 31, 9, 0.9, 0.92, False, None),
    ("s", "m", 5, 4, None, None, None, "sideways"),
]


def run(spark, folder, batches, delay="30 seconds"):
    for rows in batches:
        data = [(k, m, i, T0 + dt.timedelta(seconds=s), b, a, st, d) for k, m, i, s, b, a, st, d in rows]
        frame = spark.createDataFrame(data, SCHEMA.replace("s double, bid", "ts timestamp, bid"))
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    ev = sources.file_stream(spark, f"{folder}/in", frame.schema, files_per_batch=1)
    quo = ev.where("kind = 'q'").select(
        "market_id", F.col("id").alias("row_id"), "ts", F.col("bid").alias("yes_bid"), F.col("ask").alias("yes_ask"), F.col("stale").alias("yes_stale"),
        F.lit(False).alias("yes_crossed"), (1 - F.col("ask")).alias("no_bid"), (1 - F.col("bid")).alias("no_ask"), F.lit(None).cast("boolean").alias("no_stale"), F.lit(True).alias("no_crossed"),
    )
    sig = ev.where("kind = 's'").select("market_id", F.col("id").alias("signal_id"), "direction", "ts")
    out = outcomes.delayed_outcomes(sig, quo, latency_ms=LAT * 1000, horizon_s=HOR, expire_s=EXP, delay=delay, clock=ev.where("kind = 'c'").select("ts"))
    query = sources.append_table(out, f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    found = spark.read.schema(out.schema).parquet(f"{folder}/out").collect()
    return {r["signal_id"]: r for r in found}, [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]


def clock(s):
    return ("c", None, 0, s, None, None, None, None)


def seconds(us):
    return None if us is None else us / 1e6 - T0.timestamp()


def brief(rows):
    return {i: (r["closed_by"], seconds(r["entry_us"]), r["entry_price"], seconds(r["exit_us"]), r["exit_price"], r["entry_quote_stale"]) for i, r in rows.items()}


WANT = {
    1: ("exit", 1, 0.42, 6, 0.45, True),  # due at 6: the bid of second 6
    2: ("exit", 6, 1 - 0.45, 10, 1 - 0.62, None),  # the no side: asks are one minus yes bids
    3: ("expiry", None, None, None, None, None),
    4: ("expiry", 1, 0.22, None, None, False),
}


@pytest.mark.parametrize("cut", [1, 3, 6, len(ROWS)])
def test_any_order_of_arrival_gives_the_same(spark, tmp_path, cut):
    for n, order in enumerate((ROWS, ROWS[::-1], ROWS[1::2] + ROWS[::2])):
        batches = [list(b) for b in itertools.batched(order, cut)] + [[clock(200)]]
        found, states = run(spark, str(tmp_path / str(n)), batches)
        assert {i: tuple(round(x, 9) if isinstance(x, float) else x for x in r) for i, r in brief(found).items()} == WANT
        assert states[-1]["numRowsTotal"] == 0  # nothing is left behind
        if cut != 1:
            break


def test_state_rows_do_not_grow_with_the_markets(spark, tmp_path):
    n = state.BUCKETS * 3
    at = lambda s: F.lit(T0) + F.expr(f"INTERVAL {s} SECOND")
    market = F.when(F.col("id") > 0, F.concat(F.lit("m"), "id"))  # one market has no name
    price = F.col("id") % 50 / 100 + 0.1
    for kind, s, bid in (("s", 0, None), ("q", 2, price), ("q", 7, price + 0.1)):
        spark.range(n).select(F.lit(kind).alias("kind"), market.alias("market_id"), "id", at(s).alias("ts"), F.lit(bid).cast("double").alias("bid")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.range(1).select(F.lit("c").alias("kind"), F.lit(None).cast("string").alias("market_id"), "id", at(100).alias("ts"), F.lit(None).cast("double").alias("bid")).write.mode("append").parquet(f"{tmp_path}/in")
    ev = sources.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_batch=1)
    bid, no = F.col("bid"), F.lit(False)
    quo = ev.where("kind = 'q'").select(
        "market_id", F.col("id").alias("row_id"), "ts", bid.alias("yes_bid"), (bid + 0.02).alias("yes_ask"), (1 - bid - 0.02).alias("no_bid"), (1 - bid).alias("no_ask"),
        (F.col("id") % 2 == 0).alias("yes_stale"), no.alias("yes_crossed"), no.alias("no_stale"), F.lit(None).cast("boolean").alias("no_crossed"),
    )
    sig = ev.where("kind = 's'").select("market_id", F.col("id").alias("signal_id"), "ts", F.when(F.col("id") % 3 == 0, "DOWN").otherwise("UP").alias("direction"))
    out = outcomes.delayed_outcomes(sig, quo, latency_ms=LAT * 1000, horizon_s=HOR, expire_s=EXP, delay="30 seconds", clock=ev.where("kind = 'c'").select("ts"))
    query = sources.append_table(out, f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= state.BUCKETS and held[-1] == 0
    made = spark.read.schema(out.schema).parquet(f"{tmp_path}/out")
    assert made.count() == n and made.where("market_id IS NULL AND signal_id = 0").count() == 1
    price, i, up = F.col("signal_id") % 50 / 100 + 0.1, F.col("signal_id"), F.col("direction") == "UP"
    entry, leave = F.when(up, price + 0.02).otherwise(1 - price), F.when(up, price + 0.1).otherwise(1 - price - 0.12)
    wrong = (F.abs(F.col("entry_price") - entry) > 1e-9) | (F.abs(F.col("exit_price") - leave) > 1e-9) | (up == (i % 3 == 0)) | (F.col("closed_by") != "exit")
    wrong |= (F.col("exit_us") - F.col("entry_us") != 5_000_000) | ~F.col("entry_quote_stale").eqNullSafe(up & (i % 2 == 0)) | ~F.col("exit_crossed_quote").eqNullSafe(F.when(up, False))
    wrong |= (i > 0) & (F.col("market_id") != F.concat(F.lit("m"), i))
    assert made.where(wrong).count() == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    late = ("q", "m", 14, 1.5, 0.1, 0.12, False, None)
    rows = [[*ROWS, clock(32)], [late, ("s", "m", 9, 0, None, None, None, "UP")], [clock(300)]]
    found, states = run(spark, str(tmp_path), rows)
    late_ones = [r for i, r in found.items() if r["closed_by"] == "late"]
    found = {i: r for i, r in found.items() if r["closed_by"] != "late"}
    assert {i: tuple(round(x, 9) if isinstance(x, float) else x for x in r) for i, r in brief(found).items()} == WANT
    assert sum(s["numRowsDroppedByWatermark"] for s in states) + sum(r["late_rows"] for r in late_ones) == 1 + 1


def test_results_fees_and_guards(spark):
    rows = [(0.4, 0.6), (0.0, 0.5), (None, 0.5), (0.4, None), (0.4, 1.0)]
    df = spark.createDataFrame(rows, "entry_price double, exit_price double")
    got = [r.asDict() for r in outcomes.with_result(df, shares=2.0).collect()]
    assert round(got[0]["net_pnl"], 9) == round(0.2 - 0.07 * 0.24 * 2 - 0.0025, 9) and got[0]["net_pnl_total"] == 2 * got[0]["net_pnl"]
    assert got[1]["roi"] is None and got[1]["pnl"] == 0.5
    assert [got[i][c] for i in (2, 3) for c in ("pnl", "entry_fee", "exit_fee", "net_pnl")] == [None] * 8
    settled = outcomes.with_result(df, settles=F.col("exit_price") == 1.0).collect()
    assert settled[4]["exit_fee"] == 0.0 and settled[0]["exit_fee"] > 0
