import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cooldown
from tidemark.operators.cooldown import cooldown_thin
from tidemark.operators.trades import max_drawdown, select_modes, trade_metrics
from tidemark.plans.evaluate import choose_threshold


def greedy(times, wait):
    kept, last = [], None
    for i in np.lexsort((np.arange(len(times)), times)):
        if last is None or times[i] - last >= wait:
            kept.append(int(i))
            last = times[i]
    return sorted(kept)


@pytest.mark.parametrize("wait", [0.5, 7, 40, 1_000])
@pytest.mark.parametrize("span", [500, 50_000])
def test_cooldown_equals_the_loop(spark, wait, span):
    rng = np.random.default_rng(int(wait * 10) + span)
    n = 800
    p = pd.DataFrame({"id": range(n), "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n)), "us": (rng.random(n) * span * 1e6).astype("int64") // 250_000 * 250_000})
    df = spark.createDataFrame(p).withColumn("ts", F.timestamp_micros("us"))
    got = {r.id for r in cooldown_thin(df, keys=["k"], ts="ts", tie="id", seconds=wait, block_seconds=1).collect()}
    want = set()
    for _, g in p.groupby("k"):
        g = g.sort_values(["us", "id"]).reset_index(drop=True)
        want |= {int(g.id[i]) for i in greedy(g.us.to_numpy(), wait * 1e6)}
    assert got == want


@pytest.mark.parametrize("step, wait", [(1, 30), (0.01, 30), (1, 0.5)])
def test_cooldown_of_one_dense_key_in_blocks_by_rows(spark, step, wait):
    """A grid never merges its phases; with 10 ms steps a cooldown spans more than all blocks of a key."""
    n = 4_000
    df = spark.range(n).select("id", F.lit(None).cast("string").alias("k"), F.timestamp_micros((F.col("id") * int(step * 1e6)).cast("bigint")).alias("ts"))
    got = sorted(r.id for r in cooldown_thin(df, keys=["k"], ts="ts", tie="id", seconds=wait, most_rows=100).collect())
    hop = max(1, round(wait / step))
    assert got == list(range(0, n, hop))


def test_cooldown_arrays_are_bounded_by_a_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 3_000
    p = pd.DataFrame({"id": range(n), "k": np.where(rng.random(n) < 0.9, "hot", "b"), "us": np.sort((rng.exponential(1e6, n) * np.where(rng.random(n) < 0.02, 200, 1)).cumsum().astype("int64"))})
    df = spark.createDataFrame(p).withColumn("ts", F.timestamp_micros("us"))
    seen = []
    real = cooldown.stage
    monkeypatch.setattr(cooldown, "stage", lambda frame, name, **k: seen.append((name, out := real(frame, name, **k))) or out)
    got = {r.id for r in cooldown_thin(df, keys=["k"], ts="ts", tie="id", seconds=20, most_rows=64).collect()}
    want = set()
    for _, g in p.groupby("k"):
        g = g.reset_index(drop=True)
        want |= {int(g.id[i]) for i in greedy(g.us.to_numpy(), 20e6)}
    assert got == want
    assert not [f for _, t in seen for f in t.schema.fields if "array" in f.dataType.simpleString()]
    steps = next(t for name, t in seen if name == "cooldown_steps")
    assert steps.groupBy("__g", "__b").count().agg(F.max("count")).first()[0] <= 4 * 64


def test_cooldown_far_times_nulls_and_empty(spark):
    rows = [("a", -62_000_000_000, 5), ("a", 200_000_000_000, 6), ("a", None, 7), (None, 10, 8), (None, 11, 9)] + [(f"u{i}", i, 10 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, s long, id int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id for r in cooldown_thin(df, keys=["k"], ts="ts", tie="id", seconds=60).collect()}
    assert got == {5, 6, 8} | {10 + i for i in range(300)}
    assert cooldown_thin(df.limit(0), keys=["k"], ts="ts", tie="id", seconds=60).collect() == []


def test_cooldown_column_and_zero(spark):
    rows = [(i, "z", 0.0, 1) for i in range(3)] + [(i, "c", 10.0, i * 4) for i in range(3, 9)]
    df = spark.createDataFrame(rows, "id int, k string, c double, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id for r in cooldown_thin(df, keys=["k", "c"], ts="ts", tie="id", seconds="c").collect()}
    assert got == {0, 1, 2, 3, 6}


@pytest.mark.parametrize("rows_per_batch", [1, 7, 10_000])
def test_cooldown_over_arrow_batches_keeps_whole_rows(spark, rows_per_batch):
    """Blocks go on in the next batch; rows keep every column and are not joined back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    try:
        rows = [(i, None if i % 5 == 0 else f"k{i % 5}", (i // 3) * 2, {"a": i}, [i, None]) for i in range(200)]
        df = spark.createDataFrame(rows, "id int, k string, s long, m map<string,int>, xs array<int>").withColumn("ts", F.timestamp_seconds("s"))
        out = cooldown_thin(df, keys=["k"], ts="ts", tie="id", seconds=30)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        want = set()
        for k in range(5):
            own = [r for r in rows if r[0] % 5 == k]
            want |= {own[i][0] for i in greedy(np.array([r[2] for r in own]), 30)}
        got = out.collect()
        assert {r.id for r in got} == want and out.columns == df.columns
        assert all(r.m == {"a": r.id} and r.xs == [r.id, None] and r.k == rows[r.id][1] for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_modes(spark):
    rows = [(i, "m", i * 5, 0.7) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id int, market_id string, s long, threshold double").withColumns({"sample_ts": F.timestamp_seconds("s"), "direction": F.lit("UP")})
    out = select_modes(df, params=["threshold"], modes={"all": 0, "first": None, "c10": 10, "c30": 30})
    got = {m: sorted(r.event_id for r in out.where(F.col("mode") == m).collect()) for m in ("all", "first", "c10", "c30")}
    assert got == {"all": list(range(10)), "first": [0], "c10": [0, 2, 4, 6, 8], "c30": [0, 6]}


def drawdown(v):
    eq = np.cumsum(v)
    return float(np.max(np.maximum.accumulate(eq) - eq))


def test_drawdown_over_buckets(spark):
    rng = np.random.default_rng(9)
    n = 700
    p = pd.DataFrame({"event_id": range(n), "k": rng.choice(["x", "y"], n), "market_id": rng.choice(["m1", "m2", "m3"], n), "s": rng.integers(0, 10 * 86_400, n), "pnl": rng.normal(size=n)})
    df = spark.createDataFrame(p).withColumn("sample_ts", F.timestamp_seconds("s"))
    got = {r.k: r.max_drawdown for r in max_drawdown(df, keys=["k"], ts="sample_ts", tie=["event_id"], value="pnl").collect()}
    by_market = {r.k: r.max_drawdown for r in max_drawdown(df, keys=["k"], ts="sample_ts", tie=["event_id"], value="pnl", within="market_id").collect()}
    for k, g in p.groupby("k"):
        assert got[k] == pytest.approx(drawdown(g.sort_values(["s", "event_id"]).pnl), abs=1e-9)
        assert by_market[k] == pytest.approx(drawdown(g.sort_values(["market_id", "s", "event_id"]).pnl), abs=1e-9)


def test_peak_starts_at_the_first_value(spark):
    df = spark.createDataFrame([(1, -5.0), (2, -1.0)], "event_id int, pnl double").withColumn("sample_ts", F.timestamp_seconds("event_id"))
    assert max_drawdown(df, keys=[], ts="sample_ts", tie=["event_id"], value="pnl").first().max_drawdown == 1.0


def test_metrics_of_one_trade(spark):
    df = spark.createDataFrame([(1, "m", 0.4, 0.5, 0.1, 30.0)], "event_id int, market_id string, entry_price double, exit_price double, pnl double, time_to_expiry_seconds double").withColumn("sample_ts", F.timestamp_seconds("event_id"))
    r = trade_metrics(df, keys=["market_id"]).first()
    assert (r.trades, r.win_rate, r.pnl_std, r.sharpe_like, r.max_drawdown) == (1, 1.0, 0.0, None, 0.0)


def test_threshold_fallback(spark):
    df = spark.createDataFrame([(1, "m", 0.1, 0.9, 1.0)], "event_id int, market_id string, pred_edge double, pred_prob double, net_pnl double").withColumn("sample_ts", F.timestamp_seconds("event_id"))
    r = choose_threshold(df, keys=["market_id"], edges=(0.0, 0.05), probabilities=(0.5,), min_trades=5).first()
    assert (r.edge_threshold, r.prob_threshold, r.score) == (0.0, 0.5, None)
    r = choose_threshold(df, keys=[], edges=(0.0, 0.05), probabilities=(0.5,), min_trades=1).first()
    assert (r.edge_threshold, r.prob_threshold, r.score) == (0.0, 0.5, 1.0)
