import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join, asof_offsets, nearest_join

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_backward_uses_the_past_only(spark):
    left = spark.createDataFrame([(at(s),) for s in (1, 2, 3)], "sample_ts timestamp")
    right = spark.createDataFrame([(at(0), 10), (at(2), 20)], "ts_event timestamp, value int")
    out = asof_join(left, right, left_ts="sample_ts", right_ts="ts_event").orderBy("sample_ts")
    assert [r.value for r in out.collect()] == [10, 20, 20]


def frames(seed, hot=0.4, n=400):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < hot, 0, rng.integers(1, 6, n))
    left = pd.DataFrame({"id": range(n), "k": keys, "t": rng.integers(0, 20_000, n)})
    m = n // 2
    rkeys = np.where(rng.random(m) < hot, 0, rng.integers(1, 6, m))
    right = pd.DataFrame({"k": rkeys, "rt": rng.integers(0, 20_000, m), "v": range(m)})
    return left, right


def to_spark(spark, pdf, col):
    return spark.createDataFrame(pdf).withColumn(col, F.timestamp_seconds(F.col(col) + 1_704_067_200))


def brute(left, right, back, tol, exact):
    out = {}
    for row in left.itertuples():
        cand = right[right.k == row.k]
        if back:
            cand = cand[cand.rt <= row.t] if exact else cand[cand.rt < row.t]
            best = cand.sort_values(["rt", "v"]).tail(1)
        else:
            cand = cand[cand.rt >= row.t] if exact else cand[cand.rt > row.t]
            best = cand.sort_values(["rt", "v"]).head(1)
        value = None if best.empty else int(best.v.iloc[0])
        if value is not None and tol is not None and abs(int(best.rt.iloc[0]) - row.t) > tol:
            value = None
        out[row.id] = value
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 30, 2_000])
@pytest.mark.parametrize("exact", [True, False])
def test_matches_brute_force(spark, direction, tolerance, exact):
    left, right = frames(seed=7)
    out = asof_join(
        to_spark(spark, left, "t"), to_spark(spark, right, "rt"), on=["k"], left_ts="t", right_ts="rt", direction=direction,
        tolerance=tolerance, tie=["v"], allow_exact=exact, bucket_seconds=600,
    )
    got = {r.id: r.v for r in out.select("id", "v").collect()}
    assert got == brute(left, right, direction == "backward", tolerance, exact)


def test_bucket_width_does_not_matter(spark):
    left, right = frames(seed=3)
    a, b = (
        {
            r.id: r.v
            for r in asof_join(
                to_spark(spark, left, "t"), to_spark(spark, right, "rt"), left_ts="t", right_ts="rt", tie=["v"],
                right_cols=["v"], bucket_seconds=w,
            ).collect()
        }
        for w in (50, 10**6)
    )
    assert a == b


def test_null_keys_and_times_do_not_match(spark):
    left = spark.createDataFrame([(1, None, at(5)), (2, "a", None), (3, "a", at(5))], "id int, k string, t timestamp")
    right = spark.createDataFrame([(None, at(1), 1), ("a", at(1), 2), ("a", None, 3)], "k string, rt timestamp, v int")
    out = asof_join(left, right, on=["k"], left_ts="t", right_ts="rt")
    assert {r.id: r.v for r in out.collect()} == {1: None, 2: None, 3: 2}


def test_nearest_matches_brute_force(spark):
    left, right = frames(seed=11)
    out = nearest_join(
        to_spark(spark, left, "t"), to_spark(spark, right, "rt"), on=["k"], left_ts="t", right_ts="rt", right_cols=["v"],
        tie=["v"], bucket_seconds=600,
    )
    for r in out.collect():
        row = left.loc[r.id]
        gaps = (right[right.k == row.k].rt - row.t).abs()
        assert r.abs_ms == (None if gaps.empty else gaps.min() * 1000.0)


def test_offsets_give_one_map_per_row(spark):
    base = spark.createDataFrame([("m", 1, at(0)), ("m", 2, at(10))], "market_id string, id int, ts timestamp")
    quotes = spark.createDataFrame([("m", at(s), float(s)) for s in (0, 1, 5, 10)], "market_id string, q_ts timestamp, px double")
    out = asof_offsets(
        base, quotes, on=["market_id"], id_cols=["market_id", "id"], base_ts="ts", quote_ts="q_ts",
        offsets_ms=[0, 1_000, 5_000], quote_cols=["px"], tolerance=1.0,
    )
    got = {r.id: {k: q.px for k, q in r.quotes_at.items()} for r in out.collect()}
    assert got == {1: {0: 0.0, 1_000: 1.0, 5_000: 5.0}, 2: {0: 10.0}}
