"""Aggregates over the last seconds of each row: against a loop, and without a range frame over rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.timewindows import trailing
from tidemark.plans.instrument import second_volatility, sliding_flow


def _rows(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts_event", F.timestamp_micros("us"))


def test_sums_and_deviations_equal_the_loop(spark):
    rng = np.random.default_rng(5)
    n = 500
    us = 1_704_067_200_000_000 + rng.choice([0, 1, 15_625, 1_000_000, 7_000_000], n).cumsum()
    us[rng.integers(0, n, 60)] = us[n // 2]  # many rows of one instant
    pdf = pd.DataFrame({"id": range(n), "key": rng.choice(["hot", "b"], n, p=[0.9, 0.1]), "us": us, "x": rng.normal(size=n) * 1e-3 + 50})
    got = trailing(_rows(spark, pdf), keys=["key"], ts="ts_event", seconds=(1, 60, 1_000), sums={"s": F.col("x")}, deviations={"d": F.col("x")})
    assert got.count() == n
    for r in got.collect():
        for s in (1, 60, 1_000):
            seen = pdf[(pdf.key == r["key"]) & (pdf.us <= r["us"]) & (pdf.us >= r["us"] - s * 1_000_000)].x
            assert r[f"s_{s}s"] == pytest.approx(seen.sum(), rel=1e-12)
            want = seen.std(ddof=1) if len(seen) > 1 else None
            assert r[f"d_{s}s"] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-15))


def test_missing_values_times_and_keys(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, NULL, 0L, 'buy_aggressor', 2D), (2, NULL, 5000000L, 'buy_aggressor', NULL), (3, NULL, 900000000L, 'buy_aggressor', NULL),
        (4, 'a', NULL, 'sell_aggressor', 3D), (5, 'a', NULL, NULL, 4D), (6, 'a', 0L, 'sell_aggressor', 1D) AS t(id, symbol, us, side, qty)""")
    out = {r["id"]: r for r in sliding_flow(rows.withColumn("ts_event", F.timestamp_micros("us")), keys=["symbol"], seconds=(600,)).collect()}
    assert [out[i]["count_600s"] for i in range(1, 7)] == [1, 2, 1, 2, 2, 1]
    assert [out[i]["buy_600s"] for i in range(1, 7)] == [2.0, 2.0, None, 0.0, 0.0, 0.0]
    assert [out[i]["sell_600s"] for i in range(1, 7)] == [0.0, 0.0, 0.0, 3.0, 3.0, 1.0]


def test_no_frame_walks_its_window_for_each_row(spark):
    ticks = spark.range(20).select(F.timestamp_seconds("id").alias("ts_event"), F.lit("A").alias("symbol"), (F.col("id") + 1.0).alias("bid_price"), F.col("id").alias("event_id"))
    flow = ticks.withColumns({"side": F.lit("buy_aggressor"), "qty": F.lit(1.0)})
    for out in (
        second_volatility(ticks, keys=["symbol"], value="bid_price", seconds=(60,), tie=["event_id"]),
        sliding_flow(flow, keys=["symbol"], seconds=(60,)),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        frames = [x for x in plan.split("specifiedwindowframe(")[1:] if x.startswith("RangeFrame, -")]
        # only whole cells (937500 microseconds wide) are looked at through a sliding frame
        assert frames and all(x.startswith("RangeFrame, -59062500, -937500") for x in frames)
