"""Rows in windows: every window length against a loop, with few cells for each."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.plans.quality import rows_in_windows


def test_equals_the_loop(spark):
    rng = np.random.default_rng(11)
    rows = pd.DataFrame({"market_id": rng.choice(["hot", "b"], 400, p=[0.9, 0.1]), "s": rng.integers(-5_000, 200_000, 400), "id": range(400)})
    start = rng.integers(-6_000, 190_000, 60)
    wins = pd.DataFrame({"market_id": rng.choice(["hot", "b"], 60), "window_id": range(60), "a": start, "b": start + rng.choice([-1, 0, 1, 60, 299, 3_600, 100_000], 60)})
    left = spark.createDataFrame(rows).withColumn("sample_ts", F.timestamp_seconds("s"))
    right = spark.createDataFrame(wins).select("market_id", "window_id", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"))
    got = sorted((r["window_id"], r["id"]) for r in rows_in_windows(left, right, cell_seconds=30).collect())
    want = sorted((w.window_id, r.id) for w in wins.itertuples() for r in rows.itertuples() if r.market_id == w.market_id and w.a <= r.s <= w.b)
    assert got == want and len(got) > 500


def test_no_windows_and_open_ends(spark):
    rows = spark.sql("SELECT 'm' AS market_id, timestamp'2024-01-01' AS sample_ts, 1 AS id UNION ALL SELECT 'm', NULL, 2")
    wins = spark.sql("SELECT 'm' AS market_id, 1 AS window_id, timestamp'2024-01-01' AS start_ts, CAST(NULL AS TIMESTAMP) AS end_ts")
    assert rows_in_windows(rows, wins).collect() == []
    assert rows_in_windows(rows, wins.limit(0)).collect() == []
    whole = wins.select("market_id", "window_id", "start_ts", F.col("start_ts").alias("end_ts"))
    assert [r["id"] for r in rows_in_windows(rows, whole).collect()] == [1]
