"""Replays of many overlapping windows: against a loop, and without pairs of windows and rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.gates import SignalRules, signal_rules
from tidemark.streaming import replay


def _case(spark, seed=4):
    rng = np.random.default_rng(seed)
    n = 300
    rows = pd.DataFrame({"event_id": range(n), "market_id": rng.choice(["hot", "b"], n, p=[0.8, 0.2]), "s": rng.integers(0, 2_000, n), "probability": rng.random(n)})
    centre = rng.integers(-50, 2_000, 40)
    wins = pd.DataFrame({"window_id": [f"w{i}" for i in range(40)], "market_id": rng.choice(["hot", "b", "none"], 40), "a": centre - 100, "c": centre, "e": centre + rng.integers(-50, 900, 40)})
    wins = pd.concat([wins, wins.iloc[:5], wins.iloc[5:10].assign(c=wins.c[5:10] + 40)], ignore_index=True)  # ids that come again, alike and not
    left = spark.createDataFrame(rows).withColumns({"sample_ts": F.timestamp_seconds("s"), "quote_bad": F.lit(False), "time_to_expiry_seconds": F.lit(100.0), "spread": F.lit(0.01)})
    stamps = [F.timestamp_seconds(c).alias(n) for c, n in (("a", "start_ts"), ("c", "center_ts"), ("e", "end_ts"))]
    return rows, wins, left, spark.createDataFrame(wins).select("window_id", "market_id", *stamps)


def test_equals_the_loop(spark):
    rows, wins, left, right = _case(spark)
    rules = signal_rules(SignalRules("r", threshold=0.5, min_tte=30))
    out = replay.replay_windows(left, right, rules=rules, cooldown_seconds=60, forced=True)
    got = sorted((r["window_id"], r["event_id"], r["is_forced"]) for r in out.collect())
    want = []
    for wid, same in wins.groupby("window_id"):
        hit = [(r, w2.c) for w1 in same.itertuples() for w2 in same.itertuples() for r in rows.itertuples() if r.market_id == w1.market_id and w1.a <= r.s <= w1.e]
        want += [(wid, r.event_id, True) for r, c in hit if r.s == c]
        last = None
        for r in sorted({r.event_id: r for r, c in hit if r.s >= c and r.probability >= 0.5}.values(), key=lambda r: (r.s, r.event_id)):
            if last is None or r.s - last >= 60:
                want.append((wid, r.event_id, False))
                last = r.s
    assert (sorted(set(got) - set(want)), sorted(set(want) - set(got)), len(got) > 50) == ([], [], True)
    assert got == sorted(want)


def test_windows_are_not_paired_with_rows(spark, monkeypatch):
    _, wins, left, right = _case(spark)
    once = right.dropDuplicates(["window_id"])
    monkeypatch.setattr(replay, "rows_in_windows", lambda *a, **k: 1 / 0)
    out = replay.replay_windows(left, once, rules=signal_rules(SignalRules("r", threshold=0.5, min_tte=30)), cooldown_seconds=60, forced=True)
    assert out.count() > 50
