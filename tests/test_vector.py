"""The live feature vector against a loop over all rows, for feeds in and out of order."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import sources, vector

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "kind string, who string, id long, ts timestamp, side string, prio int, a double, b double, c double, d double, e double, f double"


def rows_of(seed=1, n=900):
    """Two markets of one instrument and one of another, over ten minutes."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        s = float(np.round(rng.uniform(0, 600), 1))
        if rng.random() < 0.6:
            vals = [x if rng.random() < 0.8 else None for x in np.round(rng.uniform(0.2, 0.8, 6), 3).tolist()]
            out.append(("q", str(rng.choice(["m1", "m2", "m3", "unknown"])), i, s, str(rng.choice(["yes", "no"])), int(rng.integers(2)), *vals))
        else:
            price = float(np.round(rng.uniform(90, 110), 2)) if rng.random() < 0.97 else 0.0
            vals = [price - 1, price + 1, 3.0, float(rng.integers(0, 5)), price, None if rng.random() < 0.3 else float(rng.integers(-4, 5))]
            out.append(("t", str(rng.choice(["i1", "i2"])), i, s, None, 0, *vals))
    return out


WINDOWS = {"m1": ("i1", 60, 300), "m2": ("i1", 200, 580), "m3": ("i2", 0, 599)}


def expected(rows):
    want = {}
    for m, (inst, start, end) in WINDOWS.items():
        ticks = sorted(((r[3], r[2], r[6:]) for r in rows if r[0] == "t" and r[1] == inst and r[10] > 0 and start - 30 <= r[3] < end), key=lambda x: x[:2])
        cur, mids = {}, []
        for r in sorted((r for r in rows if r[0] == "q" and r[1] == m), key=lambda r: (r[3], r[5], r[2])):
            t = r[3]
            cur |= {(r[4], c): x for c, x in zip(vector.QUOTE, r[6:]) if x is not None}
            if r[6] is not None or r[7] is not None:
                cur[(r[4], "at")] = t
            bid, ask = cur.get(("yes", "bid")), cur.get(("yes", "ask"))
            if bid is not None and ask is not None:
                mids.append((t, (bid + ask) / 2))
            seen = [x for x in ticks if x[0] <= t]
            lag = lambda s: next((x[2][4] for x in reversed(seen) if x[0] <= round(t - s, 6)), None)
            flow = [x[2][5] or 0 for x in seen if x[0] >= round(t - 5, 6)]
            last = [x[2][4] for x in seen[-60:]]
            opened = next((x[2][4] for x in seen if x[0] >= start), None)
            want[(m, r[2])] = {
                "no_ask": cur.get(("no", "ask")), "yes_bid_depth": cur.get(("yes", "bid_depth")), "open_price": opened,
                "no_quote_age_seconds": None if ("no", "at") not in cur else t - cur[("no", "at")],
                "yes_mid_change_5s": None if not mids or mids[-1][0] > t or bid is None or ask is None else next(((bid + ask) / 2 - v for u, v in reversed(mids) if u <= round(t - 5, 6)), None),
                "ref_price": seen[-1][2][4] if seen else None,
                "ref_return_10s": None if not seen or lag(10) is None else seen[-1][2][4] / lag(10) - 1,
                "ref_vol_60s": float(np.std(np.diff(np.log(last)), ddof=1)) if len(last) > 2 else None,
                "ref_net_5s": float(sum(flow)), "ref_count_5": float(sum(x != 0 for x in flow)),
                "time_to_expiry_seconds": end - t,
            }
    return want


def run(spark, folder, batches, delay):
    for rows in batches:
        data = [(*r[:3], T0 + dt.timedelta(seconds=r[3]), *r[4:]) for r in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    ev = sources.file_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    six = ("a", "b", "c", "d", "e", "f")
    quo = ev.where("kind = 'q'").select(F.col("who").alias("market_id"), F.col("id").alias("row_id"), "ts", "side", "prio", *[F.col(x).alias(c) for x, c in zip(six, vector.QUOTE)])
    tic = ev.where("kind = 't'").select(F.col("who").alias("instrument"), F.col("id").alias("row_id"), "ts", *[F.col(x).alias(c) for x, c in zip(six, vector.TICK)])
    mk = spark.createDataFrame([(m, i, T0 + dt.timedelta(seconds=a), T0 + dt.timedelta(seconds=b)) for m, (i, a, b) in WINDOWS.items()], "market_id string, instrument string, start_ts timestamp, end_ts timestamp")
    out = vector.live_state(quo, tic, mk, delay=delay, clock=ev.where("kind = 'c'").select("ts"))
    query = sources.append_table(out, f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    made = spark.read.schema(out.schema).parquet(f"{folder}/out")
    return made, [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]


def beat(s):
    return ("c", None, 0, s, None, 0, *[None] * 6)


@pytest.mark.parametrize("mixed", [False, True])
def test_vector_equals_the_loop(spark, tmp_path, mixed):
    rows = rows_of()
    rng = np.random.default_rng(5)
    arrival = sorted(rows, key=(lambda r: r[3] + rng.uniform(0, 60)) if mixed else (lambda r: r[3]))
    batches = [arrival[:300], arrival[300:600], arrival[600:], [beat(900)], [beat(901)]]
    made, progress = run(spark, str(tmp_path), batches, "61 seconds")
    assert made.where("late_rows > 0").count() == 0
    got = {(r["market_id"], r["row_id"]): r for r in vector.live_vector(made, ttl_seconds=30).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for key, fields in want.items():
        for name, x in fields.items():
            y = got[key][name]
            assert (y is None) == (x is None) and (x is None or y == pytest.approx(x, abs=1e-9)), (key, name, x, y)
    assert progress[-1]["numRowsTotal"] == 0  # the state of a market ends with it


def test_late_rows_are_counted_and_change_nothing(spark, tmp_path):
    early = [("q", "m3", 1, 10.0, "yes", 0, 0.4, 0.5, None, None, None, None), ("t", "i2", 2, 9.0, None, 0, 99.0, 101.0, 1.0, 1.0, 100.0, 2.0)]
    late = [("q", "m3", 3, 5.0, "yes", 0, 0.1, 0.2, None, None, None, None), ("q", "m3", 4, 200.0, "no", 0, 0.5, 0.6, None, None, None, None)]
    made, _ = run(spark, str(tmp_path), [early, [beat(100)], late, [beat(700)], [beat(701)]], "5 seconds")
    rows = {r["row_id"]: r for r in made.collect()}
    assert rows[1]["yes_bid"] == 0.4 and rows[4]["yes_bid"] == 0.4 and rows[4]["ref_price"] == 100.0 and 3 not in rows
    assert rows[1]["ref_vol_60"] is None and rows[1]["open_price"] == 100.0


def test_empty_feed(spark, tmp_path):
    made, _ = run(spark, str(tmp_path), [[beat(1)]], "5 seconds")
    assert vector.live_vector(made, ttl_seconds=30).collect() == []
    assert len(set(pd.Index(vector.live_vector(made, ttl_seconds=30).columns))) >= 110
