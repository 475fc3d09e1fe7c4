"""Row-bounded buckets: balance, one instant, and results equal to a plain loop."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, rank, trades
from tidemark.operators.borders import row_buckets
from tidemark.operators.scan import forward_fill, prefix_scan, row_index

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    """One dense key, one whose rows share one instant, some small ones, a null key."""
    draw = random.Random(4)
    out = [("dense", 3600 * draw.random(), i) for i in range(3000)] + [("instant", 5.0, i) for i in range(3000, 5000)]
    out += [(k, float(draw.randint(0, 9)), 5000 + 10 * j + i) for j, k in enumerate(("a", "b", None)) for i in range(10)]
    draw.shuffle(out)
    return [(k, T0 + dt.timedelta(seconds=round(s, 3)), i, draw.random() if draw.random() < 0.3 else None) for k, s, i in out]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v double").cache()


def test_buckets_are_bounded_and_monotone(df):
    out = row_buckets([df.withColumn("o", F.struct("ts", "id"))], keys=["k"], order="o", most_rows=100)[0]
    got = out.select("k", "ts", "id", "__rb").collect()
    assert len(got) == 5030
    for key, n in (("dense", 3000), ("instant", 2000)):
        own = sorted((r["ts"], r["id"], r["__rb"]) for r in got if r["k"] == key)
        numbers = [b for _, _, b in own]
        assert numbers == sorted(numbers)
        sizes = [numbers.count(b) for b in set(numbers)]
        assert max(sizes) < 350 and len(sizes) > n / 200


def test_forward_fill_and_row_numbers(df, rows):
    filled = forward_fill(df, keys=["k"], ts="ts", tie=["id"], fills={"last": F.col("v")}, most_rows=50)
    got = {r["id"]: r["last"] for r in filled.collect()}
    numbered = {r["id"]: r["n"] for r in row_index(df, keys=["k"], order=["ts", "id"], most_rows=50, name="n").collect()}
    last, count = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        last[k] = v if v is not None else last.get(k)
        count[k] = count.get(k, -1) + 1
        assert (got[i], numbered[i]) == (last[k], count[k])
    whole = row_index(df, keys=[], order=["ts", "id"], most_rows=50, name="n").collect()
    assert sorted(r["n"] for r in whole) == list(range(5030))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 0.5])
def test_asof_equals_a_loop(spark, df, rows, direction, exact, tolerance):
    left = df.select("k", "ts", "id")
    right = df.where("id % 3 = 0").select("k", F.col("ts").alias("at"), F.col("id").alias("rid"), "v")
    out = asof.asof_join(
        left, right, on=["k"], left_ts="ts", right_ts="at", direction=direction, tolerance=tolerance, tie=["rid"], right_cols=["rid"],
        allow_exact=exact, most_rows=60,
    )
    got = {r["id"]: r["rid"] for r in out.collect()}
    held = {}
    for k, ts, i, _ in rows:
        if i % 3 == 0 and k is not None:
            held.setdefault(k, []).append((ts, i))
    for line in held.values():
        line.sort()
    for k, ts, i, _ in rows:
        line, want = held.get(k, []), None
        if direction == "backward":
            at = (bisect.bisect_right(line, (ts, 1 << 60)) if exact else bisect.bisect_left(line, (ts, -1))) - 1
            hit = line[at] if at >= 0 else None
        else:
            at = bisect.bisect_left(line, (ts, -1)) if exact else bisect.bisect_right(line, (ts, 1 << 60))
            hit = line[at] if at < len(line) else None
        if hit and (tolerance is None or abs((hit[0] - ts).total_seconds()) <= tolerance):
            want = hit[1]
        assert got[i] == want, (k, ts, i)


def test_nearest_equals_a_loop(df, rows):
    left = df.where("id % 2 = 1").select("k", "ts", "id")
    right = df.where("id % 7 = 0").select("k", F.col("ts").alias("at"), F.col("id").alias("rid"))
    got = {r["id"]: r["abs_ms"] for r in asof.nearest_join(left, right, on=["k"], left_ts="ts", right_ts="at", right_cols=["rid"], tie=["rid"], most_rows=60).collect()}
    for k, ts, i, _ in rows:
        if i % 2:
            gaps = [abs((t - ts).total_seconds()) * 1000 for kk, t, j, _ in rows if kk == k and k is not None and j % 7 == 0]
            assert got[i] == (pytest.approx(min(gaps), abs=1e-6) if gaps else None)


def test_drawdown_split_and_scan(spark, df, rows):
    priced = df.withColumn("p", F.coalesce("v", F.lit(0.5)) - 0.5)
    got = {r["k"]: r["max_drawdown"] for r in trades.max_drawdown(priced, keys=["k"], ts="ts", tie=["id"], value="p", most_rows=40).collect()}
    total, peak, fall = {}, {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0.0) + (0.5 if v is None else v) - 0.5
        peak[k] = max(peak.get(k, total[k]), total[k])
        fall[k] = max(fall.get(k, 0.0), peak[k] - total[k])
    assert got == pytest.approx(fall)
    split = rank.time_split(df, ts="ts", tie=["id"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 3521, "valid": 754, "test": 755}
    empty = prefix_scan(df.where("false"), keys=["k"], order=["ts", "id"], sums={"s": F.lit(1)})
    assert empty.collect() == []
