import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantile import count_distinct_nulls, group_quantiles
from tidemark.operators.rank import binary_metrics, equal_bins, time_split
from tidemark.operators.rowwindows import in_blocks, rolling
from tidemark.operators.scan import forward_fill, prefix_scan, row_index, value_index


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(5)
    n = 600
    return pd.DataFrame(
        {
            "id": range(n),
            "k": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n)),
            "o": rng.permutation(n * 7)[:n].astype("int64"),
            "x": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
        }
    )


def frame(spark, walk):
    return spark.createDataFrame(walk).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def test_running_aggregates_equal_pandas(spark, walk):
    df = frame(spark, walk)
    out = prefix_scan(
        df, keys=["k"], bucket=F.col("o") - F.col("o") % 50, order=["o"], sums={"s": F.coalesce("x", F.lit(0.0))},
        maxs={"m": F.col("x")}, lasts={"f": F.col("x")},
    )
    got = out.toPandas().sort_values("id").reset_index(drop=True)
    p = walk.sort_values("o")
    want = pd.DataFrame(
        {
            "id": p.id,
            "s": p.x.fillna(0).groupby(p.k).cumsum(),
            "m": p.groupby("k").x.cummax().groupby(p.k).ffill(),
            "f": p.groupby("k").x.ffill(),
        }
    ).sort_values("id").reset_index(drop=True)
    for c in ("s", "m", "f"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=0, atol=1e-9)


def test_row_index_counts_from_zero(spark, walk):
    out = row_index(frame(spark, walk), keys=["k"], bucket=F.col("o") - F.col("o") % 100, order=["o"]).toPandas()
    want = walk.sort_values("o").groupby("k").cumcount()
    assert out.set_index("id").row_idx.sort_index().tolist() == want.sort_index().tolist()


def test_fill_without_key(spark):
    df = spark.createDataFrame([(i, i * 3600) for i in range(50)], "id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = forward_fill(df, keys=[], ts="ts", fills={"v": F.when(F.col("id") % 17 == 0, F.col("id"))}, bucket_seconds=7_200)
    assert [r.v for r in out.orderBy("id").collect()] == [i - i % 17 for i in range(50)]


@pytest.mark.parametrize("share", [0.0, 0.9])
def test_value_index_with_heavy_ties(spark, share):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"id": range(500), "v": np.where(rng.random(500) < share, 0.5, rng.random(500))})
    out = value_index(spark.createDataFrame(p), keys=[], value="v", tie="id", n=8).toPandas()
    want = p.sort_values(["v", "id"]).reset_index(drop=True).id.tolist()
    assert out.sort_values("row_idx").id.tolist() == want


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles_equal_numpy(spark, walk, method):
    qs = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.99, "e": 1.0}
    out = group_quantiles(frame(spark, walk), keys=["k"], value="x", quantiles=qs, method=method)
    for r in out.collect():
        v = np.sort(walk[(walk.k == r.k) & walk.x.notna()].x.to_numpy())
        for name, q in qs.items():
            want = np.quantile(v, q) if method == "linear" else v[int(np.floor((len(v) - 1) * q + 0.5))]
            assert r[name] == pytest.approx(want, abs=1e-12)


def test_blocks_equal_the_global_window(spark):
    n = 300
    df = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 13).cast("double").alias("x"), F.lit("k").alias("k"))
    out = in_blocks(
        df, keys=["k"], index="i", before=6, after=3, block=16,
        compute=lambda w: {"s": rolling(F.sum, "x", 7, w), "lag": F.lag("x", 5).over(w), "lead": F.lead("x", 3).over(w)},
    ).toPandas().sort_values("i")
    x = pd.Series([float(i % 13) for i in range(n)])
    np.testing.assert_allclose(out.s.to_numpy(), x.rolling(7).sum().to_numpy())
    np.testing.assert_allclose(out.lag.to_numpy(), x.shift(5).to_numpy())
    np.testing.assert_allclose(out.lead.to_numpy(), x.shift(-3).to_numpy())


def test_bins_are_not_ntile(spark):
    df = spark.range(23).select("id", (F.col("id") / 23.0).alias("p"))
    floor = equal_bins(df, value="p", tie="id").groupBy("decile").count().orderBy("decile").collect()
    assert [r["count"] for r in floor] == [sum(1 for i in range(23) if i * 10 // 23 == d) for d in range(10)]
    cuts = equal_bins(df, value="p", tie="id", rule="cuts").groupBy("decile").count().orderBy("decile").collect()
    assert [r["count"] for r in cuts] == [int((d + 1) * 23 / 10) - int(d * 23 / 10) for d in range(10)]


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(300), 1)
    y = (rng.random(300) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    got = binary_metrics(df, label="y", prob="p").first()
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert got.auc == pytest.approx(want, abs=1e-12)
    one = binary_metrics(df.where("y = 1"), label="y", prob="p").first()
    assert one.auc is None and one.rows == int(y.sum())


def test_splits_do_not_overlap_in_time(spark):
    df = spark.range(97).withColumn("ts", F.timestamp_seconds(F.col("id") * 5_000))
    out = time_split(df, ts="ts", tie=["id"]).toPandas()
    assert out.split.value_counts().to_dict() == {"train": 67, "valid": 15, "test": 15}
    last = out.groupby("split").id.max()
    first = out.groupby("split").id.min()
    assert last["train"] < first["valid"] and last["valid"] < first["test"]


def test_null_is_a_distinct_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 1), ("b", 2)], "k string, v int")
    got = {r.k: r.n for r in df.groupBy("k").agg(count_distinct_nulls("v").alias("n")).collect()}
    assert got == {"a": 2, "b": 1}


def test_width_is_fitted_to_a_dense_key(spark):
    """One key with all rows inside an hour: narrow buckets, many of them, the same result."""
    from tidemark.operators.asof import asof_join
    from tidemark.operators.scan import fitted_seconds, time_bucket

    base = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("id") * 7919, F.lit(3_600)))
    rows = spark.range(5_000).select(F.lit("k").alias("k"), base.alias("ts"), F.col("id").alias("v"))
    asked = spark.range(300).select(F.lit("k").alias("k"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 12).alias("at"), F.col("id").alias("q"))
    width = fitted_seconds(rows, keys=["k"], ts="ts", most_rows=200)
    sizes = [r["count"] for r in rows.groupBy(time_bucket("ts", width).alias("b")).count().collect()]
    assert max(sizes) <= 200 and len(sizes) >= 25

    def joined(seconds):
        out = asof_join(asked, rows, on=["k"], left_ts="at", right_ts="ts", tie=["v"], right_cols=["v"], bucket_seconds=seconds)
        return sorted((r.q, r.v) for r in out.collect())

    assert joined(width) == joined(86_400)
    assert fitted_seconds(rows.limit(0), keys=["k"], ts="ts", most_rows=10) == 86_400
