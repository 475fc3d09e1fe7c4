"""Model fitting on training rows that lie in one large partition."""

import datetime as dt

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tidemark.plans import models

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def fits(monkeypatch):
    """(partitions, rows) of what each pipeline and each isotonic regression is fitted on."""
    seen = {"pipeline": [], "isotonic": []}
    for cls, name in ((Pipeline, "pipeline"), (IsotonicRegression, "isotonic")):
        def fit(self, rows, params=None, cls=cls, name=name, inner=cls.fit):
            seen[name].append((rows.rdd.getNumPartitions(), rows.count()))
            return inner(self, rows, params)

        monkeypatch.setattr(cls, "fit", fit)
    monkeypatch.setattr(models, "FIT_ROWS", 100)
    return seen


def trades(spark, n):
    i = F.col("id")
    split = F.when(i < n * 0.6, "train").when(i < n * 0.8, "valid").otherwise("test")
    won = F.pmod(F.xxhash64("id"), F.lit(10)) < i % 10
    return spark.range(0, n, 1, 1).select(
        i.alias("event_id"), F.lit("m").alias("market_id"), (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), i.cast("int"))).alias("sample_ts"),
        (i % 10).cast("double").alias("x"), split.alias("split"), won.cast("int").alias("label_net"), F.when(won, 0.5).otherwise(-0.5).alias("net_pnl"),
    )


def test_trees_are_fitted_on_bounded_partitions(spark, fits):
    n = 1500
    df = trades(spark, n)
    chosen, scored = models.net_edge_model(df, features=["x"], edges=(0.0,), probabilities=(0.3, 0.5), min_trades=5, max_iter=2)
    assert scored.count() == n * 0.2 and chosen.count() == 1
    # the first is the classifier's, on train and valid; the other the regression's, on train
    assert [rows for _, rows in fits["pipeline"]] == [n * 0.8, n * 0.6]
    assert all(parts >= rows / 100 for parts, rows in fits["pipeline"])
    assert fits["isotonic"][0][1] <= 2 * 10  # at most both labels of each score, not every valid row
    won = scored.where("selected").agg(F.avg("label_net")).first()[0]
    assert won > scored.agg(F.avg("label_net")).first()[0]
    assert not spark.sparkContext._jsc.getPersistentRDDs()  # nothing is kept after the fit


def test_logistic_is_fitted_on_bounded_partitions(spark, fits):
    n = 1500
    _, scored = models.fit_binary(trades(spark, n), features=["x"], label="label_net", max_iter=5)
    assert scored.count() == n * 0.2 and fits["pipeline"] == [(9, n * 0.6)]


def test_few_training_rows_stay_where_they_are(spark, fits):
    models.fit_binary(trades(spark, 100), features=["x"], label="label_net", max_iter=5)
    assert fits["pipeline"] == [(1, 60)]
