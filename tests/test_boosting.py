"""Boosted trees with a softmax loss against a plain loop, and on a rule that can be learnt."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans.boosting import _histograms, fit_softmax


def loop(x, y, n_classes, rounds, depth, rate, l2, min_rows):
    """Scores after the rounds, tree by tree and row by row; ``x`` holds bins."""
    s = np.tile(np.log(np.bincount(y, minlength=n_classes) / len(y)), (len(y), 1))

    def leaves(rows, g, h, left):
        if left:
            best, gain = None, 1e-12
            for f in range(x.shape[1]):
                for b in sorted(set(x[rows, f])):
                    a, c = rows[x[rows, f] <= b], rows[x[rows, f] > b]
                    if min(len(a), len(c)) >= min_rows:
                        parts = [g[i].sum() ** 2 / (h[i].sum() + l2) for i in (a, c, rows)]
                        now = round(parts[0] + parts[1] - parts[2], 9)
                        if now > gain:
                            best, gain = (a, c), now
            if best:
                return leaves(best[0], g, h, left - 1) + leaves(best[1], g, h, left - 1)
        return [(rows, -rate * g[rows].sum() / (h[rows].sum() + l2))]

    for _ in range(rounds):
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = s.copy()
        for k in range(n_classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
            for rows, value in leaves(np.arange(len(y)), g, h, depth):
                new[rows, k] += value
        s = new
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def table(spark, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.integers(0, 6, n).astype(float)
    y = np.where(a > 0.5, "UP", np.where((a < -0.4) & (b > 1), "DOWN", "FLAT"))
    y[rng.random(n) < 0.05] = "FLAT"
    p = pd.DataFrame({"id": range(n), "a": a, "odd name": np.where(rng.random(n) < 0.1, np.nan, b), "bins": rng.random(n), "y": y})
    return p, spark.createDataFrame(p).withColumn("y", F.when(F.col("id") < n, F.col("y")))


def test_equals_the_loop(spark):
    p, df = table(spark, 300, 2)
    model = fit_softmax(df, features=["a", "odd name"], label="y", rounds=3, depth=2, rate=0.3, bins=8, min_rows=10)
    assert model.classes == ["DOWN", "FLAT", "UP"]
    x = np.stack([np.where(np.isnan(p[f]), -1, np.searchsorted(e, p[f], side="left")) for f, e in zip(model.features, model.edges)], axis=1)
    want = loop(x, p["y"].map({c: i for i, c in enumerate(model.classes)}).to_numpy(), 3, 3, 2, 0.3, 1.0, 10)
    got = model.probabilities(df, "prob", "chosen").orderBy("id").toPandas()
    assert list(got.columns) == [*df.columns, "prob", "chosen"]
    np.testing.assert_allclose(np.stack(got["prob"]), want, atol=1e-9)
    np.testing.assert_allclose(np.stack(got["prob"]).sum(axis=1), 1.0, atol=1e-12)
    assert list(got["chosen"]) == [model.classes[i] for i in want.argmax(axis=1)]


def test_learns_the_rule_and_needs_labels(spark):
    _, df = table(spark, 1_500, 7)
    model = fit_softmax(df.where("id < 1000"), features=["a", "odd name"], label="y", rounds=6, depth=3, rate=0.5)
    scored = model.probabilities(df.where("id >= 1000"), chosen="c")
    assert scored.agg(F.avg((F.col("c") == F.col("y")).cast("double"))).first()[0] > 0.9
    one = fit_softmax(df.where("y = 'UP'"), features=["a"], label="y", rounds=1)
    assert one.probabilities(df.limit(1)).first()["probabilities"] == [1.0]
    with pytest.raises(ValueError, match="classes"):
        fit_softmax(df.withColumn("y", F.lit(None).cast("string")), features=["a"], label="y")


def test_histograms_come_from_whole_tasks(spark):
    """What leaves a task is its histogram, not a row for each row, class and feature."""
    n, splits = 20_000, [{1: (0, 1)}, {}]
    rows = spark.range(0, n, 1, 2).select(
        F.array((F.col("id") % 4 - 1).cast("int"), F.lit(0)).alias("x"), (F.col("id") % 2).cast("int").alias("y"), F.array(F.lit(0.0), F.lit(0.0)).alias("s")
    )
    hist = _histograms(rows, splits, 1, 2, 4)
    assert "Generate" not in hist._jdf.queryExecution().toString()
    got = {(r.k, r.node, r.f, r.bin): (r.g, r.h, r.n) for r in hist.collect()}
    q = n // 4  # bins -1, 0, 1 go left, 2 goes right; only class 0 was split
    assert got == {
        (0, 2, 0, -1): (-q / 2, q / 4, q), (0, 2, 0, 0): (q / 2, q / 4, q), (0, 2, 0, 1): (-q / 2, q / 4, q), (0, 3, 0, 2): (q / 2, q / 4, q),
        (0, 2, 1, 0): (-q / 2, 3 * q / 4, 3 * q), (0, 3, 1, 0): (q / 2, q / 4, q),
    }
