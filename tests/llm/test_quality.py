"""The quality classifier: held-out accuracy, and its parts against plain loops."""

import zlib

import numpy as np
import pytest

from tests.llm.cases import ODD, documents, words
from tidemark.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def rank_share(scores, labels):
    """Share of (good, bad) pairs in the right order."""
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad))


def test_held_out_documents_are_told_apart(tables):
    docs, labels = tables
    scored = quality.with_score(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    scores, truth = np.array([r["_score"] for r in held]), np.array([r["quality"] for r in held])
    assert rank_share(scores, truth) > 0.97
    assert ((scores >= 0.3) == (truth == 1)).mean() > 0.93
    assert ((scores >= 0) & (scores <= 1)).all()


def test_held_out_labels_teach_nothing(spark, tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(3), flipped)
    assert (a.weights == b.weights).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_sample_is_bounded_and_extra_columns_stay(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels, sample=60)
    odd = documents(spark, ODD + [words(50, 1)], ids=[None, *range(1, len(ODD) + 1)])
    out = quality.with_score(odd, model)
    assert out.columns == [*odd.columns, "_score"] and out.count() == len(ODD) + 1
    assert all(0 <= r["_score"] <= 1 for r in out.collect())
    assert quality.with_score(documents(spark, []), model).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, 1), (2, 1)], [(1, None), (2, 5)], [(99, 0)]])
def test_one_class_or_no_labels(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    model = quality.fit(documents(spark, ["a b", "c d", "e"]), labels)
    assert 0 < model.score(np.array([3, 5])) < 1


def test_indicators_and_ratios():
    seen = np.zeros(quality.DIMENSIONS, bool)
    assert len(quality.indicators(b"", seen)) == 0
    a, b = quality.indicators(b"abc", seen), quality.indicators(b"abcabc", seen)
    assert set(a) <= set(b) and not seen.any()
    ratios = quality.log_count_ratios([np.array([1, 2]), np.array([2])], np.array([True, False]))
    total = quality.DIMENSIONS
    assert ratios[1] == pytest.approx(np.log((2 / (total + 2)) / (1 / (total + 1))))


def test_dual_coordinate_descent_reaches_the_optimum():
    draw = np.random.default_rng(0)
    rows = [np.array([0, 1]) for _ in range(60)]
    values = [v / np.linalg.norm(v) for v in draw.normal(size=(60, 2))]
    good = np.array([v[0] + 0.3 * draw.normal() > 0 for v in values])
    weights, bias = quality.dual_coordinate_descent(rows, values, good, rounds=500)
    signs, x = np.where(good, 1, -1), np.array(values)

    def loss(w):
        return w @ w / 2 + np.maximum(0, 1 - signs * (x @ w[:2] + w[2])).sum()

    best = np.array([*weights[:2], bias])
    for _ in range(300):
        assert loss(best) <= loss(best + 0.05 * draw.normal(size=3)) + 1e-3


def test_many_and_oddly_named_columns_stay(spark):
    from pyspark.sql import functions as F

    from tidemark.llm import exact_dedup, jaccard, mixing

    names = [f"c {i}, x" for i in range(40)]
    docs = documents(spark, ["a b c d e f", "a b c d e f", None]).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    model = quality.fit(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert quality.with_score(docs, model).drop("_score").columns == docs.columns
    for kept in (exact_dedup.without_copies(docs), jaccard.without_near_copies(docs), mixing.mix(docs)):
        assert kept.columns == docs.columns and {r["c 7, x"] for r in kept.collect()} == {7}


def test_one_id_on_many_rows_is_one_row_of_the_sample(spark, monkeypatch):
    ids = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 5][:20]
    texts = [words(30, i) for i in ids]
    again = [words(30, 1000 + k) for k in range(300)] + [None]
    docs = documents(spark, texts + again, ids=ids + [ids[3]] * len(again))
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[3], 1 - ids[3] % 2)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda rows, good: seen.append([r.tobytes() for r in rows]))
    quality.fit(docs, labels, sample=21)
    quality.fit(docs.repartition(5), labels, sample=21)
    quality.fit(docs, labels, sample=6)
    assert [len(rows) for rows in seen] == [21, 21, 6] and seen[0] == seen[1]
