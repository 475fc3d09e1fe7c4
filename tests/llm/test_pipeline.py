"""The pipeline stage by stage against brute force, and as a whole."""

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import documents
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_jaccard import brute as near
from tidemark.llm import packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, function in corpus_pipeline.STAGES:
        result = function(spark, docs, SF)
        out.append(result.collect())
        docs = spark.createDataFrame(out[-1], result.schema)
    return out


def test_each_stage_does_what_it_says(spark, stages):
    start, good, single, far, mixed, packed = stages
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in stages[1:5]:
        assert list(rows[0].asDict()) == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["_score"] for r in quality.with_score(docs, model).collect()}
    assert {r["doc_id"] for r in good} == {i for i, s in scores.items() if s >= 0.3} <= {r["doc_id"] for r in start}
    ids, texts = [r["doc_id"] for r in good], [r["text"] for r in good]
    assert sorted(r["doc_id"] for r in single) == sorted(i for i, v in copies(texts, ids).items() if v[2])
    ids, texts = [r["doc_id"] for r in single], [r["text"] for r in single]
    classes = near(texts, ids, 5, 80, 100)
    assert sorted(r["doc_id"] for r in far) == sorted({c if n else i for i, (n, c) in classes.items()})
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in far}
    whole = sum(len((r["text"] or "").encode().split()) for r in far)
    assert abs(sum(len((r["text"] or "").encode().split()) for r in mixed) - whole) < 0.2 * whole
    taken = {}
    for r in mixed:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert max(taken.values()) <= 3
    first = [r for r in packed if r["piece"] == 0]
    assert sorted(r["doc_id"] for r in first) == sorted(r["doc_id"] for r in mixed)


def test_run_equals_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    keys = ("doc_id", "piece", "length", "ids_crc32")
    assert sorted(tuple(r[k] for k in keys) for r in rows) == sorted(tuple(r[k] for k in keys) for r in stages[-1])


def test_stages_take_odd_tables(spark):
    docs = documents(spark, [None, "", " ", "one text", "one  text"], ["a", "a", None, "", "b"], [None, 1, 2, 3, 4])
    for name, function in corpus_pipeline.STAGES:
        result = function(spark, docs, SF)
        if name != "best-fit packing":
            assert result.columns == docs.columns
        result.collect()
        function(spark, documents(spark, []), SF).collect()


CLASHES = ["key", "copies", "digest", "sha", "points", "sifted", "score", "label", "node", "size", "piece", "component_id", "rows"]
CLASHES += [f"_{c}" for c in CLASHES] + ["_mix_key", "_mix_copies", "_rows", "_share", "_copy", "_of", "_KEY", "keep_id", "_keep_sha"]
CLASHES = list({c.lower(): c for c in CLASHES}.values())


def test_stages_keep_columns_whose_names_clash(spark):
    texts = ["one text here"] * 4 + ["another text of words", None]
    docs = documents(spark, texts, ["a", "a", "b", None, "b", "a"])
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.lit(i))
    mine = {c: i for i, c in enumerate(CLASHES)}
    for name, function in corpus_pipeline.STAGES:
        result = function(spark, docs, SF)
        rows = [r.asDict() for r in result.collect()]
        if name != "best-fit packing":
            assert result.columns == docs.columns and rows
            assert all({c: r[c] for c in CLASHES} == mine for r in rows)


def test_packing_is_deterministic():
    histogram = {7: 30, 900: 11, 4000: 3, 4096: 2}
    assert packing.pack_histogram(histogram) == packing.pack_histogram(dict(reversed(histogram.items())))
