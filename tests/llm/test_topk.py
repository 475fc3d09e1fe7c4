"""Exact top-k search against comparing all vectors."""

import math

import numpy as np
import pytest

from tidemark.llm import topk_search

SCHEMA = "vec_id long, embedding array<double>, vector string, score int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 1) for i, v in rows], SCHEMA)


def brute(rows, k):
    used = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = []
    for q in sorted(used):
        if q % 3 == 0:
            scores = []
            for i, vectors in used.items():
                for v in vectors if i != q else ():
                    scores.append((-sum(a * b for a, b in zip(used[q][0], v, strict=False)), i))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("scale", "cell"), [(1.0, 100), (1.0, 16384), (1e5, 64)])
def test_equals_comparing_all(spark, scale, cell):
    draw = np.random.default_rng(2)
    rows = [(i, (scale * draw.normal(size=40)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [math.nan] * 40), (2003, [math.inf] * 40), (None, [1.0] * 40)]
    rows += [(2004, [0.5]), (2005, []), (3, rows[3][1])]
    vectors = table(spark, rows).repartition(3)
    got = topk_search.top_k(vectors, lambda i: i % 3 == 0, k=7, step=8, cell_candidates=cell, cell_queries=50)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7)


def test_few_and_no_rows(spark):
    assert topk_search.top_k(table(spark, []), lambda i: i % 3 == 0).collect() == []
    assert topk_search.top_k(table(spark, [(3, [1.0])]), lambda i: i % 3 == 0).collect() == []
    got = topk_search.top_k(table(spark, [(3, [1.0]), (4, [-1.0])]), lambda i: i % 3 == 0).collect()
    assert list(map(tuple, got)) == [(3, 1, 4, -1024 * 1024)]


def test_numbers_beyond_doubles(spark):
    rows = [(3, [3e6, 1.0]), (4, [1e5, 1e-3]), (5, [1e5, 0.9]), (6, [1e12, 1.0])]
    got = [tuple(r) for r in topk_search.top_k(table(spark, rows), lambda i: i % 3 == 0, k=3).collect() if r["query_id"] == 3]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows[:3]}
    score = {i: sum(a * b for a, b in zip(whole[3], whole[i], strict=True)) for i in (4, 5)}
    assert [g[2:] for g in sorted(got)] == [(6, (1 << 63) - 1), (5, score[5]), (4, score[4])]
