"""The n-gram Jaccard join against comparing all pairs."""

import random

import numpy as np
import pytest

from tests.llm.cases import ODD, documents, words
from tidemark.llm import groups, jaccard

REAL = "/root/testdata/sf0.001/documents.parquet"


def shingle_set(text, n):
    split = (text or "").encode().lower().split()
    if not split:
        return set()
    return {tuple(split[i : i + n]) for i in range(max(1, len(split) - n + 1))}


def brute(texts, ids, n, num, den):
    sets = [shingle_set(t, n) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, one in enumerate(ids):
        least[find(i)] = min(least.get(find(i), one), one)
    return {one: (len(s), least[find(i)]) for i, (one, s) in enumerate(zip(ids, sets, strict=True))}


def edited(text, draw, n):
    split = text.split()
    for _ in range(n):
        split[draw.randrange(len(split))] = words(1, draw.random())
    return " ".join(split)


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    real = [r["text"] for r in spark.read.parquet(REAL).select("text").limit(120).collect()]
    out = ODD + real
    for seed in range(12):  # families around the threshold, with a passage they all share
        base = words(draw.randint(40, 160), seed)
        out += [edited(base, draw, draw.randint(0, 6)) + " " + words(30, 99) for _ in range(draw.randint(2, 9))]
    out += [words(3, 5), words(3, 5).upper(), words(2, 5)] + ["same words here"] * 5
    base = words(60, 77)
    return out + [edited(base, draw, draw.randint(0, 3)) for _ in range(60)]


@pytest.mark.parametrize(("n", "num", "block"), [(4, 85, 128), (5, 80, 7), (2, 50, 128)])
def test_components_equal_all_pairs(spark, texts, n, num, block):
    ids = [7 * i % 1009 for i in range(len(texts))]
    want = brute(texts, ids, n, num, 100)
    docs = documents(spark, texts, ids=ids).repartition(5)
    rows = jaccard.jaccard_components(docs, n_words=n, num=num, block=block, most=500).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    kept = jaccard.without_near_copies(docs, n_words=n, num=num, block=block)
    assert kept.columns == docs.columns
    empty = {i for i, (size, _) in want.items() if not size}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()} | empty)


def test_repeated_rows_null_ids_and_nothing(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "x", None, None], ids=[4, 4, None, 2, None])
    rows = jaccard.jaccard_components(docs).collect()
    assert sorted(map(str, rows)) == sorted(
        f"Row(doc_id={i}, n_shingles={n}, component_id={c})"
        for i, n, c in [(4, 2, 4), (4, 2, 4), (None, 1, None), (2, 0, 2), (None, 0, None)]
    )
    assert len(jaccard.without_near_copies(docs).collect()) == 4
    assert jaccard.jaccard_components(documents(spark, [])).collect() == []
    assert jaccard.without_near_copies(documents(spark, [])).collect() == []


def test_components_across_tasks(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(200)]
    got = {r["node"]: r["label"] for r in groups.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    names = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(names)}
    label = groups.local_components(
        len(names), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges])
    )
    alone = {x for e in edges for x in e} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: names[label[at[n]]] for n in names if n not in alone}
    reach = {n: n for n in names}
    for _ in range(300):
        for a, b in edges:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert all(got.get(n, n) == reach[n] for n in names)


def test_shingles_and_sieve():
    assert len(jaccard.shingles(b"a b a b a b", 2)) == 2
    assert len(jaccard.shingles(b"a b", 4)) == 1 and len(jaccard.shingles(b"", 4)) == 0
    assert jaccard.shingles(b"x a b c d", 4)[0] in jaccard.shingles(b"x a b c d e", 4)
    assert not set(jaccard.shingles(b"a b", 4)) & set(jaccard.shingles(b"a b", 1))


@pytest.mark.parametrize(("num", "den"), [(80, 100), (85, 100), (3, 5), (99, 100), (1, 1)])
def test_similar_sets_share_a_part(num, den):
    draw = np.random.default_rng(num)
    weights = draw.integers(1, 137, 1 << jaccard.SKETCH_BITS).astype(np.uint8)
    for n in [*range(1, 60), 97, 400, 2500]:
        for extra in {0, n // 50, n * (den - num) // (2 * den), n * (den - num) // num}:
            # as many other members as the threshold allows, with `extra` of them more in one set
            pool = draw.integers(0, 1 << 63, 3 * n + 10).astype(np.uint64) * np.uint64(2)
            for k in range(n * (den - num) // (den + num) + 1, -1, -1):  # members that each replaces, from the most
                a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[k:n], pool[n : n + k + extra]]))
                common = len(np.intersect1d(a, b))
                if common and den * common >= num * (len(a) + len(b) - common):
                    mine, other = (set(jaccard.parts_of(s, weights, num, den)[0].tolist()) for s in (a, b))
                    assert mine & other, (n, extra, k)
                    break


def test_texts_that_share_passages_are_not_compared_in_pairs(spark, monkeypatch):
    draw = random.Random(11)
    passages = 5 * [words(40, 1000 + i) for i in range(360)]  # each stands in five texts
    draw.shuffle(passages)
    texts = [" ".join(passages[i : i + 6]) for i in range(0, len(passages), 6)]
    texts += [edited(t, draw, 2) for t in texts[:20]]
    layers = {}

    def kept(df, name, real=jaccard.stage):
        layers[name] = real(df, name)
        return layers[name]

    monkeypatch.setattr(jaccard, "stage", kept)
    docs = documents(spark, texts).repartition(5)
    rows = jaccard.jaccard_components(docs, n_words=4, num=85, block=8).collect()
    assert layers["jaccard-sizes"].agg({"size": "max"}).first()[0] > 200  # linked by single n-grams
    sent = sum(len(r["others"]) for r in layers["jaccard-clustered"].select("others").collect())
    assert sent <= 2 * len(texts)  # copies of texts that are compared
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(texts, range(len(texts)), 4, 85, 100)
