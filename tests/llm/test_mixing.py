"""Mixing to target weights."""

from collections import defaultdict

import pytest

from tests.llm.cases import ODD, documents, words
from tidemark.llm import mixing


def test_targets_by_hand(spark):
    sizes = [("a", 100), ("b", 10), ("c", 600), (None, 0), ("", 50)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    # weights in order '', a, b, c, null: 1 2 3 1 2
    total, weight, cap = 760, {"": 1, "a": 2, "b": 3, "c": 1, None: 2}, {s: 3 * n for s, n in sizes}
    capped = set()
    while True:
        left = (total - sum(cap[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s, w in weight.items() if s not in capped and left * w > cap[s]}
        if not over:
            break
        capped |= over
    want = {s: cap[s] if s in capped else left * weight[s] for s in weight}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_words_taken_come_near_the_target(spark):
    texts = [words(1 + i * 7 % 40, i) for i in range(400)] + ["same size here"] * 150 + ODD
    sources = [f"s{i % 3}" for i in range(400)] + ["s1"] * 150 + [None, ""] * (len(ODD) // 2) + [None] * (len(ODD) % 2)
    docs = documents(spark, texts, sources).repartition(5)
    rows = mixing.copies(docs).collect()
    assert len(rows) == len(texts)
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r["copies"] <= 3
        text = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(text.split())
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for source, aim in target.items():
        assert abs(taken[source] - aim) <= most[source] + 1, source
    again = mixing.copies(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in rows for _ in range(r["copies"]))


def test_nothing_and_repeated_rows(spark):
    assert mixing.copies(documents(spark, [])).collect() == []
    assert mixing.mix(documents(spark, [])).collect() == []
    rows = mixing.copies(documents(spark, ["a b", "a b", None], ids=[1, 1, None])).collect()
    assert sorted((r["size"], r["copies"]) for r in rows if r["size"]) == [(2, 1), (2, 1)]
    assert all(r["copies"] == 0 for r in mixing.copies(documents(spark, [None, ""])).collect())
