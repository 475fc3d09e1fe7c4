"""Grace hash deduplication against a dictionary of contents."""

import hashlib

import pyarrow as pa
import pytest

from tests.llm.cases import ODD, documents
from tidemark.llm import exact_dedup

TEXTS = [*ODD, "a b", "ab", "a\nb ", "AB", "ab", None, "x" * 3000, "x " * 3000, *["hot copy"] * 200, *[f"hot {'' if i % 2 else ' '}copy 2" for i in range(50)]]


def brute(texts, ids):
    groups = {}
    for i, text in zip(ids, texts, strict=True):
        text = text or ""
        key = text.encode().translate(None, b" \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((-len(text), i))
    return {
        i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(key).hexdigest()) for key, g in groups.items() for _, i in g
    }


@pytest.mark.parametrize("budget", [64 << 20, 300])
def test_equals_a_dictionary(spark, budget):
    ids = [i * 31 % 1009 for i in range(len(TEXTS))]
    docs = documents(spark, TEXTS, ids=ids).repartition(6)
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.duplicate_groups(docs, budget).collect()}
    want = brute(TEXTS, ids)
    assert got == want
    kept = exact_dedup.without_copies(docs, budget)
    assert kept.columns == docs.columns
    texts = dict(zip(ids, TEXTS, strict=True))
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: texts[i] for i, v in want.items() if v[2]}


def test_repeated_rows_null_ids_and_nothing(spark):
    docs = documents(spark, ["q", "q", "q ", None, ""], ids=[3, 3, None, None, 9])
    rows = exact_dedup.duplicate_groups(docs).collect()
    assert sorted((r["group_size"], r["kept"]) for r in rows) == [(2, False), (2, True), (3, False), (3, False), (3, True)]
    assert {r["keep_id"] for r in rows if r["group_size"] == 2} == {9}
    assert len(exact_dedup.without_copies(docs).collect()) == 2
    assert exact_dedup.duplicate_groups(documents(spark, [])).collect() == []


def test_spill_files_split_by_every_digit():
    rows = [(i, i, i, 1, 1, (i % 7) << 3, b"s", b"content %d" % (i % 7)) for i in range(70)]
    batches = [pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), exact_dedup.LOCAL_ARROW, strict=True)], schema=exact_dedup.LOCAL_ARROW)]
    out = [r for b in exact_dedup.settle(batches, budget=100) for r in b.to_pylist()]
    assert sorted(r["group"] for r in out) == list(range(70))
    assert all(r["keep_id"] == r["group"] % 7 and r["group_size"] == 10 for r in out)


def test_table_tells_equal_hashes_apart():
    table = exact_dedup.ContentTable()
    names = [table.number(5, b"%d" % (i % 900)) for i in range(1800)]
    assert names == [i % 900 for i in range(1800)]
