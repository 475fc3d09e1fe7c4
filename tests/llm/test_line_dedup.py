"""Reversible line dedup against a loop; the filter against a set."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import ODD, documents, words
from tidemark.llm import line_dedup
from tidemark.llm.cuckoo import CuckooFilter

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_loop(rows, least=10):
    """Rows (id, text) to sorted (id, n_lines, n_dropped, text)."""
    rank = lambda i: (i is None, i or 0)
    cut = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(BLANK).translate(LOWER)
    first = {}
    for i, lines in cut:
        for k in map(key, lines):
            if len(k) >= least and (k not in first or rank(i) < rank(first[k])):
                first[k] = i
    out = []
    for i, lines in cut:
        stay = [x for x in lines if len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    lines = [words(4, i) for i in range(30)] + ["", "short", "  ", "ÄÖÜäöü ßé", "ÄÖÜäöü ßéx", "x" * 9, "x" * 10, "日本語日本語日本語", "日本語日本語日本語日"]
    draw = np.random.default_rng(5)
    texts = list(ODD) + ["Home | About us\n" + words(300, 99)] * 3
    for _ in range(120):
        picked = [lines[j] for j in draw.integers(0, len(lines), draw.integers(0, 9))]
        texts.append("\n".join(("\t" + p.upper() + " \r") if draw.random() < 0.3 and p.isascii() else p for p in picked))
    texts += ["all alone in here\nHOME | about us", "  home | about us  ", "A" * 200_000 + "\nhome | About us"]
    ids = [int(i) for i in draw.permutation(len(texts)) - 20]
    ids[3], ids[4], ids[10] = ids[5], ids[5], None
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])


def test_equals_a_loop(spark, rows):
    assert rows_of(line_dedup.without_repeated_lines(frame(spark, rows))) == by_loop(rows)


def test_insertions_in_parts_equal_one(spark, rows):
    index = None
    for part in (rows[:50], rows[50:], []):
        index = line_dedup.insert(frame(spark, part), index, most_bytes=2000, most_keys=8)
    assert index.shards >= 8
    assert rows_of(line_dedup.kept_texts(index)) == by_loop(rows)
    whole = line_dedup.insert(frame(spark, rows))
    assert sorted(line_dedup.line_counts(index).collect()) == sorted(line_dedup.line_counts(whole).collect())


def test_deletion_is_as_if_never_inserted(spark, rows):
    index = line_dedup.insert(frame(spark, rows), most_bytes=2000, most_keys=20)
    gone = sorted(i for i, _ in rows if i is not None)[:60:2]
    ids = spark.createDataFrame([(i,) for i in [*gone, gone[0], 10**9, None]], "doc_id long")
    left = [(i, t) for i, t in rows if i not in set(gone)]
    cut = line_dedup.delete(index, ids)
    assert rows_of(line_dedup.kept_texts(cut)) == by_loop(left)
    never = line_dedup.insert(frame(spark, left))
    assert sorted(line_dedup.line_counts(cut).collect()) == sorted(line_dedup.line_counts(never).collect())
    back = line_dedup.insert(frame(spark, [(i, t) for i, t in rows if i in set(gone)]), cut)
    assert rows_of(line_dedup.kept_texts(back)) == by_loop(rows)


def test_all_deleted_and_nothing(spark, rows):
    docs = frame(spark, rows[:9])
    index = line_dedup.delete(line_dedup.insert(docs), docs)
    assert line_dedup.kept_texts(index).count() == sum(i is None for i, _ in rows[:9])
    assert line_dedup.without_repeated_lines(frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=400, unique=True), st.integers(0, 400))
def test_filter(values, n):
    hashes = np.array(values, np.uint64)
    filter_ = CuckooFilter.of(hashes[:n])
    if not filter_.add(hashes[n:]):
        filter_ = CuckooFilter.of(hashes)
    assert filter_.has(hashes).all()
    filter_ = CuckooFilter.read(filter_.write())
    filter_.remove(hashes[:n])
    assert filter_.has(hashes[n:]).all()
    filter_.remove(hashes[n:])
    assert not filter_.table.any()


def test_filter_is_seldom_wrong():
    draw = np.random.default_rng(1)
    filter_ = CuckooFilter.of(draw.integers(0, 2**63, 100_000).astype(np.uint64))
    others = draw.integers(0, 2**63, 100_000).astype(np.uint64) | np.uint64(1 << 63)
    assert filter_.has(others).mean() < 0.001
