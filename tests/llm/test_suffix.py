"""Removal of repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import ODD, documents, words
from tidemark.llm import suffix_dedup

REAL = "/root/testdata/sf0.001/documents.parquet"


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(11)
    real = [r["text"] for r in spark.read.parquet(REAL).select("text").limit(70).collect()]
    passage, long = words(70, 1), words(400, 2)
    out = [*ODD, *real]
    for seed in range(25):  # passages at the start, the end and inside, and parts of them
        a, b = draw.randrange(200), draw.randrange(200, len(passage))
        out.append(words(draw.randrange(30), seed) + passage[a:b] + words(draw.randrange(30), seed + 99))
    for _ in range(6):  # near copies
        split = long.split()
        split[draw.randrange(400)] = "edit"
        out.append(" ".join(split))
    out += [long, long, "ab" * 400, "a" * 500, "a" * 199, "a" * 200, words(20, 5)[:200], words(20, 5)[:200] + "x"]
    out += [passage[:199], passage + "ö" + passage, "日本語" * 120, None]
    # repeats of exactly 200 and of 199 bytes between different neighbours
    edge = words(60, 8)[:200]
    return out + ["x" + edge + "y", "z" + edge + "w", "q" + edge[:199] + "!", words(40, 9)[:150] + edge[50:] + edge[:50]]


@pytest.mark.parametrize("many", [20_000, 3])
def test_equals_all_windows(spark, texts, many):
    docs = documents(spark, texts).repartition(4)
    rows = suffix_dedup.remove_repeats(docs, many=many, with_text=True).collect()
    got = {r["doc_id"]: tuple(r)[1:4] + (r["kept_sha256"], bytes(r["kept"])) for r in rows}
    assert len(rows) == len(texts)
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, (i, repr((texts[i] or "")[:50]))


def test_long_texts_in_segments(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    raw = [t.encode() for t in texts if t and len(t.encode()) >= 200]
    for text in raw:
        want = suffix_dedup._anchors([(len(text), 0, 0, text)] if len(text) < 300 else [])[1] if len(text) < 300 else None
        found = set()
        for start in range(0, len(text) - 199, 300):
            first = max(0, start - suffix_dedup.LEFT)
            part = text[first : start + 300 + suffix_dedup.LEFT + 200]
            found |= set(suffix_dedup._anchors([(len(text), first, start, part)])[1].tolist())
        monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 18)
        whole = set(suffix_dedup._anchors([(len(text), 0, 0, text)])[1].tolist())
        monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
        assert found == whole and (want is None or set(want.tolist()) == whole)


def test_nothing_and_repeated_rows(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).collect() == []
    text = words(60, 1)
    rows = suffix_dedup.remove_repeats(documents(spark, [text, text, "short", None], ids=[1, 1, None, None])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 0, len(text), len(text)]


def test_deep_shallow_order():
    draw = np.random.default_rng(0)
    for size in (33, 20, 8, 5):
        strings = draw.integers(0, 2, (600, size)).astype(np.uint8)
        strings[100:300, : size * 3 // 4] = strings[100, : size * 3 // 4]
        strings[300:320] = strings[300]
        group = draw.integers(0, 5, 600)
        order, common = suffix_dedup.deep_shallow_order(group, strings)
        rows = [(int(group[i]), strings[i].tobytes()) for i in order]
        assert rows == sorted((int(g), s.tobytes()) for g, s in zip(group, strings, strict=True))
        for k in range(1, 600):
            (g, a), (h, b) = rows[k - 1], rows[k]
            same = next((i for i in range(size) if a[i] != b[i]), size)
            assert common[k] == (same if g == h else 0)
    least = suffix_dedup.RangeLeast(common)
    for _ in range(200):
        a, b = sorted(draw.integers(0, 600, 2).tolist())
        assert least.between(np.array([a]), np.array([b]))[0] == common[a : b + 1].min()


@pytest.mark.parametrize("many", [20_000, 3])
def test_nul_bytes_at_edges_are_no_padding(spark, many):
    texts = []
    for seed in range(12):
        passage = words(80, seed + 500)[: 172 + 5 * seed]
        before, after, nuls = words(40, seed + 600), words(40, seed + 700), "\0" * 40
        texts += [before + passage, after + passage + nuls + before[:60]]
        passage = words(80, seed + 800)[: 172 + 5 * seed]
        texts += [passage + after[::-1], before[::-1] + nuls + passage + after[60:]]
    texts += ["\0" * 300, "\0" * 199, "a" + "\0" * 210]
    rows = suffix_dedup.remove_repeats(documents(spark, texts).repartition(4), many=many, with_text=True).collect()
    got = {r["doc_id"]: tuple(r)[1:4] + (r["kept_sha256"], bytes(r["kept"])) for r in rows}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, i


def test_windows_beyond_a_text_flag_no_partner():
    slack = suffix_dedup.SLACK
    draw = np.random.default_rng(3)
    n = 400
    group, left = draw.integers(0, 4, n), draw.integers(0, 2, (n, slack)).astype(np.uint8)
    right = draw.integers(0, 2, (n, slack)).astype(np.uint8)
    left[:, 3:], right[:, 3:] = 0, 0  # real NULs look like padding
    reach_left, reach_right = draw.integers(0, slack + 1, n), draw.integers(0, slack + 1, n)
    flags = suffix_dedup.duplicate_starts(group, left, right, reach_left, reach_right)
    for t in range(slack + 1):
        fits = (reach_left >= t) & (reach_right >= slack - t)
        window = [(int(group[i]), left[i, :t].tobytes(), right[i, : slack - t].tobytes()) for i in range(n)]
        seen = Counter(w for w, ok in zip(window, fits, strict=True) if ok)
        assert flags[:, t].tolist() == [bool(ok) and seen[w] > 1 for w, ok in zip(window, fits, strict=True)]
