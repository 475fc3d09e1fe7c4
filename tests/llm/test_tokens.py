"""Token counts and packing against the tokenizers themselves."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import ODD, documents, words
from tidemark.llm import packing, token_counts

REAL = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def texts(spark):
    real = [r["text"] for r in spark.read.parquet(REAL).select("text").collect()]
    long = [words(9000, 1), "no-blank" * 3000]
    return ODD + real + long + ["copy me"] * 40


def test_counts_equal_the_library(spark, texts):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        assert got[i] == (len(text.encode()), len(model.encode(text, add_special_tokens=False).ids)), repr(text[:60])


def test_counts_with_tiny_blocks_and_memory(spark, texts):
    docs = documents(spark, texts[:60])
    want = sorted(map(tuple, token_counts.token_counts(docs).collect()))
    assert sorted(map(tuple, token_counts.token_counts(docs, most_pairs=5, most_known=3).collect())) == want


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(documents(spark, [])).collect() == []


def test_repeated_and_null_ids(spark):
    docs = documents(spark, ["a b", "a b", "c"], ids=[5, 5, None])
    assert sorted(map(str, (r["doc_id"] for r in token_counts.token_counts(docs).collect()))) == ["5", "5", "None"]


@pytest.mark.parametrize("most_words", [150_000, 20])
def test_packing_holds_every_id_once(spark, texts, most_words):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packing._word_ids.clear()
    texts = texts if most_words > 100 else texts[:80]
    rows = packing.pack(documents(spark, texts), with_ids=True, most_words=most_words).collect()
    whole, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for i, text in enumerate(texts):
        parts = sorted(whole[i], key=lambda r: r["piece"])
        assert [t for r in parts for t in r["ids"]] == [*model.encode(text or "", add_special_tokens=False).ids, 1], repr(text)
        assert [r["start"] for r in parts] == [4096 * k for k in range(len(parts))]
        assert all(r["length"] == 4096 for r in parts[:-1])
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.02 * total / 4096 + 1


def test_packing_nothing_and_repeats(spark):
    assert packing.pack(documents(spark, [])).collect() == []
    rows = packing.pack(documents(spark, ["x y", "x y", None], ids=[1, 1, None])).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


@pytest.mark.parametrize("seed", range(4))
def test_histogram_is_packed_whole(seed):
    draw = np.random.default_rng(seed)
    lengths = np.clip(draw.lognormal(6.2, 1.0, 20_000).astype(int), 1, 4096)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    bins = packing.pack_histogram(histogram)
    held = defaultdict(int)
    for pattern, n in bins:
        assert 0 < sum(pattern) <= 4096
        for length in pattern:
            held[length] += n
    assert dict(held) == histogram
    least = -(-int(lengths.sum()) // 4096)
    assert sum(n for _, n in bins) <= 1.003 * least + 1


def test_knapsack_pricing_is_best():
    import itertools

    sizes, weights = np.array([2, 3, 5]), np.array([1.0, 1.7, 2.6])
    chosen = packing.best_configuration(weights, sizes, 11)
    best = max(
        sum(n * w for n, w in zip(c, weights, strict=True))
        for c in itertools.product(range(6), repeat=3)
        if sum(n * s for n, s in zip(c, sizes, strict=True)) <= 11
    )
    assert sum(sizes[chosen]) <= 11 and abs(sum(weights[chosen]) - best) < 1e-9
