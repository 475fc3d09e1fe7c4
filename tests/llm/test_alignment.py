"""Cross-tokenizer alignment against the tokenizers on whole texts and all overlapping pairs."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import ODD, documents, words
from tidemark.llm import alignment

REAL = "/root/testdata/sf0.001/documents.parquet"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters():
    """The byte-level alphabet, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = letters()


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(both, text):
    """Ids and bytes of both over the whole text, or None where the bytes differ."""
    if not text:
        return None
    a, b = both
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    raw_a = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    return (ids_a, raw_a, ids_b, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else None


def by_hand(both, texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each text; documents and links of each pair."""
    found, links_of, docs_of = [], Counter(), Counter()
    for text in texts:
        t = tokens(both, text)
        if t is None:
            found.append(None)
            continue
        ids_a, raw_a, ids_b, raw_b = t
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        links = []
        j = 0
        for i, end in enumerate(ends_a):
            start = end - len(raw_a[i])
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(ids_b) and ends_b[k] - len(raw_b[k]) < end:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, i, j = [], 0, 0
        for cut in cuts:
            i2, j2 = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
            groups.append(",".join(map(str, ids_a[i:i2])) + "|" + ",".join(map(str, ids_b[j:j2])))
            i, j = i2, j2
        found.append((len(ids_a), len(ids_b), links, groups))
        links_of.update(links)
        docs_of.update(set(links))
    best = Counter()
    for (_, b), n in links_of.items():
        best[b] = max(best[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = f
            top = sum(links_of[x] == best[x[1]] for x in links)
            out.append((n_a, n_b, len(groups), len(links), top, sum(links_of[x] for x in links), ";".join(groups)))
    return out, {(*k, docs_of[k], n) for k, n in links_of.items()}


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
STRANGE = [
    "a\r\nb\r\n c;\r\n\r\n  d\r", "x  y   z    \n\n\n  w \n v\t\tu \t s", "▁ is not a space", "a▁b", " lead", "  lead", "trail ", "trail  ",
    "\n", "\n\n", " ", "   ", "<s> </s> <unk> <0x0A> <|endoftext|>", "a\x00b \x00", "word\nword\n\nword \n word\n  word", "\xa0x \xa0 y\xa0\xa0z 　w",
    "no em  em ls  ", "ﬁ x² é \U0001f600\U0001f600 \U00020000", "});\r\n\t});\r\n" * 5, "the the the " * 40, "    indented\n        more\n",
]


@pytest.fixture(scope="module")
def texts(spark):
    real = [r["text"] for r in spark.read.parquet(REAL).select("text").collect()]
    return ODD + STRANGE + real + [words(9000, 1), "no-blank" * 3000] + ["copy me"] * 40


def test_equals_the_whole_texts(spark, both, texts):
    want, pairs = by_hand(both, texts)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == want[i], repr((text or "")[:80])
    assert {tuple(r) for r in alignment.pair_counts(documents(spark, texts)).collect()} == pairs


def test_tiny_blocks_memory_and_shards(spark, both, texts):
    texts = texts[:70]
    want, _ = by_hand(both, texts)
    rows = alignment.align(documents(spark, texts), most_held=30, most_known=5, most_entries=40).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == dict(enumerate(want))


def test_nothing_nulls_and_repeats(spark):
    assert alignment.align(documents(spark, [])).collect() == []
    rows = alignment.align(documents(spark, [None, "", "a b", "a b"], ids=[1, 2, None, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"], r["n_best"]) for r in rows) == [
        ("1", 0, 0, 0), ("2", 0, 0, 0), ("None", 2, 4, 2), ("None", 2, 4, 2),
    ]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab'.1 \n\t\r\xa0　é▁;é日<>"), max_size=24))
def test_stretches_are_what_whole_texts_give(text):
    own = alignment.pieces(*PATHS)
    stretches = own.stretches(" " + text)
    assert "".join(stretches) == " " + text
    if text and "▁" not in text:  # such texts have no tokens
        ids = own.encode(stretches)
        assert np.frombuffer(b"".join(a for a, _ in ids), "<u4").tolist() == own.a.encode(" " + text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(b for _, b in ids), "<u4").tolist() == own.b.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 99)), st.integers(1, 300), max_size=200))
def test_bitmaps_return_what_went_in(times):
    key = sorted(times)
    pair, doc = np.array([p for p, _ in key], np.int64), np.array([d for _, d in key], np.int64)
    planes = alignment.planes_of(pair, doc, np.array([times[k] for k in key], np.int64), 6, 100)
    back = Counter()
    for k, plane in enumerate(planes):
        for p, d in zip(*alignment.read_bitmap(plane, 100), strict=True):
            back[int(p), int(d)] += 1 << k
    assert back == times
    docs, links = alignment.merged(planes, 6, 100)
    assert docs.tolist() == [sum(p == i for p, _ in key) for i in range(6)]
    assert links.tolist() == [sum(n for (p, _), n in times.items() if p == i) for i in range(6)]
