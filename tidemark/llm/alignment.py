"""Cross-tokenizer alignment by inverted pair bitmaps.

Tokenizer A is byte-level BPE, tokenizer B piece BPE with byte fallback. Both cut the same
bytes (a space, then the text). Where tokens of both end, a group ends; a token of A and one
of B are linked where their bytes overlap.

1. Scan tasks cut texts at places no token of either tokenizer can span, encode each distinct
   stretch once, and align all stretches of a block at once as arrays.
2. A block of documents has, for each linked pair of ids, bitmaps over its documents: plane k
   holds those whose number of links has bit k. Bitmaps with few documents are lists of
   16-bit places, the others bits. The planes OR-merged and counted give the documents of
   a pair, counted by weight its links.
3. One entry a block and pair goes to the pair's shard, where counts are added up. The highest
   count of each B id is found and comes back to the pairs.
4. Counts go back to the blocks that hold the pair, and the bitmaps hand them to documents.

A pair that a third of all documents hold is one entry a block; blocks are bounded by stretches.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of, small
from tidemark.session import stage

# Unicode White_Space but for the space itself; the pre-tokenizer's \s is this and the space.
_OTHER = "\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_BLANK = "\\x20" + _OTHER
# Stretches that no token of A or B crosses, if B has no longer piece with a blank of _OTHER in
# it: a word with the one space before it; of the blanks before a word all but the last, which
# then stands alone; blanks whose last two are spaces stay with the word behind them.
FINE = re.compile(
    f" ?[^{_BLANK}]+|[{_BLANK}]+(?=[{_OTHER}][^{_BLANK}])|[{_OTHER}](?=[^{_BLANK}])"
    f"|[{_BLANK}]*[{_OTHER}](?= [^{_BLANK}])|[{_BLANK}]+[^{_BLANK}]*"
)
# Cut only before blanks that begin with a space: right whatever other blanks B's pieces hold.
COARSE = re.compile(f"[{_BLANK}]*[^{_BLANK}]+(?:[{_OTHER}][{_BLANK}]*[^{_BLANK}]*)*|[{_BLANK}]+")

WORD = re.compile(f" [^{_BLANK}]+")

DOC = "place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
ROW = f"block long, {DOC}, n_pairs long, n_held long, pairs binary, n_docs binary, n_links_of binary, planes binary"
ROW_ARROW = pa.schema(
    [("block", pa.int64()), ("place", pa.int32())]
    + [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups", pa.string()), ("n_pairs", pa.int64()), ("n_held", pa.int64())]
    + [(n, pa.binary()) for n in ("pairs", "n_docs", "n_links_of", "planes")]
)
PLANE_ARROW = pa.schema([(n, pa.binary()) for n in ("size", "few", "bits")])
ENTRY = "shard long, block long, start long, pairs binary, n_docs binary, n_links_of binary"
ENTRY_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("shard", "block", "start")] + [(n, pa.binary()) for n in ("pairs", "n_docs", "n_links_of")]
)
PAIR = "shard long, pair long, b int, docs long, links long"
PAIR_ARROW = pa.schema(
    [("shard", pa.int64()), ("pair", pa.int64()), ("b", pa.int32()), ("docs", pa.int64()), ("links", pa.int64())]
)
ANSWER = "block long, at binary, links binary, best binary"
ANSWER_ARROW = pa.schema([("block", pa.int64())] + [(n, pa.binary()) for n in ("at", "links", "best")])
SCORED = "block long, place int, n_best long, count_sum long"
SCORED_ARROW = pa.schema(
    [("block", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())]
)


class Pieces:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = {self._letter(pre_tokenizers, b): b for b in range(128)} | self._upper(pre_tokenizers)
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)  # special tokens have none
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes_a[i] = bytes(letters[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b: list[bytes] = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:-1], 16)]))
            elif self.b.is_unknown(i) or self.b.is_control(i):
                self.bytes_b.append(b"")
            else:
                self.bytes_b.append(piece.replace("▁", " ").encode())
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.digits = digits(max(len(self.bytes_a), len(self.bytes_b)))
        normal = [self.b.id_to_piece(i) for i in range(len(self.bytes_b)) if not self.b.is_byte(i)]
        others = re.compile(f"[{_OTHER}]")
        held = {c for p in normal if len(p) > 1 for c in others.findall(p)}
        # blanks of longer pieces: texts with one of them are cut at fewer places
        self.joins = re.compile("[" + "".join(map(re.escape, sorted(held))) + "]") if held else None
        if "\n" in held:
            raise ValueError("pieces with line feeds in them are not provided for")
        self.cuts = all("▁" not in p.lstrip("▁") for p in normal)  # no piece goes on behind a word

    @staticmethod
    def _letter(pre_tokenizers, byte: int) -> str:
        cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return cut.pre_tokenize_str(chr(byte))[0][0]

    @staticmethod
    def _upper(pre_tokenizers) -> dict[str, int]:
        """Letters of the bytes beyond ASCII, from code points of two and more bytes."""
        cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        out: dict[str, int] = {}
        for point in chain(range(0x80, 0x800), range(0x800, 0x10000, 0x400), range(0x10000, 0x110000, 0x10000)):
            if not 0xD800 <= point < 0xE000:
                out.update(zip("".join(t for t, _ in cut.pre_tokenize_str(chr(point))), chr(point).encode(), strict=True))
        return out

    def stretches(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return (COARSE if self.joins and self.joins.search(text) else FINE).findall(text)

    def encode(self, stretches: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both for each stretch as it stands in a text (32 bits each); None where bytes of A or B differ from it.

        Words with a space before them are encoded many at a time, as one text, and cut apart
        by their bytes; what else there is, and words whose bytes do not come back, one by one.
        """
        out: list[tuple[bytes, bytes] | None] = [None] * len(stretches)
        words, rest = [], []
        for i, s in enumerate(stretches):
            (words if self.cuts and WORD.fullmatch(s) else rest).append(i)
        for start in range(0, len(words), 500):
            part = words[start : start + 500]
            raw = [stretches[i].encode() for i in part]
            text = "".join([stretches[i] for i in part])
            a = self.a.encode(text, add_special_tokens=False).ids
            b = self.b.encode(text[1:])
            if not (self.join_a(a) == b"".join(raw) == self.join_b(b)):
                rest += part
                continue
            ends = np.cumsum([len(r) for r in raw])
            a, b = np.array(a, "<u4"), np.array(b, "<u4")
            cuts_a = np.searchsorted(np.cumsum(self.size_a[a]), ends) + 1
            cuts_b = np.searchsorted(np.cumsum(self.size_b[b]), ends) + 1
            a, b, from_a, from_b = a.tobytes(), b.tobytes(), 0, 0
            for i, to_a, to_b in zip(part, (4 * cuts_a).tolist(), (4 * cuts_b).tolist(), strict=True):
                out[i] = a[from_a:to_a], b[from_b:to_b]
                from_a, from_b = to_a, to_b
        if rest:
            lone = [stretches[i] for i in rest]
            ids_a = [e.ids for e in self.a.encode_batch_fast(lone, add_special_tokens=False)]
            # B puts a space before what it gets: one that is there is left out; where there is none,
            # a line feed stands before the stretch, and its two ids (space, feed) are taken off.
            own = [s[:1] == " " and len(s) > 1 for s in lone]
            ids_b = self.b.encode([s[1:] if o else "\n" + s for s, o in zip(lone, own, strict=True)], num_threads=1)
            for i, a, b, o in zip(rest, ids_a, ids_b, own, strict=True):
                b = b if o else b[2:]
                if self.join_a(a) == stretches[i].encode() == self.join_b(b):
                    out[i] = np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()
        return out

    def join_a(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_a.__getitem__, ids))

    def join_b(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_b.__getitem__, ids))


@lru_cache(maxsize=2)
def pieces(path_a: str, path_b: str) -> Pieces:
    return Pieces(path_a, path_b)


def digits(n: int) -> np.ndarray:
    """The numbers below ``n`` in decimal digits, in the last places of their row; 0 where there is none."""
    width = len(str(n))
    value, out = np.arange(n), np.zeros((n, width), np.uint8)
    for place in range(width):
        held = (value >= 10**place) | (place == 0)
        out[held, width - 1 - place] = 48 + value[held] // 10**place % 10
    return out


class Aligned(NamedTuple):
    """Stretches, aligned: sizes by stretch, links one stretch after the other, groups as text (each with ``;`` behind it)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    groups: list[bytes]


def _per(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each start to the next; no part is empty."""
    return np.add.reduceat(values.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def aligned(ids: list[tuple[bytes, bytes]], both: Pieces) -> Aligned:
    """All stretches at once: the bytes of both lie in one row, so ends can be looked up in each other."""
    n_a = np.fromiter((len(a) for a, _ in ids), np.int64, len(ids)) // 4
    n_b = np.fromiter((len(b) for _, b in ids), np.int64, len(ids)) // 4
    a = np.frombuffer(b"".join([a for a, _ in ids]), "<u4").astype(np.int64)
    b = np.frombuffer(b"".join([b for _, b in ids]), "<u4").astype(np.int64)
    from_a, from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    end_a, end_b = np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b])
    low = np.searchsorted(end_b, end_a - both.size_a[a], side="right")  # the first b that overlaps
    high = np.searchsorted(end_b - both.size_b[b], end_a, side="left")
    wide = high - low
    inner = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    links = np.repeat(a, wide) << 32 | b[np.repeat(low, wide) + inner]
    cut_a, cut_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    # text: ids of A, then of B, group by group; what stands behind an id says what follows
    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    behind = np.concatenate([np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))])[order]
    value = np.concatenate([a, b])[order]
    letters = np.empty((len(value), both.digits.shape[1] + 1), np.uint8)
    letters[:, :-1], letters[:, -1] = both.digits[value], behind
    size = (letters != 0).sum(axis=1)
    text = letters[letters != 0].tobytes()
    of = np.concatenate([np.repeat(np.arange(len(ids)), n_a), np.repeat(np.arange(len(ids)), n_b)])[order]
    ends = np.cumsum(np.bincount(of, weights=size, minlength=len(ids)).astype(np.int64)).tolist()
    groups = [text[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
    return Aligned(n_a, n_b, _per(from_a, cut_a), _per(from_a, wide), links, groups)


_known: dict[tuple[str, str], dict[str, tuple[bytes, bytes] | None]] = {}  # of this worker, bounded by ``most_known``


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and the number of each value among them."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(first) - 1
    return ordered[first], number


def _zip(values: np.ndarray, kind: str) -> bytes:
    """Numbers, each byte of them in a plane of its own, compressed."""
    raw = np.ascontiguousarray(values.astype(kind))
    flat = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        out.write(np.ascontiguousarray(flat).tobytes())
    return sink.getvalue().to_pybytes()


def _unzip(value: bytes, kind: str) -> np.ndarray:
    with pa.CompressedInputStream(pa.BufferReader(value), "zstd") as source:
        flat = np.frombuffer(source.read(), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def write_bitmap(pair: np.ndarray, doc: np.ndarray, n_pairs: int, n_docs: int) -> dict[str, bytes]:
    """For each pair its documents (both sorted): lists of places where they are few, else bits."""
    size = np.bincount(pair, minlength=n_pairs)
    as_bits = size * 16 > n_docs
    dense = as_bits[pair]
    line = np.cumsum(as_bits) - 1
    bits = np.zeros((int(as_bits.sum()), n_docs), bool)
    bits[line[pair[dense]], doc[dense]] = True
    packed = np.packbits(bits, axis=1).reshape(-1)
    return {"size": _zip(size, "<u4"), "few": _zip(doc[~dense], "<u2"), "bits": _zip(packed, "u1")}


def read_bitmap(value: dict[str, bytes], n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and documents, sorted by pair, then document."""
    size = _unzip(value["size"], "<u4").astype(np.int64)
    as_bits = size * 16 > n_docs
    bits = _unzip(value["bits"], "u1").reshape(int(as_bits.sum()), -(-n_docs // 8))
    line, doc = np.nonzero(np.unpackbits(bits, axis=1, count=n_docs)) if len(bits) else (np.empty(0, int), np.empty(0, int))
    pair = np.repeat(np.arange(len(size)), size)
    out = np.empty(len(pair), np.int64)
    dense = as_bits[pair]
    out[dense], out[~dense] = doc, _unzip(value["few"], "<u2")
    return pair, out


def planes_of(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, n_pairs: int, n_docs: int) -> list[dict[str, bytes]]:
    """Plane k: the documents where a pair's number of links has bit k."""
    planes = []
    for k in range(int(times.max(initial=1)).bit_length()):
        on = (times >> k & 1).astype(bool)
        planes.append(write_bitmap(pair[on], doc[on], n_pairs, n_docs))
    return planes


def merged(planes: list[dict[str, bytes]], n_pairs: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of documents of each pair (the planes OR-merged and counted) and of links (counted by weight)."""
    links, held = np.zeros(n_pairs, np.int64), np.empty(0, np.int64)
    for k, plane in enumerate(planes):
        pair, doc = read_bitmap(plane, n_docs)
        links += np.bincount(pair, minlength=n_pairs) << k
        bits = pair * n_docs + doc
        held = distinct(np.concatenate([held, bits]))[0] if k else bits
    return np.bincount(held // n_docs, minlength=n_pairs), links


def _shard_hash(pairs: np.ndarray) -> np.ndarray:
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(2**64 - 1)


class _Block:
    """Documents and their distinct stretches, until there are enough for a block."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.names: dict[str, int] = {}
        self.at: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, stretches: list[str]) -> None:
        names = self.names
        self.ids.append(doc_id)
        self.at.append(np.array([names.setdefault(s, len(names)) for s in stretches], np.int64))
        self.size += len(stretches)

    def rows(self, block: int, both: Pieces, known: dict, most_known: int) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one for the block's pairs and bitmaps."""
        names, n_docs = list(self.names), len(self.ids)
        at = np.concatenate(self.at)
        doc = np.repeat(np.arange(n_docs), [len(x) for x in self.at])
        ids = _encoded(names, np.bincount(at, minlength=len(names)), both, known, most_known)
        # a document with a stretch whose bytes do not come back has no tokens
        broken = np.fromiter((x is None for x in ids), bool, len(ids))
        whole = np.bincount(doc, weights=broken[at], minlength=n_docs) == 0
        ids = [x or (b"", b"") for x in ids]
        place = np.cumsum(~broken) - 1
        found = aligned([x for x, b in zip(ids, broken.tolist(), strict=True) if not b], both)
        at, doc = place[at[whole[doc]]], doc[whole[doc]]
        sizes = np.bincount(doc, minlength=n_docs)
        ends = np.cumsum(sizes)
        sums = []
        for values in (found.n_a, found.n_b, found.n_groups, found.n_links):
            total = np.concatenate([[0], np.cumsum(values[at])])
            sums.append(total[ends] - total[ends - sizes])
        for start in range(0, n_docs, 500):
            some = slice(start, min(start + 500, n_docs))
            texts = [
                b"".join(map(found.groups.__getitem__, at[e - n : e].tolist()))[:-1].decode()
                for e, n in zip(ends[some].tolist(), sizes[some].tolist(), strict=True)
            ]
            n = len(texts)
            none = [[None] * n] * 6
            columns = [self.ids[some], *(x[some] for x in sums), texts]
            yield from rows_of(ROW_ARROW, [[block] * n, list(range(start, start + n)), *columns, *none])
        if len(at):
            yield from self._pairs(block, found, at, doc, n_docs)

    @staticmethod
    def _pairs(block: int, found: Aligned, at: np.ndarray, doc: np.ndarray, n_docs: int) -> Iterator[pa.RecordBatch]:
        pairs, number = distinct(found.links)
        order = np.argsort(_shard_hash(pairs), kind="stable")  # shards are ranges of the hash
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        pairs, number = pairs[order], place[number]
        starts = np.cumsum(found.n_links) - found.n_links
        key = np.sort(at * n_docs + doc)  # how often a document holds a stretch
        first = np.flatnonzero(np.diff(key, prepend=-1))
        seen = np.diff(first, append=len(key))
        at, doc = np.divmod(key[first], n_docs)
        wide = found.n_links[at]
        inner = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        key = number[np.repeat(starts[at], wide) + inner] * n_docs + np.repeat(doc, wide)
        by_key = np.argsort(key)
        key, seen = key[by_key], np.repeat(seen, wide)[by_key]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        pair, doc = np.divmod(key[first], n_docs)
        planes = planes_of(pair, doc, np.add.reduceat(seen, first), len(pairs), n_docs)
        n_held, n_links = merged(planes, len(pairs), n_docs)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, PLANE_ARROW) as writer:
            writer.write_table(pa.Table.from_pylist(planes, PLANE_ARROW))
        values = [_zip(pairs, "<i8"), _zip(n_held, "<u4"), _zip(n_links, "<i8"), sink.getvalue().to_pybytes()]
        yield from rows_of(ROW_ARROW, [[block], *([[None]] * 7), [len(pairs)], [n_docs], *([v] for v in values)])


def _encoded(names: list[str], seen: np.ndarray, both: Pieces, known: dict, most_known: int) -> list:
    """Ids of each stretch; those that come more than once in a block are remembered for the next."""
    out = [known.get(s, 0) for s in names]
    new = [i for i, x in enumerate(out) if x == 0]
    for start in range(0, len(new), 20_000):
        part = new[start : start + 20_000]
        for i, ids in zip(part, both.encode([names[i] for i in part]), strict=True):
            out[i] = ids
    often = [i for i in new if seen[i] > 1]
    if len(known) + len(often) > most_known:
        known.clear()  # memory stays bounded; these are encoded again
    known.update((names[i], out[i]) for i in often[:most_known])
    return out


def blocks(
    batches: Iterable[pa.RecordBatch], path_a: str, path_b: str, most_held: int, most_known: int
) -> Iterator[pa.RecordBatch]:
    both, known = pieces(path_a, path_b), _known.setdefault((path_a, path_b), {})
    number, held = TaskContext.get().partitionId() << 32, _Block()
    for batch in small(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.add(doc_id, both.stretches(" " + text) if text and "▁" not in text else [])
            if held.size >= most_held or len(held.ids) >= 1 << 16:
                yield from held.rows(number, both, known, most_known)
                number, held = number + 1, _Block()
    if held.ids:
        yield from held.rows(number, both, known, most_known)


def entries(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """A block's pairs with their counts, cut by shard."""
    shift = np.uint64(64 - shards.bit_length() + 1)
    for batch in batches:
        for row in batch.to_pylist():
            pairs = _unzip(row["pairs"], "<i8")
            docs, links = _unzip(row["n_docs"], "<u4"), _unzip(row["n_links_of"], "<i8")
            shard = (_shard_hash(pairs) >> shift).astype(np.int64) if shards > 1 else np.zeros(len(pairs), np.int64)
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(pairs)], strict=True))
            columns = [[_zip(c[a:b], k) for a, b in cuts] for c, k in ((pairs, "<i8"), (docs, "<u4"), (links, "<u4" if links.max() < 1 << 32 else "<i8"))]
            yield from rows_of(ENTRY_ARROW, [shard[starts].tolist(), [row["block"]] * len(cuts), starts.tolist(), *columns])


def _all(table: pa.Table, name: str, kind: str) -> np.ndarray:
    parts = [_unzip(v, kind) for v in table.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _links(table: pa.Table) -> np.ndarray:
    """Counts of links, written in four bytes where they fit."""
    out = []
    for pairs, value in zip(table.column("pairs").to_pylist(), table.column("n_links_of").to_pylist(), strict=True):
        n = len(_unzip(pairs, "<i8"))
        wide = len(_unzip(value, "u1")) == 8 * n
        out.append(_unzip(value, "<i8" if wide else "<u4").astype(np.int64))
    return np.concatenate(out)


def count(key: tuple, table: pa.Table) -> pa.Table:
    """Documents and links of each pair of one shard, over all blocks."""
    pairs, at = distinct(_all(table, "pairs", "<i8"))
    docs, links = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    np.add.at(docs, at, _all(table, "n_docs", "<u4"))
    np.add.at(links, at, _links(table))
    b = (pairs & 0xFFFFFFFF).astype(np.int32)
    return pa.table([np.full(len(pairs), key[0].as_py()), pairs, b, docs, links], schema=PAIR_ARROW)


def answer(_key: tuple, asked: pa.Table, counted: pa.Table) -> pa.Table:
    """For each block the counts of its pairs in one shard, and whether they are the highest of their B id."""
    pairs = counted.column("pair").to_numpy()
    order = np.argsort(pairs)
    pairs, links = pairs[order], counted.column("links").to_numpy()[order]
    best = counted.column("best").to_numpy(zero_copy_only=False)[order]
    out = [[], [], [], []]
    for row in asked.select(["block", "start", "pairs"]).to_pylist():
        wanted = _unzip(row["pairs"], "<i8")
        at = np.searchsorted(pairs, wanted)
        values = row["block"], np.array([row["start"], len(wanted)], "<i8").tobytes(), _zip(links[at], "<i8"), _zip(best[at], "u1")
        for column, value in zip(out, values, strict=True):
            column.append(value)
    return pa.Table.from_batches(list(rows_of(ANSWER_ARROW, out)), schema=ANSWER_ARROW)


def hand_back(_key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents in a block's bitmaps, with the counts of their pairs summed."""
    out = {n: [] for n in SCORED_ARROW.names}
    for row in block.to_pylist():
        links, best = np.zeros(row["n_pairs"], np.int64), np.zeros(row["n_pairs"], np.int64)
        for part in answers.to_pylist():
            start, n = np.frombuffer(part["at"], "<i8")
            links[start : start + n] = _unzip(part["links"], "<i8")
            best[start : start + n] = _unzip(part["best"], "u1")
        n_docs = row["n_held"]
        sums, bests = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        for k, plane in enumerate(pa.ipc.open_stream(row["planes"]).read_all().to_pylist()):
            pair, doc = read_bitmap(plane, n_docs)
            np.add.at(sums, doc, links[pair] << k)
            np.add.at(bests, doc, best[pair] << k)
        out["block"] += [row["block"]] * n_docs
        out["place"] += range(n_docs)
        out["n_best"] += bests.tolist()
        out["count_sum"] += sums.tolist()
    return pa.table(out, schema=SCORED_ARROW)


def _written(
    docs: DataFrame, path_a: str | None, path_b: str | None, most_held: int, most_known: int, groups: Column
) -> DataFrame:
    """Rows of documents and of blocks, in one table of the shared folder."""
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    cut = docs.select("doc_id", "text").mapInArrow(
        partial(blocks, path_a=path_a, path_b=path_b, most_held=most_held, most_known=most_known), ROW
    )
    return stage(cut.withColumn("groups", groups), "alignment")


def _counted(held: DataFrame, most_entries: int) -> tuple[DataFrame, DataFrame]:
    """Entries of blocks by shard, and the pairs with their counts."""
    n = held.agg(F.sum("n_pairs")).first()[0] or 0
    least = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << (max(least, -(-n // most_entries)) - 1).bit_length()
    keyed = (
        held.where(F.col("n_pairs").isNotNull())
        .select("block", "pairs", "n_docs", "n_links_of")
        .mapInArrow(partial(entries, shards=shards), ENTRY)
    )
    return keyed, stage(keyed.groupBy("shard").applyInArrow(count, PAIR), "alignment-pairs")


def pair_counts(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most_held: int = 1_500_000, most_known: int = 150_000,
    most_entries: int = 1_000_000,
) -> DataFrame:
    """a, b, docs, links: for each linked pair of ids the documents that hold it and its links in all."""
    held = _written(docs, path_a, path_b, most_held, most_known, F.lit(None).cast("string"))
    _, pairs = _counted(held, most_entries)
    return pairs.select(F.shiftright("pair", 32).cast("int").alias("a"), "b", "docs", "links")


def align(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    groups: Column | None = None,
    most_held: int = 1_500_000,
    most_known: int = 150_000,
    most_entries: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of ``docs(doc_id, text)``.

    ``groups`` is text, ids of A and B by group: ``a1,a2|b1;a3|b2,b3``; the parameter of that name
    says what of the column is kept (default: all of it). ``n_best`` are the links whose pair has
    the most links of all pairs with that B id, ``count_sum`` the links of the pair summed over
    the links. Texts that are null or empty, or whose tokens do not give their bytes back (B
    has no U+2581 of its own), have zeros and no groups; null and repeated ids each come out.
    Other columns are ignored, an empty table gives an empty result. ``most_held`` bounds the
    stretches of a block, ``most_known`` what a worker remembers, ``most_entries`` a shard on average.
    """
    held = _written(docs, path_a, path_b, most_held, most_known, F.col("groups") if groups is None else groups)
    keyed, pairs = _counted(held, most_entries)
    highest = pairs.groupBy("b").agg(F.max("links").alias("top"))
    ranked = pairs.join(highest, "b").select("shard", "pair", "links", (F.col("links") == F.col("top")).alias("best"))
    answers = keyed.groupBy("shard").cogroup(ranked.groupBy("shard")).applyInArrow(answer, ANSWER)
    rows = held.where(F.col("place").isNotNull()).select("block", *(c.split()[0] for c in DOC.split(", ")))
    bitmaps = held.where(F.col("n_pairs").isNotNull()).select("block", "n_pairs", "n_held", "planes")
    scored = bitmaps.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(hand_back, SCORED)
    none = F.lit(0).cast("long")
    return rows.join(scored, ["block", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups",
    )
