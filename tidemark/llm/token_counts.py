"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. Scan tasks cut texts into pre-tokens and keep, for a block of documents, the distinct
   pre-tokens and each document's frequencies over them (numbers only).
2. The distinct pre-tokens of all blocks meet by hash; each is counted once with the
   tokenizer, however many documents hold it.
3. The counts go back to their blocks, where frequency times count is summed per document.

What is shuffled is one entry per block and distinct pre-token, not one per document and
pre-token, so a word that every document holds costs one entry a block.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import few_rows_at_once, rows_of, small
from tidemark.session import stage

# Unicode White_Space, which is what the pre-tokenizer's \s stands for.
_BLANK = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# No pre-token crosses an edge between these units: the last space before a word belongs to
# the word, the blanks before that stand together, and so does a run of blanks at the end.
UNIT = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# One pre-token whatever stands around it; it goes straight to the library's BPE model.
PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
ENDS_WORD = re.compile("[0-9A-Za-z]$")

BLOCK = "block long, bucket int, names binary, at binary, docs binary, pairs binary, parts binary"
BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int32())] + [(n, pa.binary()) for n in ("names", "at", "docs", "pairs", "parts")]
)
COUNTED = "block long, at binary, n binary"
COUNTED_ARROW = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_tokens long"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """What byte-level vocabularies write for a space and for letters up to U+00FF."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: cut.pre_tokenize_str(chr(c))[0][0] for c in (0x20, *range(0x41, 0x100)) if chr(c).isalpha() or c == 0x20}


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers, each byte of them in a plane of its own, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zlib.compress(planes.tobytes(), 1)


def _unpacked(value: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(value), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


class Block:
    """Distinct units of some documents and each document's frequencies over them."""

    def __init__(self) -> None:
        self.units: dict[str, int] = {}
        self.docs: list[tuple[int | None, int, int]] = []  # id, bytes, special tokens
        self.sizes: list[int] = []
        self.at: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.pairs = 0

    def add(self, doc_id: int | None, text: str, special: re.Pattern | None) -> None:
        found: Counter = Counter()
        parts = special.split(text) if special else [text]
        for part in parts:
            found.update(UNIT.findall(part))
        units = self.units
        at = np.fromiter((units.setdefault(u, len(units)) for u in found), np.uint32, len(found))
        times = np.fromiter(found.values(), np.uint32, len(found))
        order = np.argsort(at, kind="stable")
        at, times = at[order], times[order]
        self.at.append(np.diff(at, prepend=np.uint32(0)))
        self.times.append(times)
        self.sizes.append(len(found))
        self.docs.append((doc_id, len(text.encode()), len(parts) - 1))
        self.pairs += len(found)

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """The pre-tokens, dealt into buckets by hash, then the block's numbers."""
        names: dict[str, int] = {}
        stem = np.empty(len(self.units), np.int64)
        tail = np.full(len(self.units), -1, np.int64)
        for i, unit in enumerate(self.units):
            # a word and the punctuation after it are two pre-tokens
            word = unit.rstrip(PUNCTUATION)
            if len(word) < len(unit) and ENDS_WORD.search(word):
                stem[i] = names.setdefault(word, len(names))
                tail[i] = names.setdefault(unit[len(word) :], len(names))
            else:
                stem[i] = names.setdefault(unit, len(names))
        held: dict[int, list] = {}
        for name, i in sorted(names.items()):
            held.setdefault(zlib.crc32(name.encode()) % buckets, []).append((name, i))
        packed = [
            (zlib.compress(_lengths_first([n for n, _ in part]), 1), _packed(np.array([i for _, i in part])))
            for part in held.values()
        ]
        none = [None] * len(held)
        yield from rows_of(
            BLOCK_ARROW,
            [[block] * len(held), list(held), [n for n, _ in packed], [a for _, a in packed], none, none, none],
        )
        ids, n_bytes, specials = zip(*self.docs, strict=True)
        docs = rows_of(
            pa.schema([(n, pa.int64()) for n in ("doc_id", "n_bytes", "specials", "size")]),
            [ids, n_bytes, specials, self.sizes],
            len(ids),
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, (table := next(docs)).schema) as writer:
            writer.write_batch(table)
        pairs = _packed(np.concatenate([*self.at, *self.times]))
        parts = _packed(np.concatenate([stem, tail + 1]))
        yield from rows_of(
            BLOCK_ARROW, [[block], [None], [None], [None], [sink.getvalue().to_pybytes()], [pairs], [parts]]
        )


def _lengths_first(names: list[str]) -> bytes:
    raw = [n.encode() for n in names]
    return np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw)


def _names(value: bytes) -> list[str]:
    raw = zlib.decompress(value)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 * (n + 1)
    return [raw[a:b].decode() for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def blocks(
    batches: Iterable[pa.RecordBatch], path: str, buckets: int, most_pairs: int
) -> Iterator[pa.RecordBatch]:
    added = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    number, held = TaskContext.get().partitionId() << 32, Block()
    for batch in small(batches):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for doc_id, text in zip(ids, texts, strict=True):
            held.add(doc_id, text or "", special)
            if held.pairs >= most_pairs:
                yield from held.rows(number, buckets)
                number, held = number + 1, Block()
    if held.docs:
        yield from held.rows(number, buckets)


def count_pieces(batches: Iterable[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    """For each pre-token its number of pieces; a task encodes each distinct one once."""
    model, known = tokenizer(path), {}
    bpe, letters = model.model, byte_letters()
    for batch in batches:
        for block, names, at in zip(*(batch.column(n).to_pylist() for n in ("block", "names", "at")), strict=True):
            names = _names(names)
            new = [n for n in names if n not in known]
            if len(known) + len(new) > most:  # memory stays bounded; these are counted again
                known, new = {}, names
            plain, other = [], []
            for name in new:
                (plain if PLAIN.fullmatch(name) else other).append(name)
            known.update((n, len(bpe.tokenize(n.translate(letters)))) for n in plain)
            for a in range(0, len(other), 10_000):
                part = other[a : a + 10_000]
                known.update(zip(part, map(len, model.encode_batch_fast(part, add_special_tokens=False)), strict=True))
            counts = np.fromiter(map(known.__getitem__, names), np.uint32, len(names))
            yield from rows_of(COUNTED_ARROW, [[block], [at], [_packed(counts)]])


def add_up(_key: tuple, block: pa.Table, counted: pa.Table) -> pa.Table:
    """Per document of one block: frequency times pieces, summed."""
    out = {n: [] for n in RESULT_ARROW.names}
    for row in block.to_pylist():
        stem, tail = np.split(_unpacked(row["parts"]), 2)
        pieces = np.zeros(max(int(stem.max(initial=-1)) + 1, int(tail.max(initial=0))) + 1, np.int64)
        for at, n in zip(counted.column("at").to_pylist(), counted.column("n").to_pylist(), strict=True):
            pieces[_unpacked(at) + 1] = _unpacked(n)
        per_unit = pieces[stem + 1] + pieces[tail]  # place 0 holds nothing
        steps, times = np.split(_unpacked(row["pairs"]), 2)
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        sizes = docs.column("size").to_numpy()
        ends = np.cumsum(sizes)
        run = np.cumsum(steps)  # steps restart at each document
        before = np.concatenate([[0], run])[ends - sizes]
        at = run - np.repeat(before, sizes)
        total = np.concatenate([[0], np.cumsum(per_unit[at] * times)])
        out["doc_id"] += docs.column("doc_id").to_pylist()
        out["n_bytes"] += docs.column("n_bytes").to_pylist()
        out["n_tokens"] += (total[ends] - total[ends - sizes] + docs.column("specials").to_numpy()).tolist()
    return pa.table(out, schema=RESULT_ARROW)


def token_counts(
    docs: DataFrame, path: str | None = None, most_pairs: int = 1_000_000, most_known: int = 2_000_000
) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs(doc_id, text)``.

    Counts equal those of the byte-level tokenizer file at ``path`` without added tokens;
    its special strings inside a text count as one token, as the library does by default.
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each come out. Other
    columns, whatever their names, are ignored; an empty table gives an empty result.
    ``most_pairs`` bounds a block, ``most_known`` what a counting task remembers.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = few_rows_at_once(docs).select("doc_id", "text").mapInArrow(
        partial(blocks, path=path, buckets=parts, most_pairs=most_pairs), BLOCK
    )
    held = stage(cut, "token-counts")
    counted = (
        held.where(F.col("bucket").isNotNull())
        .select("block", "bucket", "names", "at")
        .repartition(parts, "bucket")
        .mapInArrow(partial(count_pieces, path=path, most=most_known), COUNTED)
    )
    numbers = held.where(F.col("bucket").isNull()).select("block", "docs", "pairs", "parts")
    return numbers.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(add_up, RESULT)
