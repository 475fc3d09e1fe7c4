"""Chat formatting over a prefix tree of conversations.

Conversations that share their first turns share the nodes of those turns. A node is named by
a hash chained over the turns up to it. Trees are emitted depth first: the text of a node once,
with the position its tokens have in their own conversation and the intervals of its
ancestors, which are all that it may attend to besides itself. Tokens are code points of the
formatted text.

A tree larger than ``budget`` code points is cut into parts by its second turns (and where one
second turn alone is larger, by whole conversations), so that a first turn that a third of
all conversations share is many tasks; each part repeats the turns above the cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import rows_of
from tidemark.session import stage

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


# ------------------------------------------------------------------------- the template


def escape(text: str) -> str:
    """No control string is left: '<|' becomes '<\\|', and each that was escaped once more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, text = part[len(START) :].split("\n", 1)
        turns.append((unescape_role(role), unescape(text)))
    return turns


# ------------------------------------------------------------- conversations and their names

CHAINED = "conv_id long, leaf binary, path array<binary>, roles array<string>, texts array<string>, chars long"
CHAINED_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("leaf", pa.binary()),
        ("path", pa.list_(pa.binary())),
        ("roles", pa.list_(pa.string())),
        ("texts", pa.list_(pa.string())),
        ("chars", pa.int64()),
    ]
)


def _name(above: bytes, role: str, text: str) -> bytes:
    part = role.encode()
    return hashlib.blake2b(above + len(part).to_bytes(8, "big") + part + text.encode(), digest_size=16).digest()


def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from turns that arrive in order."""
    rows: list[tuple] = []
    current, roles, said, path, chars = object(), [], [], [], 0

    def close() -> None:
        if path:
            rows.append((current, path[-1], path, roles, said, chars))

    size = 0
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if conv_id != current:
                close()
                current, roles, said, path, chars = conv_id, [], [], [], 0
                if size > 4_000_000:
                    yield from rows_of(CHAINED_ARROW, list(zip(*rows, strict=True)))
                    rows, size = [], 0
            role, text = role or "", text or ""
            path.append(_name(path[-1] if path else b"", role, text))
            roles.append(role)
            said.append(text)
            chars += len(format_turn(role, text))
            size += len(role) + len(text) + 64
    close()
    if rows:
        yield from rows_of(CHAINED_ARROW, list(zip(*rows, strict=True)))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, leaf, path, roles, texts, chars: one row a conversation, staged.

    Turns stand in order of ``turn`` (null last), then role and text, so repeated rows and
    ties have one order; null roles and texts count as empty; rows without conv_id form one
    conversation.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
        .repartition(parts, "conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
    )
    return stage(ordered.mapInArrow(chained, CHAINED), "chat-conversations")


# ------------------------------------------------------------------------- trees

_INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct(
    [
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("position", pa.int64()),
        ("loss_start", pa.int64()),
        ("loss_end", pa.int64()),
        ("attends", pa.list_(_INTERVAL)),
    ]
)
_LEAF = pa.struct([("leaf", pa.binary()), ("node", pa.int64())])
TREES_ARROW = pa.schema(
    [
        ("root", pa.binary()),
        ("part", pa.int64()),
        ("text", pa.string()),
        ("nodes", pa.list_(_NODE)),
        ("leaves", pa.list_(_LEAF)),
    ]
)
_INTERVALS = "array<struct<start: bigint, end: bigint>>"
TREES = (
    "root binary, part long, text string, nodes array<struct<start: bigint, end: bigint, position: bigint, "
    f"loss_start: bigint, loss_end: bigint, attends: {_INTERVALS}>>, leaves array<struct<leaf: binary, node: bigint>>"
)


class Tree:
    """A depth-first emission; conversations must arrive in order of their paths."""

    def __init__(self, root: bytes, part: int) -> None:
        self.root, self.part = root, part
        self.texts: list[str] = []
        self.length = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.stack: list[tuple[bytes, int]] = []  # name and number of the nodes above

    def add(self, leaf: bytes, path: list[bytes], roles: list[str], texts: list[str]) -> None:
        shared = 0
        while shared < min(len(self.stack), len(path)) and self.stack[shared][0] == path[shared]:
            shared += 1
        del self.stack[shared:]
        for name, role, text in zip(path[shared:], roles[shared:], texts[shared:], strict=True):
            self._emit(name, role, text)
        self.leaves.append({"leaf": leaf, "node": self.stack[-1][1]})

    def _emit(self, name: bytes, role: str, text: str) -> None:
        turn = format_turn(role, text)
        attends, position = [], 0
        if self.stack:
            above = self.nodes[self.stack[-1][1]]
            attends, position = list(above["attends"]), above["position"] + above["end"] - above["start"]
            if attends and attends[-1]["end"] == above["start"]:  # a chain without branches is one interval
                attends[-1] = {"start": attends[-1]["start"], "end": above["end"]}
            else:
                attends.append({"start": above["start"], "end": above["end"]})
        end = self.length + len(turn)
        loss = (end - len(END) - len(escape(text)), end - len(END)) if role == LOSS_ROLE else (end, end)
        self.nodes.append(
            {
                "start": self.length,
                "end": end,
                "position": position,
                "loss_start": loss[0],
                "loss_end": loss[1],
                "attends": attends,
            }
        )
        self.stack.append((name, len(self.nodes) - 1))
        self.texts.append(turn)
        self.length = end

    def row(self) -> tuple:
        return self.root, self.part, "".join(self.texts), self.nodes, self.leaves


def emitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tree parts from conversations sorted by root, part and path."""
    tree, rows, size = None, [], 0
    for batch in batches:
        names = ("root", "part", "leaf", "path", "roles", "texts")
        for root, part, leaf, path, roles, texts in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if tree is None or (tree.root, tree.part) != (root, part):
                if tree:
                    rows.append(tree.row())
                    size += tree.length
                if size > 4_000_000:
                    yield from rows_of(TREES_ARROW, list(zip(*rows, strict=True)))
                    rows, size = [], 0
                tree = Tree(root, part)
            tree.add(leaf, path, roles, texts)
    if tree:
        rows.append(tree.row())
    if rows:
        yield from rows_of(TREES_ARROW, list(zip(*rows, strict=True)))


def trees(talks: DataFrame, budget: int = 1 << 20) -> DataFrame:
    """Tree parts of conversations: root, part, text, nodes, leaves.

    A node has its interval in ``text``, the position of its first token, the interval under
    the loss mask (empty unless the assistant speaks) and the intervals it attends to. A leaf
    names a conversation (several, where they are equal) and its last node.
    """
    one_each = talks.drop("conv_id").dropDuplicates(["leaf"]).withColumns(
        {"root": F.col("path")[0], "second": F.try_element_at("path", F.lit(2))}
    )
    by_second = one_each.groupBy("root", "second").agg(F.sum("chars").alias("second_chars"))
    by_root = by_second.groupBy("root").agg(F.sum("second_chars").alias("root_chars"))
    sizes = by_second.join(by_root, "root").select(
        F.col("root").alias("s_root"), F.col("second").alias("s_second"), "second_chars", "root_chars"
    )
    many = F.ceil(F.col("root_chars") / budget)
    part = (
        F.when(F.col("root_chars") <= budget, F.lit(0))
        .when(F.col("second_chars") <= budget, F.pmod(F.xxhash64("second"), many))
        .otherwise(F.pmod(F.xxhash64("second", "leaf"), many))
    )
    dealt = one_each.join(
        sizes, (F.col("root") == F.col("s_root")) & F.col("second").eqNullSafe(F.col("s_second"))
    ).select("root", part.cast("long").alias("part"), "leaf", "path", "roles", "texts")
    parts = int(talks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "root", "part").sortWithinPartitions("root", "part", "path")
    return ordered.mapInArrow(emitted, TREES)


# ------------------------------------------------------------------------- reading back

READ = "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
READ_ARROW = pa.schema(
    [
        ("leaf", pa.binary()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation as its last node sees it: the ancestors' intervals and its own."""
    for batch in batches:
        for text, nodes, leaves in zip(*(batch.column(n).to_pylist() for n in ("text", "nodes", "leaves")), strict=True):
            loss = [(n["loss_start"], n["loss_end"]) for n in nodes if n["loss_start"] < n["loss_end"]]
            rows = []
            for leaf in leaves:
                node = nodes[leaf["node"]]
                seen = [(i["start"], i["end"]) for i in node["attends"]] + [(node["start"], node["end"])]
                formatted = "".join(text[a:b] for a, b in seen)
                turns, learnt = hashlib.sha256(), hashlib.sha256()
                n_turns = chars = 0
                for role, said in parse(formatted):
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for a, b in loss if len(leaves) == 1 else [x for x in loss if any(s <= x[0] < e for s, e in seen)]:
                    said = unescape(text[a:b])
                    learnt.update(said.encode())
                    chars += len(said)
                rows.append((leaf["leaf"], n_turns, turns.hexdigest(), chars, learnt.hexdigest(), len(formatted)))
            yield from rows_of(READ_ARROW, list(zip(*rows, strict=True)))


def format_conversations(turns: DataFrame, budget: int = 1 << 20) -> DataFrame:
    """Tree parts of ``turns(conv_id, turn, role, text)``; see ``conversations`` and ``trees``.

    An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    return trees(conversations(turns), budget)


def digests(turns: DataFrame, budget: int = 1 << 20) -> DataFrame:
    """Per conversation what is read back from its tree part."""
    talks = conversations(turns)
    read = trees(talks.select("conv_id", "leaf", "path", "roles", "texts", "chars"), budget).mapInArrow(read_back, READ)
    return talks.select("conv_id", "leaf").join(read, "leaf").drop("leaf")
