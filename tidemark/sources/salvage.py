"""Reading damaged files: what can be read comes out as lines, what cannot is in the file's status row.

The text reader drops the rest of a broken gzip file, and a file that is no gzip at all, without a
word. Here each file's bytes are cut into small chunks in the JVM and inflated one after another, so
a Python worker holds a few chunks and not a file; a gzip file cannot be split, so one task reads
it (the binary source takes files of up to 2 GB).
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.raw import RAW_GLOB, parse_lines, read_status

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 14
ROWS = 2_000  # lines handed on at a time
GZIP = 31  # window bits of a gzip member
SALVAGED = "source_file string, line string, file_bytes bigint, bytes_read bigint, bytes_lost bigint, damage string"


class _File:
    """One file on its way: inflates chunk by chunk and knows how far it came."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.read, self.next = path, size, 0, 0
        self.member = zlib.decompressobj(GZIP) if path.endswith(".gz") else None
        self.begun = self.members = 0  # bytes of the open member, members that ended
        self.damage: str | None = None
        self.rest = b""

    def text(self, data: bytes) -> bytes:
        if self.damage:
            return b""
        if self.member is None:
            self.read += len(data)
            return data
        out = []
        while data and not self.damage:
            before = self.member.copy()
            try:
                out.append(self.member.decompress(data))
            except zlib.error:
                self.member = before
                out.append(self._up_to_the_break(data))
                break
            taken = len(data) - len(self.member.unused_data)
            self.read, self.begun, data = self.read + taken, self.begun + taken, self.member.unused_data
            if self.member.eof:
                self.member, self.begun, self.members = zlib.decompressobj(GZIP), 0, self.members + 1
        return b"".join(out)

    def _up_to_the_break(self, data: bytes) -> bytes:
        out = []
        if not self.begun and not data.startswith(b"\x1f\x8b"):
            self.damage = "trailing" if self.members else "unreadable"
            return b""
        for i in range(len(data)):
            try:
                out.append(self.member.decompress(data[i : i + 1]))
            except zlib.error:
                break
            self.read += 1
        self.damage = "broken"
        return b"".join(out)

    def lines(self, data: bytes) -> list[str]:
        *whole, self.rest = (self.rest + self.text(data)).split(b"\n")
        return [w.decode("utf-8", "replace") for w in whole]

    def end(self) -> list[str]:
        if self.member is not None and not self.damage and self.begun:
            self.damage = "cut"
        return [self.rest.decode("utf-8", "replace")] if self.rest else []


def _frame(path: str, lines: list[str]) -> pd.DataFrame:
    nothing = pd.Series([None] * len(lines), dtype=object)
    return pd.DataFrame({"source_file": path, "line": lines} | {c: nothing for c in ("file_bytes", "bytes_read", "bytes_lost", "damage")})


def _inflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now: _File | None = None
    lines: list[str] = []

    def ended(file: _File) -> Iterator[pd.DataFrame]:
        rest = lines + file.end()
        if rest:
            yield _frame(file.path, rest)
        status = (file.path, None, file.size, file.read, file.size - file.read, file.damage)
        yield pd.DataFrame([status], columns=[f.split()[0] for f in SALVAGED.split(", ")], dtype=object)

    for batch in batches:
        for path, size, at, data in zip(batch["source_file"], batch["size"], batch["at"], batch["data"]):
            if at != at or at is None or int(at) == 0:  # a file begins; an empty one has no chunk
                if now is not None:
                    yield from ended(now)
                now, lines = _File(path, int(size)), []
            if data is None:
                continue
            if int(at) != now.next or path != now.path:
                raise ValueError(f"chunks of {path} are out of order")
            now.next += 1
            lines += now.lines(bytes(data))
            if len(lines) >= ROWS:
                yield _frame(now.path, lines)
                lines = []
    if now is not None:
        yield from ended(now)


def salvage(files: DataFrame) -> DataFrame:
    """Lines of files given as ``path`` and ``content``, and one status row a file (``line`` null).

    The status row says how many bytes the file has, how many were read and how many lost, and
    the ``damage``: null, ``cut`` (ends inside a gzip member), ``broken`` (does not inflate from there
    on, or its checksum is wrong: then lines before may be damaged too), ``trailing`` (something that is no gzip member follows the last one), ``unreadable``
    (no gzip at all). Readable bytes before the damage come out, the last line also when it is
    cut. Files whose path does not end with .gz are taken as text; bytes that are no UTF-8 become
    replacement characters. Files without content (null) or of no bytes have a status row only.
    """
    size = F.coalesce(F.length("content"), F.lit(0))
    at = F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))
    chunks = F.when(size > 0, F.transform(at, lambda i: F.substring(F.col("content"), i * CHUNK + 1, F.lit(CHUNK))))
    cut = files.select(F.col("path").alias("source_file"), size.cast("bigint").alias("size"), chunks.alias("chunks"))
    rows = cut.select("source_file", "size", F.posexplode_outer("chunks").alias("at", "data"))
    return rows.mapInPandas(_inflate, SALVAGED)


def salvaged_lines(spark: SparkSession, roots: Sequence[str], *, glob: str = RAW_GLOB) -> DataFrame:
    """:func:`salvage` over the files below the roots; the source lists no files of zero bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return salvage(reader.load(list(roots)).select("path", "content"))


def salvage_status(salvaged: DataFrame) -> DataFrame:
    """The read status of every file, damaged and unreadable ones too, with bytes and damage."""
    files = salvaged.where("line IS NULL").drop("line")
    lines = read_status(parse_lines(salvaged.where("line IS NOT NULL").select("source_file", "line")))
    counts = ["lines", "readable_rows", "corrupt_rows"]
    out = files.join(lines, "source_file", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})
    kept = (F.col("damage").isNotNull() | (F.col("corrupt_rows") > 0)) & (F.col("readable_rows") > 0)
    return out.withColumn("kept_readable_part", kept)
