"""Damaged files: the readable part comes out, and every file has a status row."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import salvage


def status(spark, folder):
    found = salvage.salvage_status(salvage.salvaged_lines(spark, [str(folder)])).collect()
    return {r["source_file"].rsplit("/", 1)[1]: r for r in found}


@pytest.fixture
def folder(tmp_path):
    rnd = random.Random(4)
    lines = [json.dumps({"i": i, "x": rnd.random(), "t": "é" * (i % 5)}, ensure_ascii=False) for i in range(9_000)]
    text = ("\n".join(lines) + "\n").encode()
    packed = gzip.compress(text)
    assert len(packed) > 5 * salvage.CHUNK
    hurt = bytearray(packed)
    middle = len(hurt) // 2
    hurt[middle : middle + 400] = b"\x00" * 400
    half = len(text) // 2
    files = {
        "whole.jsonl.gz": packed, "members.jsonl.gz": gzip.compress(text[:half]) + gzip.compress(text[half:]), "cut.jsonl.gz": packed[:middle],
        "hurt.jsonl.gz": bytes(hurt), "tail.jsonl.gz": packed + b"junk!", "rubbish.jsonl.gz": bytes(rnd.randrange(256) for _ in range(70_000)),
        "empty.jsonl": b"", "empty.jsonl.gz": b"", "plain.jsonl": text[:-1] + b"\n\xff\xfe{\n", "crc.jsonl.gz": packed[:-3], "other.txt": text,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, files, text


def test_status_of_every_file(spark, folder):
    path, files, text = folder
    got = status(spark, path)
    assert got.keys() == files.keys() - {"other.txt", "empty.jsonl", "empty.jsonl.gz"}  # the source lists no empty files
    damage = {n: r["damage"] for n, r in got.items()}
    assert damage == {
        "whole.jsonl.gz": None, "members.jsonl.gz": None, "cut.jsonl.gz": "cut", "hurt.jsonl.gz": "broken", "tail.jsonl.gz": "trailing",
        "rubbish.jsonl.gz": "unreadable", "plain.jsonl": None, "crc.jsonl.gz": "cut",
    }
    for n, r in got.items():
        assert r["file_bytes"] == len(files[n]) == r["bytes_read"] + r["bytes_lost"]
    assert got["tail.jsonl.gz"]["bytes_lost"] == 5 and got["rubbish.jsonl.gz"]["bytes_read"] == 0
    for n in ("whole.jsonl.gz", "members.jsonl.gz", "tail.jsonl.gz", "crc.jsonl.gz", "plain.jsonl"):
        assert got[n]["readable_rows"] == 9_000, n
    assert got["plain.jsonl"]["corrupt_rows"] == 1 and got["plain.jsonl"]["kept_readable_part"]
    assert not got["whole.jsonl.gz"]["kept_readable_part"] and got["cut.jsonl.gz"]["kept_readable_part"]
    assert got["rubbish.jsonl.gz"]["lines"] == 0
    assert 3_000 < got["hurt.jsonl.gz"]["readable_rows"] < 6_000
    # damaged bits may inflate to something else: then the member's checksum tells, at its end
    assert len(files["hurt.jsonl.gz"]) // 2 <= got["hurt.jsonl.gz"]["bytes_read"] < len(files["hurt.jsonl.gz"])


def test_lines_before_the_break_are_the_first_ones(spark, folder):
    path, _, text = folder
    all_lines = text.decode().split("\n")
    rows = salvage.salvaged_lines(spark, [str(path)]).where("line IS NOT NULL AND source_file LIKE '%/cut.jsonl.gz'").select("line").collect()
    got = [r["line"] for r in rows]
    assert len(got) > 3_000 and got[:-1] == all_lines[: len(got) - 1] and all_lines[len(got) - 1].startswith(got[-1].rstrip("\ufffd"))


def test_frames_without_files_and_without_content(spark):
    files = spark.createDataFrame([("a.gz", None), ("b", bytearray(b"{}")), ("c.gz", bytearray())], "path string, content binary")
    got = {r["source_file"]: (r["lines"], r["readable_rows"], r["damage"]) for r in salvage.salvage_status(salvage.salvage(files)).collect()}
    assert got == {"a.gz": (0, 0, None), "b": (1, 1, None), "c.gz": (0, 0, None)}
    assert salvage.salvage_status(salvage.salvage(files.where(F.lit(False)))).collect() == []
