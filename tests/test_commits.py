"""Committed batches: a batch that dies or runs twice is there once; the manifest counts what readers see."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import commits, sources

SCHEMA = "id long, day string, `odd name` string, rows long"


def source(spark, folder):
    return sources.file_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def put(spark, folder, ids):
    rows = [(i, f"2024-01-0{i % 3 + 1}", None if i % 2 else "x", i) for i in ids]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_a_batch_that_died_is_there_once(spark, tmp_path, monkeypatch):
    f = str(tmp_path)
    put(spark, f, range(10))
    put(spark, f, range(10, 30))
    stream = source(spark, f)
    real, seen = commits.commit_batch, []

    def dies_in_the_second(session, schema, batch_id, *rest):
        if batch_id == 1 and not seen:
            seen.append(batch_id)
            raise RuntimeError("lost")
        real(session, schema, batch_id, *rest)

    monkeypatch.setattr(commits, "commit_batch", dies_in_the_second)
    run = lambda: commits.append_committed(stream, f"{f}/t", f"{f}/cp", partition_by=["day"]).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run()
    read = lambda: commits.read_committed(spark, f"{f}/t", stream.schema, ["day"])
    first = read().count()
    assert first in (10, 20)
    run()  # the batch again, from the checkpoint
    got = read()
    assert sorted(r["id"] for r in got.collect()) == list(range(30)) and got.columns == stream.columns
    on_disk = spark.read.schema(commits._data_schema(stream.schema)).option("basePath", f"{f}/t/data").parquet(f"{f}/t/data")
    assert on_disk.count() > 30  # the dead attempt's rows are there, and nobody reads them
    listed = commits.manifest(spark, f"{f}/t", stream.schema, ["day"])
    assert {r["day"]: r["n"] for r in listed.groupBy("day").agg(F.sum("rows").alias("n")).collect()} == {f"2024-01-0{d}": 10 for d in (1, 2, 3)}
    assert listed.agg(F.min("files")).first()[0] >= 1 and listed.select(commits.BATCH).distinct().count() == 2
    plan = read().where("day = '2024-01-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "2024-01-02" in plan
    assert read().where("day = '2024-01-02'").count() == 10


def test_nothing_committed_and_clashing_names(spark, tmp_path):
    f = str(tmp_path)
    put(spark, f, [])
    stream = source(spark, f)
    assert commits.read_committed(spark, f"{f}/t", stream.schema).collect() == []
    commits.append_committed(stream, f"{f}/t", f"{f}/cp").awaitTermination()
    assert commits.read_committed(spark, f"{f}/t", stream.schema).collect() == []
    assert commits.manifest(spark, f"{f}/t", stream.schema).collect() == []
    with pytest.raises(ValueError, match="own"):
        commits.append_committed(stream.withColumn("__batch", F.lit(1)), f"{f}/t", f"{f}/cp2")
