"""Append sinks whose readers see committed batches only, and a manifest of what each batch wrote.

A batch is written below ``data/batch=<n>/attempt=<id>``, and then named in ``commits/batch=<n>`` with its
rows and files by partition. A batch that dies before that, or is run again, leaves files that no
reader takes: the commit names one attempt. The manifest of the table is the commits together.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH, ATTEMPT = "__batch", "__attempt"


def _manifest_schema(schema: T.StructType, partition_by: Sequence[str]) -> T.StructType:
    parts = [T.StructField(c, schema[c].dataType) for c in partition_by]
    counts = [T.StructField("rows", T.LongType()), T.StructField("files", T.LongType())]
    return T.StructType([T.StructField(BATCH, T.LongType()), T.StructField(ATTEMPT, T.StringType()), *parts, *counts])


def _data_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(ATTEMPT, T.StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_batch(batch: DataFrame, batch_id: int, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write the rows of a batch as a new attempt; nobody sees them before :func:`commit_batch`."""
    attempt = uuid.uuid4().hex
    folder = f"{path}/data/{BATCH}={batch_id}/{ATTEMPT}={attempt}"
    batch.write.mode("errorifexists").option("compression", "zstd").partitionBy(*partition_by).parquet(folder)
    return attempt


def commit_batch(spark: SparkSession, schema: T.StructType, batch_id: int, attempt: str, path: str, partition_by: Sequence[str] = ()) -> None:
    """Name the attempt that counts, with its rows and files; a batch without rows commits nothing."""
    folder = f"{path}/data/{BATCH}={batch_id}/{ATTEMPT}={attempt}"
    written = spark.read.schema(schema).parquet(folder).withColumn("__file", F.col("_metadata.file_path"))
    # rows of a file first: the files of a batch are counted, not its rows
    by_file = written.groupBy("__file", *partition_by).agg(F.count("*").alias("rows"))
    counted = by_file.groupBy(*partition_by).agg(F.sum("rows").alias("rows"), F.count("*").alias("files"))
    named = counted.where("rows > 0").select(F.lit(attempt).alias(ATTEMPT), *partition_by, "rows", "files")
    named.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{BATCH}={batch_id}")


def append_committed(
    stream: DataFrame, path: str, checkpoint: str, *, partition_by: Sequence[str] = (), every: str | None = None
) -> StreamingQuery:
    """Append a stream to a table of committed batches, each row once, whatever batch is run again."""
    schema = stream.schema
    if {BATCH, ATTEMPT} & set(stream.columns):
        raise ValueError(f"columns {BATCH} and {ATTEMPT} are the table's own")
    if {"rows", "files"} & set(partition_by):
        raise ValueError("rows and files are columns of the manifest, not names of a partition")

    def write(batch: DataFrame, batch_id: int) -> None:
        attempt = write_batch(batch, batch_id, path, partition_by)
        commit_batch(batch.sparkSession, schema, batch_id, attempt, path, partition_by)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def manifest(spark: SparkSession, path: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> DataFrame:
    """Rows and files of every committed batch and partition; empty where nothing was committed."""
    wanted = _manifest_schema(schema, partition_by)
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], wanted)
    return spark.read.schema(wanted).option("basePath", f"{path}/commits").parquet(f"{path}/commits")


def read_committed(spark: SparkSession, path: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows of committed batches.

    Batch and attempt are folders, so the join with the commits prunes them, as a filter on a
    partition column does; the files are not listed by name.
    """
    if not _exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema)
    data = spark.read.schema(_data_schema(schema)).option("basePath", f"{path}/data").parquet(f"{path}/data")
    named = manifest(spark, path, schema, partition_by).select(BATCH, ATTEMPT).distinct()
    return data.join(named, [BATCH, ATTEMPT], "left_semi").select(*[f"`{c}`" for c in schema.names])
