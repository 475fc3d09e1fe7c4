"""Streams in and out: file feeds, append tables, queues, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import scalars as fn
from tidemark.session import workspace_dir
from tidemark.sources import bronze, raw


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files below a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def line_stream(spark: SparkSession, path: str, *, glob: str = raw.RAW_GLOB, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines of new raw files, ready for the same parsing as the batch read."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_file"))


def kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same lines from a topic (needs the Kafka connector on the class path)."""
    df = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return df.select(F.col("value").cast("string").alias("line"), F.col("topic").alias("source_file"))


def quote_updates(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Book snapshots and price changes of a line stream (stateless, as in batch)."""
    rows = bronze.typed(raw.records(raw.parse_lines(lines)))
    return bronze.order_books(rows), bronze.price_changes(rows)


def append_table(
    stream: DataFrame, path: str, checkpoint: str, *, partition_by: tuple[str, ...] = (), every: str | None = None
) -> StreamingQuery:
    """Append a stream to a Parquet table; one run over what is there unless ``every`` is set."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def append_queue(stream: DataFrame, path: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Append rows as JSON lines with the time they were written; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("queue_write_ts", F.current_timestamp()).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available into a table in the shared folder, and read it."""
    spark = stream.sparkSession
    path = workspace_dir(spark, name)
    append_table(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def feed_staleness(rows: DataFrame, *, source: str = "source", recv: str = "ts_recv") -> DataFrame:
    """Newest receive time per source; works on a table and (in update mode) on a stream."""
    return rows.groupBy(source).agg(F.max(recv).alias("last_recv"), F.count("*").alias("rows"))


def with_staleness(last: DataFrame, *, now, limit_seconds: float) -> DataFrame:
    age = fn.seconds_between(now, "last_recv")
    return last.withColumns({"age_seconds": age, "is_stale": age > limit_seconds})


def windowed_flow(trades: DataFrame, *, width: str, delay: str = "10 seconds", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Signed flow per event-time window; a window closes when the watermark passes its end."""
    buy = F.when(F.col("side") == "buy_aggressor", F.col("qty")).otherwise(0.0)
    sell = F.when(F.col("side") == "sell_aggressor", F.col("qty")).otherwise(0.0)
    return (
        trades.withWatermark("ts_event", delay)
        .groupBy(*keys, F.window("ts_event", width))
        .agg(F.sum(buy).alias("buy"), F.sum(sell).alias("sell"), F.count("*").alias("trades"))
        .select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "buy", "sell", "trades")
    )


def deduplicated(stream: DataFrame, *, ids: tuple[str, ...], ts: str, delay: str) -> DataFrame:
    """First row per id within the watermark: bounded state."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))
