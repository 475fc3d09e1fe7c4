"""Reading and writing layer tables: partitions, drifting schemas, retention, run files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.pick import first_per_group
from tidemark.plans.gold import feature_columns


def scan_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A partitioned Parquet table; with a schema, a missing or empty one is an empty frame."""
    if schema is None:
        return spark.read.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The requested columns that exist; files may have different columns."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.select(*[c for c in columns if c in df.columns])


def in_date_range(df: DataFrame, *, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Inclusive filter on a date partition (pruned before reading)."""
    if start:
        df = df.where(F.col(date) >= start)
    if end:
        df = df.where(F.col(date) <= end)
    return df


def read_selected(table: DataFrame, markets: DataFrame) -> DataFrame:
    """Rows of the chosen (date, market_id) partitions: the dimension prunes the scan."""
    chosen = markets.select("date", "market_id").distinct()
    return table.join(chosen, ["date", "market_id"], "left_semi")


def first_events(events: DataFrame, *, n: int, date: str | None = None) -> DataFrame:
    """The first n distinct (market, time) of quote updates in order: the operator's own bound."""
    rows = events.where("ts_event IS NOT NULL AND (best_bid IS NOT NULL OR best_ask IS NOT NULL)")
    if date:
        rows = rows.where(F.col("date") == date)
    return (
        rows.select("market_id", F.col("ts_event").alias("sample_ts"))
        .distinct()
        .orderBy("market_id", "sample_ts")
        .limit(n)
    )


def write_partitioned(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace exactly the partitions present in ``df``; the others stay.

    The rebalance hint brings the rows of a partition together into few files, and
    lets the runtime split a partition that is too large for one task.
    """
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a fixed schema; an absent file is an empty frame."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path)


def union_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows with the union of all columns (missing ones null)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def union_widened(parts: Sequence[DataFrame]) -> DataFrame:
    """Like :func:`union_rows`, with numeric columns of different types widened to double."""
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for name, kind in part.dtypes:
            kinds.setdefault(name, set()).add(kind)
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    wide = {
        name: "double" if found <= numeric else "string" for name, found in kinds.items() if len(found) > 1
    }
    return union_rows(
        [
            p.withColumns({c: F.col(c).cast(t) for c, t in wide.items() if c in p.columns})
            for p in parts
        ]
    )


def with_flag_default(df: DataFrame, flag: str = "is_forced_signal") -> DataFrame:
    """The flag column, false where the file had none."""
    present = F.col(flag) if flag in df.columns else F.lit(None).cast("boolean")
    return df.withColumn(flag, F.coalesce(present, F.lit(False)))


def unprocessed(signals: DataFrame, processed: DataFrame, *, key: str = "signal_id") -> DataFrame:
    """Rows whose id has not been processed yet."""
    return signals.join(processed.select(key), key, "left_anti")


def missing_ids(wanted: DataFrame, present: DataFrame, *, key: str) -> DataFrame:
    """Distinct ids that are wanted and not present."""
    return wanted.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def newest_runs(diagnostics: DataFrame) -> DataFrame:
    """Newest run per mode and forced flag."""
    return diagnostics.groupBy("mode", "forced").agg(
        F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), F.max("created_at").alias("created_at")
    )


def combined_signals(
    queue: DataFrame, table: DataFrame, *, version: str, newer_than: Column
) -> DataFrame:
    """Signals of one model version from queue and table; the queue row wins per id."""
    both = union_rows([queue.withColumn("__src", F.lit(0)), table.withColumn("__src", F.lit(1))])
    recent = both.where((F.col("model_version") == version) & (F.col("sample_ts").isNull() | (F.col("sample_ts") >= newer_than)))
    return first_per_group(recent, keys=["signal_id"], order=["__src", "sample_ts"]).drop("__src")


def within_retention(df: DataFrame, *, days: int, today: str | Column, date: str = "date") -> DataFrame:
    """Partitions young enough to be kept."""
    day = F.lit(today).cast("date") if isinstance(today, str) else today
    return df.where(F.to_date(date) >= F.date_sub(day, days))


def feature_lists(df: DataFrame, *, labels: Sequence[str], exclude: Sequence[str] = ()) -> Mapping[str, list[str]]:
    """Feature and label names of a table, from its schema."""
    skip = {*labels, *exclude}
    return {
        "features": [c for c in feature_columns(df.columns) if c not in skip],
        "labels": [c for c in df.columns if c in labels],
    }


def write_feature_lists(df: DataFrame, path: str, *, labels: Sequence[str], exclude: Sequence[str] = ()) -> None:
    """The lists as one small JSON file next to the table."""
    text = json.dumps(feature_lists(df, labels=labels, exclude=exclude))
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def event_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """Chosen columns as one JSON text."""
    return F.to_json(F.struct(*columns))


def levels_json(levels: str | Column, first: int = 10) -> Column:
    """The first levels of a book as JSON text; null without a book."""
    return F.to_json(F.slice(F.col(levels) if isinstance(levels, str) else levels, 1, first))


def feature_lookup(samples: DataFrame, features: DataFrame, *, keys: Sequence[str], columns: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Features of exactly the same key (market and time); of several rows the last by ``tie``."""
    last = features.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*tie)).alias("__f"))
    return samples.join(last, list(keys), "left").select(*samples.columns, "__f.*")
