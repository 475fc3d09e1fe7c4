"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan relies on. Timestamps are UTC; AQE re-plans joins,
# coalesces small shuffle partitions and splits skewed ones.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``master`` only for local runs and tests."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_roots: dict[str, str] = {}
_layers: dict[str, list[str]] = {}


def workspace_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present: a folder that only one machine sees is lost
    with that machine. Where a local master has none, all layers of the session go to one
    temporary folder, which is removed when the program ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
        root = _local_roots[app]
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _layers.setdefault(app, []).append(path)
    return path


def drop_layers(spark: SparkSession) -> int:
    """Delete every layer this program has staged in the session; frames that read them are void."""
    paths = _layers.pop(spark.sparkContext.applicationId, [])
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a layer to the shared folder and read it back.

    Ordered scans read their input twice, so a frame that is costly to build is
    written once at the layer boundary. The table also cuts the lineage: a lost
    executor costs a re-read, not a rebuild. ``drop_layers`` removes the layers.
    """
    path = workspace_dir(df.sparkSession, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
