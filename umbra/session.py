"""Session builder with the settings the engine is written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "umbra", **conf: str) -> SparkSession:
    """UTC, adaptive execution and skew handling on; any setting can be overridden by keyword with _ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of our own only where none is set (tests,
    local mode)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="umbra-"))
        root = sc.getCheckpointDir()
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/umbra-{uuid.uuid4().hex}/{label}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def spread(df: DataFrame) -> DataFrame:
    """Shuffle a small scan over the cores; leave a large one alone.

    A Parquet file of one row group is one task's work however many cores there are. Input below a few MB a
    core is worth a shuffle; anything larger already comes in enough row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (8 << 20) else df
