"""Session settings that the engine is designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "docspark", **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and skew-join splitting; `conf` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Make checkpoint() usable: the folder in spark.checkpoint.dir; one of our own only where that is unset, on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="docspark-checkpoint-")
        context.setCheckpointDir(folder)
    return spark


def kept(rows: DataFrame) -> DataFrame:
    """Rows that are used several times, written once below the checkpoint folder: a lost executor costs nothing of what made them.

    Files and not checkpoint(): a checkpoint of a union, or of what adaptive execution has merged, claims another partitioning
    than it has, and later joins rely on it; files are also smaller.
    """
    folder = shared_folder(rows.sparkSession, "kept")
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, which driver and executors share."""
    return f"{with_checkpoints(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
