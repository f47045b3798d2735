"""Session helpers: runtime settings, reliable checkpoints, scratch folders in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "condmon", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings every operator relies on; all can be set on a live session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # A hot recording or set is split at join time even if that costs one more exchange.
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Other parts of the library set these lower for a session with long texts.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a temporary one only in local mode, where all tasks share this machine."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="condmon-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a table written between two jobs."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to a fresh table in shared storage and read it back.

    Cuts the lineage, survives lost executors, freezes row numbering, and gives later joins a
    measured size to choose their strategy by.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
