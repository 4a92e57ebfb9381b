"""Session defaults and the shared folder used for checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "contrail", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local-mode session without that setting gets a fresh temporary folder; a
    cluster session without it is an error, because a machine-local folder would
    not survive the loss of that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="contrail-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def task_count(df) -> int:
    """Partition count for stages whose cost is computation rather than bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df, rows: int) -> int:
    """Partition count at which a task gets about ``rows`` rows of ``df``, which is counted; at least ``task_count``."""
    return max(task_count(df), -(-df.count() // rows))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stage(df, name: str):
    """Write a DataFrame to the shared folder and read it back.

    Cuts the lineage, so later steps neither recompute it nor depend on the
    executors that produced it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
