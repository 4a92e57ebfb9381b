"""Streaming inputs: report lines from files, Kafka or a socket; API snapshots."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.lines import parse_reports, snapshot_reports

#: Rows of a table that a micro-batch takes, about, when the table is played back, and tasks that are enough for them.
BATCH_ROWS = 300_000
BATCH_TASKS = 30


def _lines(spark: SparkSession, format: str, options: dict) -> DataFrame:
    stream = spark.readStream.format(format).options(**options).load()
    return stream.select(F.col("value").cast("string").alias("value"))


def report_stream(spark: SparkSession, format: str = "text", coercion: str = "numeric", **options) -> DataFrame:
    """Newline-JSON reports; ``format`` text (a folder), kafka or, for trials, socket."""
    return parse_reports(_lines(spark, format, options), "value", coercion)


def snapshot_stream(spark: SparkSession, format: str = "text", **options) -> DataFrame:
    """API snapshots dropped into a folder or a topic, one per line."""
    return snapshot_reports(_lines(spark, format, options))


def table_stream(spark: SparkSession, folder: str, file_glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files there now."""
    reader = spark.read.option("pathGlobFilter", file_glob) if file_glob else spark.read
    stream = spark.readStream.schema(reader.parquet(folder).schema)
    if file_glob:
        stream = stream.option("pathGlobFilter", file_glob)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(folder)


def in_order(df: DataFrame, order: str) -> tuple[str, int | None]:
    """A folder with all rows of ``df`` as files in the order of a column of time, and how many of them make a micro-batch.

    One file can't be split among micro-batches, and a stateful stream holds what a batch holds; files of consecutive times let
    the watermark follow, so that state is of two batches. A stream takes files in the order of their times of change, which are
    set here, a second apart. A store that keeps no such times gets one batch of all (None): then nothing can come late.
    """
    spark, rows = df.sparkSession, df.count()
    path = scratch_path(spark, "in-order")
    df.repartitionByRange(max(1, -(-rows // BATCH_ROWS)), order).sortWithinPartitions(order).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    files.sort(key=lambda f: (int(f.getName().split("-")[1]), f.getName()))
    first = int(time.time()) - len(files)
    for i, f in enumerate(files):
        fs.setTimes(f, (first + i) * 1000, -1)
    kept = [fs.getFileStatus(f).getModificationTime() for f in files] == [(first + i) * 1000 for i in range(len(files))]
    return path, max(1, len(files) * BATCH_ROWS // max(1, rows)) if kept else None


def counted(df: DataFrame, name: str, **counters) -> tuple[DataFrame, Observation]:
    """Attach named counters (Columns) that fill while the job runs."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen
