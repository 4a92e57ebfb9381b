"""Grid shards, event tables and their status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import task_count

CEILING_FT = 18000


def shard_rows(reports: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Reports with their date and one-degree cell.  A numeric altitude above 18000 ft
    is dropped, a missing one kept; a missing position is dropped."""
    rows = reports.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    rows = rows.where(F.col("alt_baro").try_cast("double").isNull() | (F.col("alt_baro").try_cast("double") <= CEILING_FT))
    rows = rows.withColumn("date", F.date_format(F.timestamp_seconds("now"), "yyyyMMdd"))
    rows = rows.withColumn("cell_lat", F.floor("lat").cast("int")).withColumn("cell_lon", F.floor("lon").cast("int"))
    if box is not None:
        la0, la1, lo0, lo1 = box
        rows = rows.where((F.col("cell_lat") >= la0) & (F.col("cell_lat") < la1) & (F.col("cell_lon") >= lo0) & (F.col("cell_lon") < lo1))
    return rows


def write_shards(reports: DataFrame, path: str, box: tuple[int, int, int, int] | None = None, mode: str = "overwrite") -> None:
    """Write shards by date and cell.

    Rows are placed by cell and hour, so a cell with most of the traffic is
    written by many tasks as several files.
    """
    rows = shard_rows(reports, box)
    hour = F.floor(F.col("now") / 3600)
    rows.repartition(task_count(reports), "date", "cell_lat", "cell_lon", hour).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy("date", "cell_lat", "cell_lon").parquet(path)


def write_events(events: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Event Parquet by date and cell; the CSV copy has no track columns."""
    rows = events.withColumn("date", F.regexp_replace(F.substring("datetime_utc", 1, 10), "-", "")).withColumn(
        "cell_lat", F.floor("lat").cast("int")).withColumn("cell_lon", F.floor("lon").cast("int"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "cell_lat", "cell_lon").parquet(path)
    if csv_path:
        events.drop("track1", "track2").write.mode("overwrite").option("header", "true").csv(csv_path)


def cell_status(processed: DataFrame, events: DataFrame) -> DataFrame:
    """State per processed (date, cell): 'ok' with events, else 'empty'."""
    keys = ["date", "cell_lat", "cell_lon"]
    found = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    out = processed.select(*keys).distinct().join(found, keys, "left")
    return out.select(*keys, F.when(F.col("events") > 0, "ok").otherwise("empty").alias("state"), F.coalesce("events", F.lit(0).cast("bigint")).alias("events"))


def missing_cells(wanted: DataFrame, status: DataFrame) -> DataFrame:
    """Cells still to process: neither 'ok' nor 'empty'."""
    done = status.where(F.col("state").isin("ok", "empty")).select("date", "cell_lat", "cell_lon").distinct()
    return wanted.join(done, ["date", "cell_lat", "cell_lon"], "left_anti")


def regional_table(events: DataFrame, path: str) -> None:
    """Deduplicated events in time order (a range shuffle, no single-task sort)."""
    from ..operators.los import deduplicate

    deduplicate(events).orderBy("timestamp").write.mode("overwrite").parquet(path)
