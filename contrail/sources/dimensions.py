"""Region files, airports, runways, weather, event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeline import numbered

AIRPORT_TYPES = ["small_airport", "medium_airport", "large_airport"]
REGION_NAME = r"^([^:]+):\s*(-?\d+)-(-?\d+)\s+(\d+)-(\d+)"


def scan_regions(spark: SparkSession, path: str, layer: int = 0) -> DataFrame:
    """Placemarks of one region file in document order; a name that does not parse is an error.

    A region file is small and read by one task, so the order of its rows is the
    order in the document.
    """
    schema = "name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    return parse_regions(raw.withColumn("idx", F.monotonically_increasing_id()), path.rsplit("/", 1)[-1], layer)


def parse_regions(placemarks: DataFrame, file: str, layer: int = 0) -> DataFrame:
    name = F.col("name")
    part = lambda i: F.regexp_extract(name, REGION_NAME, i)
    ok = F.when(part(1) == "", F.raise_error(F.concat(F.lit("region name does not parse: "), name))).otherwise(part(1))
    points = F.split(F.trim(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates"), F.lit(" \t\r\n")), r"\s+")
    ring = F.transform(points, lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))
    return placemarks.select(
        F.lit(layer).alias("layer"), F.lit(file).alias("file"), F.col("idx").cast("int").alias("idx"), F.lower(ok).alias("name"),
        part(2).cast("bigint").alias("min_alt"), part(3).cast("bigint").alias("max_alt"), part(4).cast("double").alias("hdg0"),
        part(5).cast("double").alias("hdg1"), ring.alias("ring"))


def as_layers(regions: DataFrame, limit: int = 10_000) -> list[list[dict]]:
    """Regions as the plain layers the rule compiler takes; the count is checked."""
    rows = regions.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} regions: give the table itself to Rules")
    layers: list[list[dict]] = [[] for _ in range(max((r["layer"] for r in rows), default=-1) + 1)]
    for r in sorted(rows, key=lambda r: (r["layer"], r["idx"])):
        layers[r["layer"]].append({**r.asDict(), "ring": [(p["x"], p["y"]) for p in r["ring"]]})
    return layers


def us_airports(rows: DataFrame) -> DataFrame:
    """Small, medium and large US airports with a real identifier; blank elevation is 0.

    Input: ident, type, name, lat, lon, elev, iso_country.
    """
    keep = F.col("type").isin(AIRPORT_TYPES) & (F.col("iso_country") == "US") & ~F.col("ident").startswith("US-")
    return rows.where(keep & F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("elev", F.coalesce("elev", F.lit(0.0)))


def scan_airports(spark: SparkSession, path: str) -> DataFrame:
    num = lambda c: F.col(c).try_cast("double")
    rows = spark.read.option("header", "true").option("escape", '"').csv(path)
    return us_airports(rows.select("ident", "type", "name", num("latitude_deg").alias("lat"), num("longitude_deg").alias("lon"), num("elevation_ft").alias("elev"), "iso_country"))


def scan_runways(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", "true").option("escape", '"').csv(path).withColumn("ordinal", F.monotonically_increasing_id())
    num = lambda c: F.col(c).try_cast("double")
    ends = [num(f"{e}_{src}").alias(f"{e}_{dst}") for e in ("le", "he") for src, dst in (
        ("latitude_deg", "lat"), ("longitude_deg", "lon"), ("heading_degT", "heading"), ("elevation_ft", "elev"))]
    return rows.select(F.upper("airport_ident").alias("ident"), "ordinal", num("length_ft").alias("length_ft"), num("width_ft").alias("width_ft"), "closed",
                       "le_ident", "he_ident", *ends)


def scan_metar(spark: SparkSession, path: str) -> DataFrame:
    """Observation CSV: 'M' is missing; rows without a time are dropped."""
    rows = spark.read.option("header", "true").option("nullValue", "M").csv(path)
    return rows.withColumn("valid", F.to_timestamp("valid", "yyyy-MM-dd HH:mm")).where(F.col("valid").isNotNull())


def scan_events(spark: SparkSession, root: str, box: Sequence[int] | None = None, dates: Column | None = None) -> DataFrame:
    """Event table partitioned by date and cell; box and dates prune partitions."""
    out = spark.read.option("mergeSchema", "true").option("ignoreMissingFiles", "true").parquet(root)
    if box is not None:
        la0, la1, lo0, lo1 = box
        out = out.where((F.col("cell_lat") >= la0) & (F.col("cell_lat") < la1) & (F.col("cell_lon") >= lo0) & (F.col("cell_lon") < lo1))
    return out if dates is None else out.where(dates)


def select_dates(df: DataFrame, start: str, stop: str, days: str = "all", column: str = "date") -> DataFrame:
    """Inclusive date range; ``days`` is all, weekday or weekend."""
    d = F.col(column).cast("date")
    out = df.where(d.between(F.lit(start).cast("date"), F.lit(stop).cast("date")))
    if days == "weekday":
        return out.where(F.weekday(d) < 5)
    if days == "weekend":
        return out.where(F.weekday(d) >= 5)
    return out


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Small text file with line numbers."""
    rows = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id().cast("double"))
    return numbered(rows, ["_id"], "seq").drop("_id")
