"""Export feeds: features, search rows, track lines and their byte index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.timeline import prefixed


def geojson(events: DataFrame, row_id: str = "event_id") -> DataFrame:
    """One GeoJSON feature line per event with a position; colours by quality."""
    rows = events.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    quality = F.lower(F.coalesce("quality", F.lit("")))
    props = F.struct(
        F.col(row_id).cast("string").alias("event_id"), "flight1", "flight2", quality.alias("quality"), "lateral_nm", "alt_sep_ft",
        F.col("alt_ft").cast("double").alias("alt_ft"), "alt_band", "datetime_utc", (F.col(row_id) + 1).alias("number"),
        F.coalesce("quality_explanation", F.lit("")).alias("why"),
        labels.event_color(quality).alias("color"), F.lit(labels.EVENT_RADIUS).alias("radius"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")))
    return rows.select(row_id, feature.alias("line"))


def track_lines(events: DataFrame, row_id: str = "event_id") -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return events.select(row_id, F.to_json(F.struct(text("track1"), text("track2"))).alias("line"))


def byte_index(lines: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Offset and length of each line in the file that holds them in ``row_id`` order.

    A prefix sum over even ranges of the lines, so no task sees all of them, whatever the ids.
    """
    sized = lines.withColumn("length_bytes", (F.octet_length("line") + 1).cast("bigint"))
    out = prefixed(sized, [row_id], {"offset_bytes": F.col("length_bytes")})
    return out.withColumn("offset_bytes", F.col("offset_bytes") - F.col("length_bytes"))


SEARCH_FIELDS = ["event_id", "flight1", "flight2", "lon", "lat", "quality", "datetime_utc", "lateral_nm", "alt_sep_ft", "quality_explanation"]


def search_rows(events: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Positional search fields, rounded half to even (5, 5, 3 and 0 places)."""
    return events.select(
        F.col(row_id).cast("string").alias("event_id"), F.trim("flight1").alias("flight1"), F.trim("flight2").alias("flight2"),
        F.bround("lon", 5).alias("lon"), F.bround("lat", 5).alias("lat"), F.lower("quality").alias("quality"), "datetime_utc",
        F.bround("lateral_nm", 3).alias("lateral_nm"), F.bround(F.col("alt_sep_ft").cast("double"), 0).alias("alt_sep_ft"),
        F.coalesce("quality_explanation", F.lit("")).alias("quality_explanation")).select(*SEARCH_FIELDS)


def track_export(kept: DataFrame, keys: Sequence[str] = ("flight_id",), time: str = "sec", part_s: float = 3600.0) -> DataFrame:
    """JSON point lists ``[[lat, lon, alt], ...]`` per flight, in parts of one hour.

    The parts of a flight concatenate to its track; an hour of one flight is at
    most 3600 rows, so no list grows with the length of a flight.
    """
    point = F.struct(F.col(time), F.array(F.col("lat"), F.col("lon"), F.col("alt_baro").cast("double")).alias("p"))
    parts = kept.groupBy(*keys, F.floor(F.col(time) / part_s).alias("part")).agg(F.sort_array(F.collect_list(point)).alias("pts"))
    return parts.select(*keys, "part", F.size("pts").alias("points"), F.col("pts")[0][time].alias(f"first_{time}"), F.to_json(F.transform("pts", lambda x: x["p"])).alias("line"))


def write_lines(lines: DataFrame, path: str, compression: str = "gzip", mode: str = "overwrite") -> None:
    lines.select("line").write.mode(mode).option("compression", compression).text(path)
