"""Line-oriented inputs: reports, event lines, airport lists, request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.idents import icao_to_tail
from ..schema import REPORT

EVENT_MARKER = "CSV OUTPUT FOR POSTPROCESSING:"
EVENT_FIELDS = ["timestamp", "datestr", "altdatestr", "lat", "lon", "altitude", "tail1", "tail2", "quality", "link", "animation", "interp", "audio",
                "type", "phase", "quality_explanation", "latdist", "altdist"]
EVENT_DEFAULTS = {"quality": "high"}


def parse_reports(lines: DataFrame, column: str = "value", coercion: str = "numeric") -> DataFrame:
    """JSON lines to typed reports with the raw line and the keys it has.

    Lines that are not JSON objects, and reports without ``alt_baro``, are dropped.
    ``coercion='strict'`` accepts lat, lon, gs and track only if written as decimal
    numbers and alt_baro only if written as an integer, and uses 0 otherwise;
    ``'numeric'`` takes any number.
    """
    raw = F.col(column)
    rows = lines.withColumn("raw", raw).withColumn("attrs", F.json_object_keys("raw"))
    rows = rows.where(F.col("attrs").isNotNull() & F.array_contains("attrs", "alt_baro"))
    rows = rows.withColumn("_j", F.from_json("raw", REPORT, {"mode": "PERMISSIVE"}))
    text = lambda k: F.get_json_object("raw", f"$.{k}")
    if coercion == "strict":
        v = F.try_parse_json("raw")
        kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        floating = lambda k: F.coalesce(kind(k).startswith("DECIMAL") | (kind(k) == "DOUBLE") | (kind(k) == "FLOAT"), F.lit(False))
        number = {k: F.when(floating(k), F.col(f"_j.{k}")).otherwise(0.0) for k in ("lat", "lon", "gs", "track")}
        alt = F.when(F.coalesce(kind("alt_baro") == "BIGINT", F.lit(False)), text("alt_baro").try_cast("bigint")).otherwise(0)
    else:
        number = {k: text(k).try_cast("double") for k in ("lat", "lon", "gs", "track")}
        alt = text("alt_baro").try_cast("bigint")
        number["gs"] = F.coalesce(number["gs"], F.lit(0.0))
    keep = [c for c in lines.columns if c != column]
    j = F.col("_j")
    return rows.select(
        *keep, text("now").try_cast("double").alias("now"), j["hex"].alias("hex"), tail_of(j["hex"], j["r"]).alias("tail"), F.trim(j["flight"]).alias("flight"),
        number["lat"].alias("lat"), number["lon"].alias("lon"), F.coalesce(alt, F.lit(0)).cast("bigint").alias("alt_baro"),
        number["gs"].alias("gs"), number["track"].alias("track"), j["squawk"].alias("squawk"), j["emergency"].alias("emergency"), j["category"].alias("category"),
        j["baro_rate"].alias("baro_rate"), j["dbFlags"].alias("db_flags"), (F.coalesce(text("alt_baro"), F.lit("")) == "ground").alias("on_ground"),
        *[F.array_contains("attrs", k).alias(f"has_{k}") for k in ("squawk", "emergency", "category")], "attrs", "raw")


def tail_of(hex_id: Column, registration: Column) -> Column:
    """Registration decoded from the address, else the one reported."""
    return F.coalesce(icao_to_tail(hex_id), registration)


def tracked(reports: DataFrame) -> DataFrame:
    """Reports the tracker follows: the callsign, then the address, stand in for a tail."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return reports.withColumn("tail", F.coalesce("tail", blank(F.col("flight")), blank(F.col("hex")))).where(F.col("tail").isNotNull())


def scan_reports(spark: SparkSession, paths, coercion: str = "numeric") -> DataFrame:
    """JSONL files (gzip by suffix), unreadable files skipped."""
    lines = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(paths)
    return parse_reports(lines, "value", coercion)


def snapshot_reports(snapshots: DataFrame, column: str = "value") -> DataFrame:
    """API snapshots ``{now: ms, ac: [...]}`` to one report line per aircraft, now in seconds."""
    snap = F.from_json(column, "now double, ac array<string>")
    keep = [c for c in snapshots.columns if c != column]
    rows = snapshots.select(*keep, snap.alias("s")).select(*keep, (F.col("s.now") / 1000).alias("_now"), F.explode("s.ac").alias("_ac"))
    line = F.concat(F.expr("substring(_ac, 1, length(_ac) - 1)"), F.lit(',"now":'), F.format_string("%.3f", F.col("_now")), F.lit("}"))
    return parse_reports(rows.select(*keep, line.alias(column)), column)


def event_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Marked lines split into positional fields; short rows get defaults, rows of
    fewer than ten fields are dropped."""
    body = F.trim(F.element_at(F.split(F.col(column), EVENT_MARKER), -1))
    rows = lines.where(F.col(column).contains(EVENT_MARKER)).withColumn("fields", F.split(body, ","))
    rows = rows.where(F.size("fields") >= 10)
    known = set(rows.columns)
    out = [F.coalesce(F.get("fields", F.lit(i)), F.lit(EVENT_DEFAULTS.get(n, ""))).alias(n) for i, n in enumerate(EVENT_FIELDS) if n not in known]
    return rows.select("*", *out)


def header_values(lines: DataFrame, column: str = "line") -> DataFrame:
    """``# name = value`` header lines as rows."""
    m = r"^# (\w+) = (.+)$"
    rows = lines.select(F.regexp_extract(column, m, 1).alias("name"), F.trim(F.regexp_extract(column, m, 2)).alias("value"))
    return rows.where(F.col("name") != "")


AIRPORT_LINE = r"^([A-Za-z0-9]{2,4})(?:\s+(\d+(?:\.\d+)?))?"


def airport_list(lines: DataFrame, column: str = "value", order: str = "seq", first: int | None = None) -> DataFrame:
    """Airport codes with an optional radius; comments and blank lines skipped."""
    text = F.trim(column)
    rows = lines.where((text != "") & ~text.startswith("#")).select(
        order, F.regexp_extract(text, AIRPORT_LINE, 1).alias("code"), F.regexp_extract(text, AIRPORT_LINE, 2).try_cast("double").alias("radius_nm"))
    rows = rows.where(F.col("code") != "")
    return rows.orderBy(order).limit(first) if first else rows


def request_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON request lines with an airport; malformed lines are skipped."""
    keep = [c for c in lines.columns if c != column]
    req = F.from_json(column, "airport string, timestamp string")
    return lines.select(*keep, req.alias("r")).where(F.col("r.airport").isNotNull()).select(*keep, "r.*")
