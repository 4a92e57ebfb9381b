"""Per-aircraft trace files: gzipped JSON with a positional point array."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all trace files below ``path``; unreadable ones are skipped.

    The files are gzip without the suffix, so they are read as bytes and inflated
    per batch; a truncated file yields what could be inflated.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        .option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path).select("path", "content"))

    def inflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [_text(b) for b in pdf["content"]]})

    return files.mapInPandas(inflate, "path string, text string").where(F.col("text").isNotNull())


def _text(data: bytes) -> str | None:
    if data[:2] != b"\x1f\x8b":
        return data.decode("utf-8", "replace")
    try:
        return gzip.decompress(data).decode("utf-8", "replace")
    except (EOFError, OSError, zlib.error):
        try:
            return zlib.decompressobj(wbits=31).decompress(data).decode("utf-8", "replace")
        except zlib.error:
            return None


def parse_traces(files: DataFrame, text: str = "text", file_id: str = "path") -> DataFrame:
    """One report per trace point.

    Times and speeds truncate to whole numbers; an altitude that is no number
    becomes "0"; squawk, emergency, category, climb rate and speed come from the
    point's attributes.  A file without a registration takes the first callsign
    seen so far, which then holds for its later points.
    """
    head = F.from_json(text, "icao string, r string, timestamp double, trace array<string>", {"mode": "PERMISSIVE"})
    rows = files.withColumn("_h", head).where(F.col("_h.icao").isNotNull() & F.col("_h.timestamp").isNotNull())
    cells = lambda p: F.from_json(F.concat(F.lit('{"p":'), p, F.lit("}")), "p array<string>")["p"]
    callsign = lambda a: F.coalesce(F.trim(F.get_json_object(F.get(a, F.lit(8)), "$.flight")), F.lit(""))
    rows = rows.select(file_id, F.col("_h.icao").alias("hex"), F.col("_h.r").alias("_r"), F.col("_h.timestamp").cast("bigint").alias("_t0"),
                       F.transform("_h.trace", cells).alias("_pts"))
    named = F.filter(F.transform("_pts", lambda a, i: F.struct(i.alias("at"), callsign(a).alias("name"))), lambda s: s["name"] != "")
    rows = rows.withColumn("_first", F.get(named, F.lit(0)))
    rows = rows.select("*", F.posexplode("_pts").alias("point_no", "_a")).where(F.size("_a") >= 9)
    at = lambda i: F.get("_a", F.lit(i))
    attr = lambda k: F.get_json_object(at(8), f"$.{k}")
    registered = F.when(F.coalesce("_r", F.lit("")) != "", F.col("_r"))
    return rows.select(
        file_id, "point_no", "hex", F.coalesce(registered, F.when(F.col("point_no") >= F.col("_first.at"), F.col("_first.name"))).alias("tail"),
        (F.col("_t0") + at(0).try_cast("double").cast("bigint")).cast("double").alias("now"),
        at(1).try_cast("double").alias("lat"), at(2).try_cast("double").alias("lon"),
        F.when(at(3).try_cast("double").isNull(), "0").otherwise(at(3)).alias("alt_baro"), F.coalesce(at(3) == "ground", F.lit(False)).alias("on_ground"),
        F.coalesce(at(4).try_cast("double").cast("bigint"), F.lit(0).cast("bigint")).alias("gscp"), at(5).try_cast("double").alias("track"),
        attr("squawk").alias("squawk"), attr("emergency").alias("emergency"), attr("category").alias("category"),
        attr("baro_rate").try_cast("bigint").alias("baro_rate"), attr("gs").try_cast("double").alias("gs"), at(8).alias("attributes"))


def scan_traces(spark: SparkSession, path: str) -> DataFrame:
    return parse_traces(read_files(spark, path))
