"""Scans and sinks, fed with text and files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, los, sequence
from ..session import scratch_path
from ..sinks import exports
from ..sinks import tables as sink
from ..sources import dimensions as dims
from ..sources import lines as src
from ..sources import traces
from . import tables as t
from .q_sequence import DECIMATED
from .registry import query

P = t.POSITIONS_SQL

# --- sources ------------------------------------------------------------------


def _json_lines(spark, sf):
    """Wire records: every 7th altitude is text, every 50th line is cut off."""
    p = t.positions(spark, sf)
    alt = F.when(F.col("seq") % 7 == 0, "ground").otherwise(F.col("alt_baro").cast("string"))
    body = F.to_json(F.struct("now", "hex", F.col("tail").alias("r"), "flight", "lat", "lon", "gs", "track", "squawk", "emergency", "category", "baro_rate"))
    line = F.concat(F.expr("substring(_b, 1, length(_b) - 1)"), F.lit(',"alt_baro":'), F.when(F.col("seq") % 7 == 0, F.concat(F.lit('"'), alt, F.lit('"'))).otherwise(alt), F.lit("}"))
    p = p.withColumn("_b", body).withColumn("value", line)
    return p.select("seq", F.when(F.col("seq") % 50 == 49, F.expr("substring(value, 1, 40)")).otherwise(F.col("value")).alias("value"))


@query("S1_jsonl_reports", f"WITH {P} SELECT seq, now, hex, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN seq % 7 = 0 THEN 0 ELSE alt_baro END AS alt_baro, gs, squawk, emergency, seq % 7 = 0 AS on_ground FROM positions WHERE seq % 50 <> 49")
def jsonl_reports(spark, sf):
    path = scratch_path(spark, "jsonl")
    rows = _json_lines(spark, sf)
    rows.withColumn("bucket", F.floor(F.col("seq") / 100000)).select("value", "bucket").write.partitionBy("bucket").option("compression", "gzip").text(path)
    out = src.scan_reports(spark, path)
    return out.withColumn("seq", (F.col("now") - t.EPOCH0).cast("bigint")).select(
        "seq", "now", "hex", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt_baro", "gs", "squawk", "emergency", "on_ground")


@query("S11_corrupt_lines", f"WITH {P} SELECT count(*) AS good, count(*) FILTER (WHERE seq % 7 = 0) AS ground FROM positions WHERE seq % 50 <> 49")
def corrupt_lines(spark, sf):
    out = src.parse_reports(_json_lines(spark, sf).select("value"))
    return out.agg(F.count(F.lit(1)).alias("good"), F.count_if("on_ground").alias("ground"))


@query("S2_trace_points", f"""WITH {P} SELECT hex, now, round(lat, 5) AS lat, CASE WHEN seq % 7 = 0 THEN '0' ELSE CAST(alt_baro AS VARCHAR) END AS alt_baro, CAST(gs AS BIGINT) AS gscp,
  first_value(CASE WHEN seq % 9 = 0 THEN flight END IGNORE NULLS) OVER (PARTITION BY hex, CAST(now AS BIGINT) // 600 ORDER BY now, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tail, squawk FROM positions""")
def trace_points(spark, sf):
    p = t.positions(spark, sf).withColumn("file", F.floor(F.col("now") / 600))
    attrs = F.to_json(F.struct(F.when(F.col("seq") % 9 == 0, F.col("flight")).alias("flight"), "squawk"))
    alt = F.when(F.col("seq") % 7 == 0, F.lit('"ground"')).otherwise(F.col("alt_baro").cast("string"))
    point = F.concat(F.lit("["), F.concat_ws(",", (F.col("now") - F.col("file") * 600).cast("string"), F.round("lat", 5).cast("string"), F.round("lon", 5).cast("string"), alt,
                                             F.col("gs").cast("string"), F.col("track").cast("string"), F.lit("null"), F.lit("null"), attrs), F.lit("]"))
    # a file holds ten minutes of one aircraft
    files = p.groupBy("hex", "file").agg(F.sort_array(F.collect_list(F.struct("now", "seq", point.alias("p")))).alias("pts"))
    text = F.concat(F.lit('{"icao":"'), "hex", F.lit('","timestamp":'), (F.col("file") * 600).cast("string"), F.lit('.25,"trace":['), F.array_join(F.transform("pts", lambda x: x["p"]), ","), F.lit("]}"))
    out = traces.parse_traces(files.select(F.concat_ws("/", "hex", F.col("file").cast("string")).alias("path"), text.alias("text")))
    return out.select("hex", "now", F.round("lat", 5).alias("lat"), "alt_baro", "gscp", "tail", "squawk")


@query("S4_api_snapshots", f"WITH {P} SELECT hex, CAST(CAST(now AS BIGINT) // 5 * 5 AS DOUBLE) AS now, alt_baro FROM positions")
def api_snapshots(spark, sf):
    p = t.positions(spark, sf).withColumn("at", F.floor(F.col("now") / 5) * 5)
    snaps = p.groupBy("at").agg(F.collect_list(F.struct("hex", "lat", "lon", "alt_baro", "gs", "track")).alias("ac"))
    out = src.snapshot_reports(snaps.select(F.to_json(F.struct((F.col("at") * 1000).alias("now"), "ac")).alias("value")))
    return out.select("hex", "now", "alt_baro")


@query("S5_region_placemarks", f"""WITH {t.AIRPORTS_SQL} SELECT CAST(ordinal AS INTEGER) AS idx, lower(name) AS name, CAST(ordinal * 100 AS BIGINT) AS min_alt, CAST(5000 + ordinal AS BIGINT) AS max_alt, CAST(ordinal * 10 AS DOUBLE) AS hdg0, CAST(360 - ordinal AS DOUBLE) AS hdg1, 4 AS points,
  round(lon + 0.01, 6) AS x1, round(lat + 0.02, 6) AS y2 FROM airports""")
def region_placemarks(spark, sf):
    a = t.airports(spark, sf)
    xy = lambda dx, dy: F.concat(F.round(F.col("lon") + dx, 6).cast("string"), F.lit(","), F.round(F.col("lat") + dy, 6).cast("string"), F.lit(",0"))
    name = F.format_string("%s: %d-%d  %d-%d", "name", F.col("ordinal") * 100, 5000 + F.col("ordinal"), F.col("ordinal") * 10, 360 - F.col("ordinal"))
    text = F.concat_ws("\n\t", F.lit(""), xy(0, 0), xy(0.01, 0), xy(0.01, 0.02), xy(0, 0), F.lit(""))
    polygon = F.struct(F.struct(F.struct(text.alias("coordinates")).alias("LinearRing")).alias("outerBoundaryIs"))
    marks = a.select(F.col("ordinal").alias("idx"), name.alias("name"), polygon.alias("Polygon"))
    out = dims.parse_regions(marks, "fields.kml")
    return out.select("idx", "name", "min_alt", "max_alt", "hdg0", "hdg1", F.size("ring").alias("points"),
                      F.round(F.col("ring")[1]["x"], 6).alias("x1"), F.round(F.col("ring")[2]["y"], 6).alias("y2"))


@query("S6_us_airports", f"WITH {t.AIRPORTS_SQL} SELECT ident, type, elev FROM airports WHERE type <> 'heliport' AND iso_country = 'US'")
def us_airports(spark, sf):
    return dims.us_airports(t.airports(spark, sf)).select("ident", "type", "elev")


@query("S7_metar_csv", f"WITH {t.METAR_SQL} SELECT event_id, date_trunc('minute', valid) AS valid, nullif(vsby, 'M') AS vsby, skyc1, nullif(skyl1, 'M') AS skyl1 FROM metar")
def metar_csv(spark, sf):
    path = scratch_path(spark, "metar")
    m = t.metar(spark, sf)
    m.select("event_id", F.date_format("valid", "yyyy-MM-dd HH:mm").alias("valid"), "vsby", "skyc1", "skyl1").write.option("header", "true").csv(path)
    out = dims.scan_metar(spark, path)
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("valid").cast("timestamp_ntz").alias("valid"), "vsby", "skyc1", "skyl1")


@query("S8_airport_list", """SELECT event_id AS seq, code, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 12 + 0.5 AS DOUBLE) END AS radius_nm FROM (
  SELECT event_id, 'K' || chr(CAST(65 + user_id % 26 AS INTEGER)) || (user_id % 10) AS code FROM events WHERE event_id % 5 NOT IN (3, 4))""")
def airport_list(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    code = F.concat(F.lit("K"), F.char(65 + u % 26), (u % 10).cast("string"))
    line = F.when(e % 5 == 3, F.concat(F.lit("# "), code)).when(e % 5 == 4, F.lit("   ")).when(
        e % 3 == 0, F.concat(F.lit(" "), code, F.lit("  "), (e % 12).cast("string"), F.lit(".5 extra"))).otherwise(code)
    return src.airport_list(t.table(spark, sf, "events").select(e.alias("seq"), line.alias("value")))


@query("S10_date_selection", "SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-21' AND isodow(ts) >= 6")
def date_selection(spark, sf):
    e = t.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    return dims.select_dates(e, "2024-01-05", "2024-01-21", "weekend").select("event_id")


@query("S12_event_lines", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'high' ELSE 'low' END AS quality, CAST(event_id % 90 AS VARCHAR) AS lat, CASE WHEN event_id % 4 = 1 THEN 'x' ELSE '' END AS latdist FROM events WHERE event_id % 3 <> 0")
def event_lines(spark, sf):
    e = F.col("event_id")
    head = F.concat(F.lit("INFO x "), F.lit(src.EVENT_MARKER + " "), F.concat_ws(",", e.cast("string"), F.lit("d"), F.lit("a"), (e % 90).cast("string"), F.lit("-121"), F.lit("900"), F.lit("N1"), F.lit("N2"),
                    F.when(e % 4 == 0, "high").otherwise("low"), F.lit("link")))
    full = F.concat(head, F.lit(",an,interp,audio,type,phase,why,x,1"))
    line = F.when(e % 3 == 0, F.concat(F.lit("# total_events = "), e.cast("string"))).when(e % 4 == 1, full).otherwise(head)
    out = src.event_lines(t.table(spark, sf, "events").select("event_id", line.alias("line")))
    return out.select("event_id", "quality", "lat", "latdist")


@query("S12_header_values", "SELECT 'total_events' AS name, CAST(event_id AS VARCHAR) AS value FROM events WHERE event_id % 3 = 0")
def header_values(spark, sf):
    e = F.col("event_id")
    line = F.when(e % 3 == 0, F.concat(F.lit("# total_events = "), e.cast("string"))).otherwise("plain text")
    return src.header_values(t.table(spark, sf, "events").select(line.alias("line")))


@query("S13_request_log", "SELECT event_id, 'K' || (user_id % 90) AS airport FROM events WHERE event_id % 6 <> 5")
def request_log(spark, sf):
    e = F.col("event_id")
    good = F.to_json(F.struct(F.concat(F.lit("K"), (F.col("user_id") % 90).cast("string")).alias("airport"), F.col("ts").cast("string").alias("timestamp")))
    out = src.request_log(t.table(spark, sf, "events").select("event_id", F.when(e % 6 == 5, '{"airport": "K').otherwise(good).alias("value")))
    return out.select("event_id", "airport")


# --- event-shaped rows from the positions view ----------------------------------

EV = f"""{P}, ev AS (SELECT seq AS event_id, now AS timestamp, strftime(make_timestamp(CAST(now AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS datetime_utc, lat + a % 3 AS lat, lon - a % 4 AS lon, alt_baro AS alt_ft, tail AS flight1, flight AS flight2,
  value / 1000 AS lateral_nm, CAST(seq % 400 AS DOUBLE) AS alt_sep_ft, CASE event_type WHEN 'click' THEN 'low' WHEN 'view' THEN 'medium' WHEN 'purchase' THEN 'high' ELSE 'vhigh' END AS quality FROM positions)"""


def _ev(spark, sf):
    k = F.col("event_type")
    from ..functions.labels import altitude_label

    return t.positions(spark, sf).select(
        F.col("seq").alias("event_id"), F.col("now").alias("timestamp"), F.date_format(F.timestamp_seconds("now"), "yyyy-MM-dd'T'HH:mm:ss").alias("datetime_utc"), (F.col("lat") + F.col("a") % 3).alias("lat"), (F.col("lon") - F.col("a") % 4).alias("lon"),
        F.col("alt_baro").alias("alt_ft"), altitude_label("alt_baro").alias("alt_band"), F.col("tail").alias("flight1"), F.col("flight").alias("flight2"), (F.col("value") / 1000).alias("lateral_nm"),
        (F.col("seq") % 400).cast("double").alias("alt_sep_ft"), F.lit(10.0).alias("duration_s"),
        F.when(k == "click", "low").when(k == "view", "medium").when(k == "purchase", "high").otherwise("vhigh").alias("quality"), F.lit("brief").alias("quality_explanation"))


@query("S9_event_scan_pruned", f"WITH {EV} SELECT event_id, quality FROM ev WHERE floor(lat) = 36 AND floor(lon) = -122")
def event_scan(spark, sf):
    path = scratch_path(spark, "event-table")
    sink.write_events(_ev(spark, sf), path)
    return dims.scan_events(spark, path, (36, 37, -122, -121), F.col("date").isNotNull()).select("event_id", "quality")


@query("K8_grid_shards", f"WITH {P} SELECT CAST(floor(lat + a % 3) AS INTEGER) AS cell_lat, CAST(floor(lon - a % 4) AS INTEGER) AS cell_lon, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM positions WHERE NOT (seq % 23 = 0) GROUP BY 1, 2")
def grid_shards(spark, sf):
    path = scratch_path(spark, "shards")
    p = t.positions(spark, sf).select("seq", "now", "hex", (F.col("lat") + F.col("a") % 3).alias("lat"), (F.col("lon") - F.col("a") % 4).alias("lon"), F.when(F.col("seq") % 23 == 0, "18500").when(F.col("seq") % 29 == 0, "ground").otherwise(F.col("alt_baro").cast("string")).alias("alt_baro"))
    sink.write_shards(p, path)
    return spark.read.parquet(path).groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query("K9_cell_status", f"""WITH {EV}, done AS (SELECT DISTINCT 'd' || (event_id % 30) AS date, event_id % 7 AS cell_lat, event_id % 11 AS cell_lon FROM ev),
  hit AS (SELECT 'd' || (event_id % 30) AS date, event_id % 7 AS cell_lat, event_id % 11 AS cell_lon, count(*) AS events FROM ev WHERE quality = 'high' AND alt_sep_ft < 100 GROUP BY 1, 2, 3)
  SELECT d.*, CASE WHEN events > 0 THEN 'ok' ELSE 'empty' END AS state, coalesce(events, 0) AS events FROM done d LEFT JOIN hit USING (date, cell_lat, cell_lon)""")
def cell_status(spark, sf):
    e = F.col("event_id")
    rows = _ev(spark, sf).withColumn("date", F.concat(F.lit("d"), (e % 30).cast("string"))).withColumn("cell_lat", e % 7).withColumn("cell_lon", e % 11)
    return sink.cell_status(rows, rows.where("quality = 'high' AND alt_sep_ft < 100"))


@query("K10_regional_table", f"WITH {EV} SELECT flight1, flight2, CAST(floor(timestamp / 600) AS DOUBLE) AS timestamp, min(event_id) AS event_id FROM ev GROUP BY 1, 2, 3")
def regional_table(spark, sf):
    path = scratch_path(spark, "regional")
    rows = _ev(spark, sf).select("event_id", "flight1", "flight2", F.floor(F.col("timestamp") / 600).cast("double").alias("timestamp"))
    sink.regional_table(rows, path)
    return spark.read.parquet(path).select("flight1", "flight2", "timestamp", "event_id")


@query("K11_geojson_features", f"""WITH {EV} SELECT event_id, 'Feature' AS type, 'Point' AS geometry, round(lon, 6) AS lon, round(lat, 6) AS lat, quality, CASE quality WHEN 'low' THEN 'rgba(0,200,0,0.7)' WHEN 'medium' THEN 'rgba(255,255,0,0.78)' WHEN 'high' THEN 'rgba(255,140,0,0.85)' ELSE 'rgba(255,0,255,0.85)' END AS color,
  event_id + 1 AS number FROM ev""")
def geojson_features(spark, sf):
    lines = exports.geojson(_ev(spark, sf))
    g = lambda p: F.get_json_object("line", p)
    return lines.select(
        "event_id", g("$.type").alias("type"), g("$.geometry.type").alias("geometry"), F.round(g("$.geometry.coordinates[0]").cast("double"), 6).alias("lon"),
        F.round(g("$.geometry.coordinates[1]").cast("double"), 6).alias("lat"), g("$.properties.quality").alias("quality"), g("$.properties.color").alias("color"),
        g("$.properties.number").cast("long").alias("number"))


@query("K13_search_rows", f"WITH {EV} SELECT CAST(event_id AS VARCHAR) AS event_id, flight1, flight2, round(lon, 4) AS lon, round(lat, 4) AS lat, quality, datetime_utc, round_even(lateral_nm, 3) AS lateral_nm, alt_sep_ft, 'brief' AS quality_explanation FROM ev")
def search_rows(spark, sf):
    out = exports.search_rows(_ev(spark, sf))
    return out.withColumn("lon", F.round("lon", 4)).withColumn("lat", F.round("lat", 4))


@query("K14_track_export", f"""WITH {t.STEPS_SQL} SELECT flight_id, count(*) AS points, min(CAST(now AS BIGINT)) AS first_sec FROM steps GROUP BY 1""")
def track_export(spark, sf):
    steps = sequence.flight_steps(t.positions(spark, sf))
    parts = exports.track_export(steps.select("flight_id", F.col("now").cast("bigint").alias("sec"), "lat", "lon", "alt_baro"))
    n = F.size(F.from_json("line", "array<array<double>>"))
    return parts.groupBy("flight_id").agg(F.sum(n).alias("points")).join(
        steps.groupBy("flight_id").agg(F.min(F.col("now").cast("bigint")).alias("first_sec")), "flight_id")


@query("K14_decimated_export", DECIMATED + " SELECT flight_id, count(*) AS points, min(sec) AS first_sec FROM walk WHERE kept OR i = n GROUP BY 1")
def decimated_export(spark, sf):
    rows = sequence.resample(sequence.staged_steps(sequence.flight_steps(sequence.prefilter(t.positions(spark, sf)))))
    kept = folds.decimate(rows.select("flight_id", "sec", "lat", "lon", "alt_baro", F.round("track", 6).alias("track")), ["flight_id"])
    parts = exports.track_export(kept)
    n = F.size(F.from_json("line", "array<array<double>>"))
    return parts.groupBy("flight_id").agg(F.sum(n).alias("points"), F.min("first_sec").alias("first_sec"))


@query("K7_event_upsert", f"WITH {EV}, first AS (SELECT 'id' || (event_id % 997) AS los_id, event_id AS v, quality FROM ev WHERE event_id % 2 = 0), second AS (SELECT 'id' || (event_id % 499) AS los_id, event_id AS v, quality FROM ev WHERE event_id % 2 = 1), "
       "a AS (SELECT los_id, max(v) AS v, arg_max(quality, v) AS quality FROM first GROUP BY 1), b AS (SELECT los_id, max(v) AS v, arg_max(quality, v) AS quality FROM second GROUP BY 1) "
       "SELECT * FROM b UNION ALL SELECT * FROM a WHERE los_id NOT IN (SELECT los_id FROM b)")
def event_upsert(spark, sf):
    from ..sinks.commit_log import scratch_keyed

    e = F.col("event_id")
    rows = _ev(spark, sf)
    table = scratch_keyed(spark, "los", ["los_id"], 16)
    part = lambda odd, m: rows.where(e % 2 == odd).select(F.concat(F.lit("id"), (e % m).cast("string")).alias("los_id"), e.alias("v"), "quality")
    table.merge(part(0, 997), newest="v")
    table.merge(part(1, 499), newest="v")
    return table.read()


@query("T11_incremental_cells", f"""WITH {EV}, s AS (SELECT 'd' || (event_id % 30) AS date, event_id % 7 AS cell_lat, event_id % 11 AS cell_lon, max(CASE WHEN quality = 'high' THEN 1 ELSE 0 END) AS ok FROM ev WHERE event_id % 5 < 2 AND (event_id % 7 + event_id % 11) % 2 = 0 GROUP BY 1, 2, 3),
  w AS (SELECT DISTINCT 'd' || (event_id % 30) AS date, event_id % 7 AS cell_lat, event_id % 11 AS cell_lon FROM ev) SELECT w.* FROM w LEFT JOIN s USING (date, cell_lat, cell_lon) WHERE coalesce(ok, 0) = 0""")
def incremental_cells(spark, sf):
    e = F.col("event_id")
    rows = _ev(spark, sf).withColumn("date", F.concat(F.lit("d"), (e % 30).cast("string"))).withColumn("cell_lat", e % 7).withColumn("cell_lon", e % 11)
    keys = ["date", "cell_lat", "cell_lon"]
    status = rows.where("event_id % 5 < 2 AND (event_id % 7 + event_id % 11) % 2 = 0").groupBy(*keys).agg(F.max(F.when(F.col("quality") == "high", "ok").otherwise("bad")).alias("state"))
    return sink.missing_cells(rows.select(*keys).distinct(), status)


@query("D12_duplicate_events", f"WITH {EV} SELECT flight1, flight2, quality, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def event_counts(spark, sf):
    return los.deduplicate(_ev(spark, sf)).groupBy("flight1", "flight2", "quality").agg(F.count(F.lit(1)).alias("n"))
