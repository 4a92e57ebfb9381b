"""The driver tables and the views over them that the queries read.

There are no aircraft reports among the tables, so ``positions`` derives them
from ``events`` by integer arithmetic: 40 aircraft on triangle-wave paths, one
report a second.  Each view exists as a DataFrame and as the SQL of its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH0 = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


POSITIONS_SQL = f"""positions AS (
  SELECT event_id AS seq, CAST({EPOCH0} + event_id AS DOUBLE) AS now, a,
    'a' || lpad(CAST(a AS VARCHAR), 5, '0') AS hex, 'N' || CAST(100 + a AS VARCHAR) AS tail,
    'CS' || CAST(user_id % 50 AS VARCHAR) AS flight,
    CAST(36.5 AS DOUBLE) + (a % 5) * CAST(0.01 AS DOUBLE) + abs((event_id + a * 53) % 1200 - 600) * CAST(0.0005 AS DOUBLE) AS lat,
    CAST(-121.8 AS DOUBLE) + (a % 8) * CAST(0.004 AS DOUBLE) + abs((event_id + a * 29) % 900 - 450) * CAST(0.0004 AS DOUBLE) AS lon,
    1000 + (a % 8) * 100 + ((event_id // 300) % 5) * 50 AS alt_baro,
    CAST(80 + event_id % 60 AS DOUBLE) AS gs, CAST((event_id * 13) % 360 AS DOUBLE) AS track,
    CASE a % 3 WHEN 0 THEN 'A1' WHEN 1 THEN 'A3' ELSE 'A7' END AS category,
    CASE event_type WHEN 'error' THEN '7700' WHEN 'signup' THEN '7600' WHEN 'purchase' THEN '4512' ELSE '1200' END AS squawk,
    CASE event_type WHEN 'error' THEN 'general' WHEN 'view' THEN 'none' END AS emergency,
    CASE WHEN event_type <> 'click' THEN (event_id % 41 - 20) * 64 END AS baro_rate,
    CASE a % 10 WHEN 3 THEN 1 WHEN 4 THEN 0 END AS db_flags,
    event_id % 11 = 0 AS on_ground, event_type, user_id, ts, value
  FROM (SELECT *, user_id % 40 AS a FROM events))"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions_from(table(spark, sf_dir, "events"))


def positions_from(events: DataFrame) -> DataFrame:
    a, e = F.col("a"), F.col("event_id")
    kind = F.col("event_type")
    return events.withColumn("a", F.col("user_id") % 40).select(
        e.alias("seq"), (e + EPOCH0).cast("double").alias("now"), "a",
        F.concat(F.lit("a"), F.lpad(a.cast("string"), 5, "0")).alias("hex"),
        F.concat(F.lit("N"), (a + 100).cast("string")).alias("tail"),
        F.concat(F.lit("CS"), (F.col("user_id") % 50).cast("string")).alias("flight"),
        (F.lit(36.5) + (a % 5) * F.lit(0.01) + F.abs((e + a * 53) % 1200 - 600) * F.lit(0.0005)).alias("lat"),
        (F.lit(-121.8) + (a % 8) * F.lit(0.004) + F.abs((e + a * 29) % 900 - 450) * F.lit(0.0004)).alias("lon"),
        (1000 + (a % 8) * 100 + (F.floor(e / 300) % 5) * 50).alias("alt_baro"),
        (80 + e % 60).cast("double").alias("gs"), ((e * 13) % 360).cast("double").alias("track"),
        F.when(a % 3 == 0, "A1").when(a % 3 == 1, "A3").otherwise("A7").alias("category"),
        F.when(kind == "error", "7700").when(kind == "signup", "7600").when(kind == "purchase", "4512").otherwise("1200").alias("squawk"),
        F.when(kind == "error", "general").when(kind == "view", "none").alias("emergency"),
        F.when(kind != "click", (e % 41 - 20) * 64).alias("baro_rate"),
        F.when(a % 10 == 3, F.lit(1).cast("bigint")).when(a % 10 == 4, F.lit(0).cast("bigint")).alias("db_flags"),
        (e % 11 == 0).alias("on_ground"), "event_type", "user_id", "ts", "value",
    )


AIRPORTS_SQL = """airports AS (
  SELECT n_nationkey AS ordinal, 'K' || chr(CAST(65 + n_nationkey AS INTEGER)) || 'XX' AS ident, n_name AS name,
    CAST(36.5 AS DOUBLE) + (n_nationkey % 5) * CAST(0.08 AS DOUBLE) AS lat,
    CAST(-121.8 AS DOUBLE) + (n_nationkey // 5) * CAST(0.05 AS DOUBLE) AS lon,
    CAST(800 + (n_nationkey % 6) * 40 AS DOUBLE) AS elev,
    CASE n_nationkey % 4 WHEN 0 THEN 'small_airport' WHEN 1 THEN 'medium_airport' WHEN 2 THEN 'large_airport' ELSE 'heliport' END AS type,
    CASE WHEN n_nationkey % 5 = 4 THEN 'CA' ELSE 'US' END AS iso_country
  FROM nation)"""


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select(
        k.alias("ordinal"), F.concat(F.lit("K"), F.char(65 + k), F.lit("XX")).alias("ident"), F.col("n_name").alias("name"),
        (F.lit(36.5) + (k % 5) * F.lit(0.08)).alias("lat"),
        (F.lit(-121.8) + F.floor(k / 5) * F.lit(0.05)).alias("lon"),
        (800 + (k % 6) * 40).cast("double").alias("elev"),
        F.when(k % 4 == 0, "small_airport").when(k % 4 == 1, "medium_airport").when(k % 4 == 2, "large_airport").otherwise("heliport").alias("type"),
        F.when(k % 5 == 4, "CA").otherwise("US").alias("iso_country"),
    )


# One runway per airport; the two ends lie 0.01 degrees either side of the field.
RUNWAYS_SQL = AIRPORTS_SQL + """, runways AS (
  SELECT ident, ordinal, elev, lat, lon,
    lpad(CAST(h // 10 AS VARCHAR), 2, '0') || CASE WHEN ordinal % 3 = 0 THEN 'L' ELSE '' END AS le_ident,
    lpad(CAST(h // 10 + 18 AS VARCHAR), 2, '0') || CASE WHEN ordinal % 3 = 0 THEN 'R' ELSE '' END AS he_ident,
    CASE WHEN ordinal % 6 <> 5 THEN CAST(h AS DOUBLE) END AS le_heading,
    CASE WHEN ordinal % 6 <> 5 THEN CAST(h + 180 AS DOUBLE) END AS he_heading,
    lat - CAST(0.01 AS DOUBLE) AS le_lat, lon - CAST(0.002 AS DOUBLE) AS le_lon,
    lat + CAST(0.01 AS DOUBLE) AS he_lat, lon + CAST(0.002 AS DOUBLE) AS he_lon,
    3000 + ordinal * 100 AS length_ft, 75 + (ordinal % 3) * 25 AS width_ft, CASE WHEN ordinal % 8 = 7 THEN '1' ELSE '0' END AS closed
  FROM (SELECT *, 10 + (ordinal * 17) % 160 AS h FROM airports))"""


def runways(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("ordinal")
    h = F.col("h")
    tenth = F.floor(h / 10)
    known = o % 6 != 5

    def ident(number, side):
        return F.concat(F.lpad(number.cast("string"), 2, "0"), F.when(o % 3 == 0, side).otherwise(""))

    return airports(spark, sf_dir).withColumn("h", 10 + (o * 17) % 160).select(
        "ident", "ordinal", "elev", "lat", "lon",
        ident(tenth, "L").alias("le_ident"), ident(tenth + 18, "R").alias("he_ident"),
        F.when(known, h.cast("double")).alias("le_heading"), F.when(known, (h + 180).cast("double")).alias("he_heading"),
        (F.col("lat") - F.lit(0.01)).alias("le_lat"), (F.col("lon") - F.lit(0.002)).alias("le_lon"),
        (F.col("lat") + F.lit(0.01)).alias("he_lat"), (F.col("lon") + F.lit(0.002)).alias("he_lon"),
        (3000 + o * 100).alias("length_ft"), (75 + (o % 3) * 25).alias("width_ft"),
        F.when(o % 8 == 7, "1").otherwise("0").alias("closed"),
    )


# Weather observations: every 'view' event is a report of one station.
METAR_SQL = """metar AS (
  SELECT event_id, ts AS valid,
    CASE WHEN event_id % 9 = 0 THEN 'M' ELSE CAST((event_id * 7) % 24 AS VARCHAR) || '.25' END AS vsby,
    CASE event_id % 4 WHEN 0 THEN 'CLR' WHEN 1 THEN 'BKN' WHEN 2 THEN 'FEW' ELSE 'OVC' END AS skyc1,
    CASE event_id % 3 WHEN 0 THEN 'BKN' WHEN 1 THEN 'SCT' ELSE 'VV' END AS skyc2, '' AS skyc3,
    CASE WHEN event_id % 5 = 0 THEN 'M' ELSE CAST((event_id * 31) % 60 * 100 AS VARCHAR) END AS skyl1,
    CASE WHEN event_id % 7 = 0 THEN 'M' ELSE CAST((event_id * 17) % 90 * 100 AS VARCHAR) END AS skyl2, '' AS skyl3
  FROM events WHERE event_type = 'view')"""


def metar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where(F.col("event_type") == "view").select(
        "event_id", F.col("ts").alias("valid"),
        F.when(e % 9 == 0, "M").otherwise(F.concat(((e * 7) % 24).cast("string"), F.lit(".25"))).alias("vsby"),
        F.when(e % 4 == 0, "CLR").when(e % 4 == 1, "BKN").when(e % 4 == 2, "FEW").otherwise("OVC").alias("skyc1"),
        F.when(e % 3 == 0, "BKN").when(e % 3 == 1, "SCT").otherwise("VV").alias("skyc2"), F.lit("").alias("skyc3"),
        F.when(e % 5 == 0, "M").otherwise(((e * 31) % 60 * 100).cast("string")).alias("skyl1"),
        F.when(e % 7 == 0, "M").otherwise(((e * 17) % 90 * 100).cast("string")).alias("skyl2"), F.lit("").alias("skyl3"),
    )


# Two region layers; names are matched without regard to case.
REGION_FILES = ["field.kml", "sectors.kml"]
REGION_LAYERS = [
    [
        {"name": "Ground", "min_alt": 0, "max_alt": 1150, "hdg0": 0, "hdg1": 360,
         "ring": [(-121.80, 36.50), (-121.70, 36.50), (-121.68, 36.60), (-121.74, 36.66), (-121.80, 36.60)]},
        {"name": "Pattern", "min_alt": 1000, "max_alt": 1500, "hdg0": 0, "hdg1": 360,
         "ring": [(-121.81, 36.49), (-121.66, 36.52), (-121.69, 36.70), (-121.79, 36.68)]},
        {"name": "Vicinity", "min_alt": 0, "max_alt": 5000, "hdg0": 0, "hdg1": 360,
         "ring": [(-121.85, 36.45), (-121.64, 36.45), (-121.64, 36.74), (-121.85, 36.74)]},
    ],
    [
        {"name": "North flow", "min_alt": 0, "max_alt": 10000, "hdg0": 280, "hdg1": 80,
         "ring": [(-121.83, 36.55), (-121.60, 36.55), (-121.60, 36.90), (-121.72, 36.83), (-121.83, 36.90)]},
        {"name": "South flow", "min_alt": 1100, "max_alt": 1800, "hdg0": 100, "hdg1": 260,
         "ring": [(-121.83, 36.48), (-121.60, 36.48), (-121.60, 36.80), (-121.83, 36.80)]},
    ],
]


def _crossings(ring) -> str:
    terms = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        x1, y1, x2, y2 = (f"CAST({v} AS DOUBLE)" for v in (x1, y1, x2, y2))
        terms.append(
            f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END")
    return "((" + " + ".join(terms) + ") % 2 = 1)"


def region_test_sql(region: dict) -> str:
    h0, h1 = region["hdg0"], region["hdg1"]
    heading = f"(track >= {h0} AND track <= {h1})" if h0 <= h1 else f"(track >= {h0} OR track <= {h1})"
    return f"(alt_baro BETWEEN {region['min_alt']} AND {region['max_alt']} AND {_crossings(region['ring'])} AND {heading})"


def _layer_sql(layer: list) -> str:
    return "CASE " + " ".join(f"WHEN {region_test_sql(r)} THEN '{r['name'].lower()}'" for r in layer) + " END"


LIFE_S = 180
# Reports with region per layer, previous regions of the same life, life number.
REGIONS_SQL = POSITIONS_SQL + f""", located AS (
  SELECT *, {_layer_sql(REGION_LAYERS[0])} AS in0, {_layer_sql(REGION_LAYERS[1])} AS in1 FROM positions),
paired AS (
  SELECT *, now - lag(now) OVER w > {LIFE_S} AS broke, lag(now) OVER w AS pnow, lag(in0) OVER w AS p0, lag(in1) OVER w AS p1
  FROM located WINDOW w AS (PARTITION BY tail ORDER BY now, seq)),
prepared AS (
  SELECT * EXCLUDE (p0, p1, broke), CASE WHEN now - pnow <= {LIFE_S} THEN p0 END AS was0, CASE WHEN now - pnow <= {LIFE_S} THEN p1 END AS was1,
    CAST(1 + sum(CASE WHEN broke THEN 1 ELSE 0 END) OVER (PARTITION BY tail ORDER BY now, seq) AS BIGINT) AS life_no
  FROM paired)"""

EARTH = 3443.92


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"(2.0 * {EARTH} * atan2(sqrt({h}), sqrt(1.0 - {h})))"


def equirect_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(sqrt(pow({lat2} - {lat1}, 2) + pow(({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) / 2)), 2)) * 60.0)")


def bearing_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dl = f"radians({lon2} - ({lon1}))"
    return (f"((degrees(atan2(sin({dl}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2}))"
            f" - sin(radians({lat1})) * cos(radians({lat2})) * cos({dl}))) + 360.0) % 360.0)")


def circular_sql(a: str, b: str) -> str:
    return f"least(abs({a} - ({b})) % 360.0, 360.0 - abs({a} - ({b})) % 360.0)"


# Real reports with flight number and predecessors, resampled rows, proximity hits.
STEPS_SQL = POSITIONS_SQL + f""", lagged AS (
  SELECT *, lag(now) OVER w AS n1, lag(lat) OVER w AS lat_1, lag(lon) OVER w AS lon_1, lag(alt_baro) OVER w AS alt_1, lag(gs) OVER w AS gs_1,
    lag(track) OVER w AS track_1, lag(now, 2) OVER w AS n2, lag(lat, 2) OVER w AS lat_2, lag(lon, 2) OVER w AS lon_2, lead(now) OVER w AS nx
  FROM positions WINDOW w AS (PARTITION BY tail ORDER BY now, seq)),
speeds AS (
  SELECT *, CASE WHEN now - n1 > 1 AND now - n1 <= 60 THEN {haversine_sql('lat_1', 'lon_1', 'lat', 'lon')} / ((now - n1) / 3600.0) END AS v1,
    CASE WHEN n1 - n2 > 0 AND n1 - n2 <= 60 THEN {haversine_sql('lat_2', 'lon_2', 'lat_1', 'lon_1')} / ((n1 - n2) / 3600.0) END AS v2
  FROM lagged),
steps AS (
  SELECT *, tail || '_' || CAST(1 + sum(CASE WHEN now - n1 > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY tail ORDER BY now, seq) AS VARCHAR) AS flight_id,
    coalesce(v1 > 600, false) AS teleport, NOT coalesce(v1 > 600, false) AND coalesce(abs(v1 - v2) > 100, false) AS speed_jump
  FROM speeds)"""

RESAMPLED_SQL = STEPS_SQL + """, filled AS (
  SELECT unnest(CASE WHEN now - n1 > 1 AND now - n1 <= 60 THEN range(CAST(n1 AS BIGINT) + 1, CAST(now AS BIGINT) + 1)
                     ELSE [CAST(now AS BIGINT)] END) AS sec, * FROM steps),
fractions AS (
  SELECT *, sec = CAST(now AS BIGINT) AS real, (CAST(sec AS DOUBLE) - n1) / (now - n1) AS f,
    CASE WHEN track - track_1 > 180 THEN track - track_1 - 360 WHEN track - track_1 < -180 THEN track - track_1 + 360 ELSE track - track_1 END AS turn
  FROM filled),
resampled AS (
  SELECT sec, tail, flight_id, seq, NOT real AS resampled, teleport OR speed_jump AS suspicious, CAST(sec AS DOUBLE) AS now,
    CASE WHEN real THEN lat ELSE lat_1 + f * (lat - lat_1) END AS lat, CASE WHEN real THEN lon ELSE lon_1 + f * (lon - lon_1) END AS lon,
    CAST(CASE WHEN real THEN alt_baro ELSE trunc(alt_1 + f * (alt_baro - alt_1)) END AS BIGINT) AS alt_baro,
    CASE WHEN real THEN gs ELSE gs_1 + f * (gs - gs_1) END AS gs,
    CASE WHEN real THEN track ELSE ((track_1 + f * turn) % 360 + 360) % 360 END AS track
  FROM fractions)"""


def hits_sql(lateral: float = 0.3, vertical: float = 400.0) -> str:
    return RESAMPLED_SQL + f""", hits AS (
  SELECT * FROM (
    SELECT a.sec, a.tail AS tail1, b.tail AS tail2, a.flight_id AS flight_id1, b.flight_id AS flight_id2, a.now AS now1, b.now AS now2,
      a.lat AS lat1, a.lon AS lon1, a.alt_baro AS alt1, b.lat AS lat2, b.lon AS lon2, b.alt_baro AS alt2,
      {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS lateral_nm, CAST(abs(a.alt_baro - b.alt_baro) AS DOUBLE) AS alt_sep_ft
    FROM resampled a JOIN resampled b ON a.sec = b.sec AND a.tail < b.tail AND abs(a.alt_baro - b.alt_baro) < {vertical})
  WHERE lateral_nm < {lateral})"""


SESSIONS_SQL = hits_sql() + """, event_hits AS (
  SELECT *, CAST(1 + sum(CASE WHEN sec - prev > 61 THEN 1 ELSE 0 END) OVER (PARTITION BY tail1, tail2 ORDER BY sec) AS BIGINT) AS event_no
  FROM (SELECT *, lag(sec) OVER (PARTITION BY tail1, tail2 ORDER BY sec) AS prev FROM hits))"""
