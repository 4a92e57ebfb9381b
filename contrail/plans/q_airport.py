"""Busyness, weather, coverage and runway queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, weather
from ..operators import airport
from ..operators.los import nearest_airports
from ..session import scratch_path
from . import tables as t
from .registry import query

HOURLY = """hourly AS (SELECT CAST(ts AS DATE) AS date, hour(ts) AS hour, count(DISTINCT user_id) AS aircraft FROM events GROUP BY 1, 2)"""


def _hourly(spark, sf):
    return airport.hourly_unique(t.table(spark, sf, "events"), "user_id", F.to_date("ts"), F.hour("ts"))


@query("A1_hourly_unique_aircraft", f"WITH {HOURLY} SELECT date, CAST(hour AS INTEGER) AS hour, aircraft FROM hourly")
def hourly_unique(spark, sf):
    return _hourly(spark, sf)


_C = "coalesce(" + ", ".join(f"CASE WHEN skyc{i} IN ('BKN','OVC','VV') THEN try_cast(skyl{i} AS DOUBLE) END" for i in (1, 2, 3)) + ")"
CATEGORY = t.METAR_SQL + f""", obs AS (SELECT *, try_cast(vsby AS DOUBLE) AS vis, {_C} AS ceil FROM metar),
ranked AS (SELECT *, CASE WHEN ceil < 500 THEN 0 WHEN ceil < 1000 THEN 1 WHEN ceil < 3000 THEN 2 ELSE 3 END AS rc,
  CASE WHEN vis < 1 THEN 0 WHEN vis < 3 THEN 1 WHEN vis <= 5 THEN 2 ELSE 3 END AS rv FROM obs),
categorised AS (SELECT *, CASE WHEN vis IS NULL AND ceil IS NULL THEN 'UNKNOWN' ELSE ['LIFR','IFR','MVFR','VFR'][least(rc, rv) + 1] END AS category FROM ranked),
hourly_cat AS (SELECT CAST(valid AS DATE) AS date, hour(valid) AS hour, arg_max(category, valid) AS category
  FROM categorised WHERE category <> 'UNKNOWN' GROUP BY 1, 2)"""


@query("X12_flight_category", f"WITH {CATEGORY} SELECT event_id, round(ceil, 2) AS ceiling, category FROM categorised")
def flight_category(spark, sf):
    sky = [f"skyc{i}" for i in (1, 2, 3)], [f"skyl{i}" for i in (1, 2, 3)]
    c = weather.ceiling_ft(*sky)
    return t.metar(spark, sf).select("event_id", F.round(c, 2).alias("ceiling"), weather.flight_category(F.col("vsby").try_cast("double"), c).alias("category"))


@query("A3_hourly_flight_category", f"WITH {CATEGORY} SELECT date, CAST(hour AS INTEGER) AS hour, category FROM hourly_cat")
def hourly_category(spark, sf):
    return airport.hourly_category(t.metar(spark, sf))


TERM = "CASE category WHEN 'VFR' THEN 'VMC' WHEN 'MVFR' THEN 'MVMC' WHEN 'IFR' THEN 'IMC' WHEN 'LIFR' THEN 'IMC' END"


@query("J7_weather_join", f"WITH {HOURLY}, {CATEGORY} SELECT h.date, CAST(h.hour AS INTEGER) AS hour, aircraft, coalesce({TERM}, 'UNKNOWN') AS weather FROM hourly h LEFT JOIN hourly_cat c ON h.date = c.date AND h.hour = c.hour")
def weather_join(spark, sf):
    return airport.with_weather(_hourly(spark, sf), airport.hourly_category(t.metar(spark, sf)))


CUBE = f"""WITH {HOURLY}, {CATEGORY}, w AS (SELECT h.*, coalesce({TERM}, 'UNKNOWN') AS weather, CASE WHEN isodow(h.date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type
  FROM hourly h LEFT JOIN hourly_cat c ON h.date = c.date AND h.hour = c.hour),
cube AS (SELECT CAST(hour AS INTEGER) AS hour, d AS day_type, x AS weather, avg(aircraft) AS mean, count(*) AS n
  FROM (SELECT *, unnest([day_type, 'all']) AS d FROM w) , (VALUES (0), (1)) v(k), LATERAL (SELECT CASE WHEN k = 0 THEN 'ALL' ELSE weather END AS x)
  WHERE x <> 'UNKNOWN' GROUP BY 1, 2, 3)"""


def _cube(spark, sf):
    return airport.busyness(_hourly(spark, sf), airport.hourly_category(t.metar(spark, sf)))


@query("A2_busyness_cube", CUBE + " SELECT hour, day_type, weather, round(mean, 4) AS mean, n FROM cube")
def busyness_cube(spark, sf):
    return _cube(spark, sf).withColumn("mean", F.round("mean", 4))


@query("A2_busyness_summary", CUBE + " SELECT round(max(mean), 1) AS global_max, count(*) AS buckets, array_to_string(list_sort(list(DISTINCT weather) FILTER (WHERE weather <> 'ALL')), ',') AS weather_categories FROM cube")
def busyness_summary(spark, sf):
    return airport.busyness_summary(_cube(spark, sf))


# Every report once per airport within 10 nm, in the airport's height band.
SHARD = f"""{t.POSITIONS_SQL}, {t.AIRPORTS_SQL}, sharded AS (
  SELECT * FROM (SELECT p.*, a.ident AS icao, a.elev, a.lat AS ap_lat, a.lon AS ap_lon, {t.equirect_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} AS d FROM positions p, airports a) WHERE d <= 10)"""


def _shards(spark, sf):
    return airport.shard_by_airport(t.positions(spark, sf), t.airports(spark, sf))


@query("J5_multi_airport_shard", f"WITH {SHARD} SELECT icao, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum, round(max(d), 6) AS far FROM sharded GROUP BY 1")
def multi_airport_shard(spark, sf):
    return _shards(spark, sf).groupBy("icao").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"), F.round(F.max("distance_nm"), 6).alias("far"))


@query("J5_shard_radius_override", f"""WITH {SHARD} SELECT icao, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM sharded s JOIN airports a ON a.ident = s.icao
  WHERE d <= CASE WHEN a.ordinal % 3 = 0 THEN 3.0 ELSE 10.0 END GROUP BY 1""")
def shard_override(spark, sf):
    a = t.airports(spark, sf).withColumn("radius_nm", F.when(F.col("ordinal") % 3 == 0, 3.0))
    return airport.shard_by_airport(t.positions(spark, sf), a).groupBy("icao").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query("J5_twin_airports", f"""WITH {SHARD} SELECT icao || suffix AS icao, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM sharded, (VALUES ('a'), ('b')) v(suffix) GROUP BY 1""")
def twin_airports(spark, sf):
    twice = t.airports(spark, sf).withColumn("ident", F.explode(F.array(F.concat("ident", F.lit("a")), F.concat("ident", F.lit("b")))))
    return airport.shard_by_airport(t.positions(spark, sf), twice).groupBy("icao").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query("J6_airport_cells", f"""WITH {t.AIRPORTS_SQL}, cells AS (
  SELECT ident, unnest(range(CAST(floor(lat - 5 / 60.0) AS BIGINT), CAST(floor(lat + 5 / 60.0) AS BIGINT) + 1)) AS cell_lat, lon, lat FROM airports)
  SELECT ident, cell_lat, unnest(range(CAST(floor(lon - 5 / (60.0 * cos(radians(lat)))) AS BIGINT), CAST(floor(lon + 5 / (60.0 * cos(radians(lat)))) AS BIGINT) + 1)) AS cell_lon FROM cells""")
def airport_cells(spark, sf):
    return airport.airport_cells(t.airports(spark, sf)).select("ident", "cell_lat", "cell_lon")


@query("J6_airport_points", f"WITH {SHARD} SELECT icao, seq, round(d, 6) AS distance_nm FROM sharded WHERE d <= 5")
def airport_points(spark, sf):
    """Grid shards read back by the cells of each airport's box."""
    path = scratch_path(spark, "cell-shards")
    p = t.positions(spark, sf).select("seq", "lat", "lon", F.floor("lat").cast("int").alias("cell_lat"), F.floor("lon").cast("int").alias("cell_lon"))
    p.write.partitionBy("cell_lat", "cell_lon").parquet(path)
    out = airport.airport_points(spark.read.parquet(path), t.airports(spark, sf))
    return out.select("icao", "seq", F.round("distance_nm", 6).alias("distance_nm"))


@query("F25_agl_band", f"WITH {SHARD} SELECT icao, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM sharded WHERE alt_baro IS NULL OR alt_baro BETWEEN elev - 200 AND elev + 400 GROUP BY 1")
def agl_band(spark, sf):
    return _shards(spark, sf).where(airport.agl_band("alt_baro", "elev", above=400)).groupBy("icao").agg(
        F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


# Coverage reads the hour as its "date" so that several exist; altitudes are moved
# down so that the corridor, the floor and the surface are all met.
LOW = SHARD + f""", pts AS (SELECT icao, hex, now, seq, CAST(to_timestamp(now) AT TIME ZONE 'UTC' AS DATE) AS d0, CAST(floor(now / 3600) AS BIGINT) AS date,
    alt_baro - 100 - (seq // 600) % 4 * 200 AS alt, elev, d <= 5 AS inside FROM sharded),
lagged AS (SELECT *, lag(inside) OVER w AS was, now - lag(now) OVER w AS gap, count(*) OVER (PARTITION BY icao, date, hex) AS k FROM pts WINDOW w AS (PARTITION BY icao, date, hex ORDER BY now, seq)),
tracks AS (SELECT icao, date, hex, count(*) AS points, count(*) FILTER (WHERE was <> inside) AS transitions,
  bool_or(inside AND alt BETWEEN elev + 800 AND elev + 1500) AS in_corridor, bool_or(inside AND alt < elev + 800) AS descended, bool_or(alt <= elev + 500) AS surface
  FROM lagged GROUP BY 1, 2, 3)"""


def _low(spark, sf):
    s = _shards(spark, sf)
    return s.withColumn("date", F.floor(F.col("now") / 3600)).withColumn(
        "alt_baro", F.col("alt_baro") - 100 - F.floor(F.col("seq") / 600) % 4 * 200)


@query("W15_ring_transitions", f"WITH {LOW} SELECT icao, date, hex, points, transitions FROM tracks")
def ring_transitions(spark, sf):
    return airport.coverage_tracks(_low(spark, sf)).select("icao", "date", "hex", "points", "transitions")


QUALITY = f"""WITH {LOW}, per AS (SELECT icao, date, count(*) AS total_tracks,
  count(*) FILTER (WHERE points >= 3 AND in_corridor AND transitions < 2 AND descended AND surface) AS completed,
  count(*) FILTER (WHERE points >= 3 AND in_corridor AND transitions < 2 AND descended AND NOT surface) AS lost,
  count(*) FILTER (WHERE points >= 3 AND in_corridor AND (transitions >= 2 OR NOT descended)) AS through FROM tracks GROUP BY 1, 2),
gaps AS (SELECT icao, date, gap, row_number() OVER (PARTITION BY icao, date ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY icao, date) AS m FROM lagged WHERE gap > 0 AND gap <= 300 AND k >= 3),
pct AS (SELECT icao, date, any_value(m) AS total_gaps, max(gap) FILTER (WHERE i = m // 2) AS median_gap_s, max(gap) FILTER (WHERE i = CAST(floor(m * 0.9) AS BIGINT)) AS p90_gap_s FROM gaps GROUP BY 1, 2),
quality AS (SELECT p.*, completed + lost AS low_alt_tracks, CASE WHEN completed + lost > 0 THEN lost / (completed + lost) END AS lost_rate, median_gap_s, p90_gap_s, coalesce(total_gaps, 0) AS total_gaps
  FROM per p LEFT JOIN pct USING (icao, date))"""


@query("A4_coverage_quality", QUALITY + " SELECT icao, date, total_tracks, completed, lost, through, low_alt_tracks, round(lost_rate, 6) AS lost_rate FROM quality")
def coverage_quality(spark, sf):
    q = airport.coverage_quality(_low(spark, sf))
    return q.select("icao", "date", "total_tracks", "completed", "lost", "through", "low_alt_tracks", F.round("lost_rate", 6).alias("lost_rate"))


@query("A5_gap_percentiles", QUALITY + " SELECT icao, date, total_gaps, median_gap_s, p90_gap_s FROM pct")
def gap_percentiles(spark, sf):
    return airport.gap_percentiles(airport.coverage_gaps(_low(spark, sf)), ["icao", "date"])


@query("A5_user_gap_percentiles", """SELECT event_type, count(*) AS total_gaps, max(v) FILTER (WHERE i = m // 2) AS median_gap_s, max(v) FILTER (WHERE i = CAST(floor(m * 0.9) AS BIGINT)) AS p90_gap_s
  FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1""")
def value_percentiles(spark, sf):
    return airport.gap_percentiles(t.table(spark, sf, "events").withColumn("times", F.lit(1)), ["event_type"], "value", bucket=5.0)


_UM = "list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL))[CAST(count({c}) // 2 AS INTEGER) + 1]"
ROLLUP = QUALITY + f""", roll AS (SELECT icao, count(*) AS num_dates, CAST(sum(low_alt_tracks) AS BIGINT) AS low_alt_tracks, CAST(sum(completed) AS BIGINT) AS completed,
  {_UM.format(c='median_gap_s')} AS m, {_UM.format(c='p90_gap_s')} AS p FROM quality GROUP BY 1),
scored AS (SELECT *, CASE WHEN low_alt_tracks > 0 THEN 1.0 - completed / low_alt_tracks END AS rate FROM roll),
graded AS (SELECT *, CASE WHEN rate IS NULL THEN 'none' WHEN rate < 0.25 THEN 'green' WHEN rate < 0.5 THEN 'yellow' ELSE 'red' END AS ts,
  CASE WHEN m IS NULL THEN 'none' WHEN m < 5 THEN 'green' WHEN m < 15 THEN 'yellow' ELSE 'red' END AS gs FROM scored)"""


@query("A6_quality_rollup", ROLLUP + """ SELECT icao, CASE WHEN ts = 'none' THEN 'none' WHEN gs = 'none' THEN ts WHEN 'red' IN (ts, gs) THEN 'red' WHEN 'yellow' IN (ts, gs) THEN 'yellow' ELSE 'green' END AS score,
  round(rate, 3) AS lost_rate, round(CASE WHEN low_alt_tracks > 0 THEN completed / low_alt_tracks END, 3) AS completion_rate, round(m, 1) AS median_gap_s, round(p, 1) AS p90_gap_s,
  num_dates, low_alt_tracks, completed, ts AS termination_score, gs AS gap_score FROM graded""")
def quality_rollup(spark, sf):
    return airport.quality_rollup(airport.coverage_quality(_low(spark, sf)))


# --- runways ----------------------------------------------------------------

_RN = "CASE WHEN regexp_matches({c}, '^[0-9]+[LRC]?$') AND CAST(regexp_extract({c}, '^([0-9]+)', 1) AS INTEGER) BETWEEN 1 AND 36 THEN lpad(CAST(CAST(regexp_extract({c}, '^([0-9]+)', 1) AS INTEGER) AS VARCHAR), 2, '0') ELSE '' END"
ANCHORS = t.RUNWAYS_SQL + f""", ends AS (
  SELECT ident AS icao, ordinal, 0 AS end_no, {_RN.format(c='le_ident')} AS runway, coalesce(le_heading % 360, {t.bearing_sql('le_lat', 'le_lon', 'he_lat', 'he_lon')}) AS heading, le_lat AS rwy_lat, le_lon AS rwy_lon FROM runways WHERE closed <> '1'
  UNION ALL SELECT ident, ordinal, 1, {_RN.format(c='he_ident')}, coalesce(he_heading % 360, {t.bearing_sql('he_lat', 'he_lon', 'le_lat', 'le_lon')}), he_lat, he_lon FROM runways WHERE closed <> '1'),
anchors AS (SELECT * FROM ends WHERE runway <> '' QUALIFY row_number() OVER (PARTITION BY icao, runway ORDER BY ordinal, end_no) = 1)"""


@query("G10_runway_anchors", f"WITH {ANCHORS} SELECT icao, runway, end_no, round(heading, 6) AS heading, round(rwy_lat, 6) AS rwy_lat, round(rwy_lon, 6) AS rwy_lon FROM anchors")
def runway_anchors(spark, sf):
    a = airport.runway_anchors(t.runways(spark, sf))
    return a.select("icao", "runway", "end_no", *[F.round(c, 6).alias(c) for c in ("heading", "rwy_lat", "rwy_lon")])


# Votes read aircraft flying straight in and back out along each runway: the event
# time gives the distance from the field, so several passes and visits occur.
APPROACHES = f"""WITH {ANCHORS}, centers AS (SELECT icao, avg(rwy_lat) AS field_lat, avg(rwy_lon) AS field_lon FROM anchors GROUP BY 1),
flown AS (
  SELECT a.icao, 'h' || CAST(e.event_id % 7 AS VARCHAR) AS hex, CAST({t.EPOCH0} + e.event_id * 3 + (e.event_id // 1500) * 2000 AS DOUBLE) AS now, e.event_id AS seq,
    a.rwy_lat - cos(radians(a.heading)) * s / 60.0 AS lat,
    a.rwy_lon - sin(radians(a.heading)) * s / (60.0 * cos(radians(a.rwy_lat))) AS lon
  FROM (SELECT *, (abs(event_id % 400 - 200) - 60) * CAST(0.01 AS DOUBLE) AS s FROM events) e JOIN anchors a ON a.ordinal = e.event_id % 25 AND a.end_no = (e.event_id // 25) % 2 * 0),
gapped AS (SELECT *, now - lag(now) OVER (PARTITION BY icao, hex ORDER BY now, seq) AS gap FROM flown),
visits AS (SELECT g.*, CAST(1 + sum(CASE WHEN gap > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY g.icao, hex ORDER BY now, seq) AS BIGINT) AS visit,
  {t.equirect_sql('field_lat', 'field_lon', 'lat', 'lon')} AS fd FROM gapped g JOIN centers c ON g.icao = c.icao),
marked AS (SELECT *, CASE WHEN fd < 0.4 THEN 'near' WHEN fd > 1.0 THEN 'far' END AS mark FROM visits),
seen AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY icao, hex, visit ORDER BY now, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM marked),
pieces AS (SELECT *, CAST(coalesce(sum(CASE WHEN mark = 'far' AND prior = 'near' THEN 1 ELSE 0 END) OVER (PARTITION BY icao, hex, visit ORDER BY now, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS piece FROM seen)"""


def _flown(spark, sf):
    a = airport.runway_anchors(t.runways(spark, sf))
    e = F.col("event_id")
    s = (F.abs(e % 400 - 200) - 60) * F.lit(0.01)
    ev = t.table(spark, sf, "events").select(
        (e % 25).alias("ordinal"), F.concat(F.lit("h"), (e % 7).cast("string")).alias("hex"),
        (t.EPOCH0 + e * 3 + F.floor(e / 1500) * 2000).cast("double").alias("now"), e.alias("seq"), s.alias("s"))
    end = a.where("end_no = 0").select("icao", "ordinal", "heading", "rwy_lat", "rwy_lon")
    h = F.radians("heading")
    pts = ev.join(F.broadcast(end), "ordinal").select(
        "icao", "hex", "now", "seq", (F.col("rwy_lat") - F.cos(h) * F.col("s") / 60.0).alias("lat"),
        (F.col("rwy_lon") - F.sin(h) * F.col("s") / (60.0 * F.cos(F.radians("rwy_lat")))).alias("lon"))
    return pts, a


def _pieces(spark, sf):
    pts, a = _flown(spark, sf)
    return airport.split_approaches(pts, airport.field_centers(a)), a


@query("W11_visits", APPROACHES + " SELECT icao, hex, visit, count(*) AS n, min(now) AS first_now FROM visits GROUP BY 1, 2, 3")
def visits(spark, sf):
    pieces, _ = _pieces(spark, sf)
    return pieces.groupBy("icao", "hex", "visit").agg(F.count(F.lit(1)).alias("n"), F.min("now").alias("first_now"))


@query("W12_field_crossings", APPROACHES + " SELECT icao, hex, visit, piece, count(*) AS n, min(now) AS first_now FROM pieces GROUP BY 1, 2, 3, 4")
def field_crossings(spark, sf):
    pieces, _ = _pieces(spark, sf)
    return pieces.groupBy(*airport.APPROACH).agg(F.count(F.lit(1)).alias("n"), F.min("now").alias("first_now"))


def _box(la: str, lo: str) -> str:
    out = "radians((heading + 180.0) % 360.0)"
    n, e = f"(({la} - rwy_lat) * 60.0)", f"(({lo} - rwy_lon) * 60.0 * cos(radians(rwy_lat)))"
    return (f"({n} * cos({out}) + {e} * sin({out})) BETWEEN 0.0 AND 1.5 AND abs({e} * cos({out}) - {n} * sin({out})) <= 2500.0 / 2 / 6076.12")


FINALS = APPROACHES + f""", segs0 AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM pieces WINDOW w AS (PARTITION BY icao, hex, visit, piece ORDER BY now, seq)),
segs AS (SELECT s.icao, hex, visit, piece, now, seq, a.runway, a.ordinal, a.end_no, {_box('lat0', 'lon0')} AND {_box('s.lat', 's.lon')} AND {t.circular_sql(t.bearing_sql('lat0', 'lon0', 's.lat', 's.lon'), 'heading')} <= 20 AS ok,
  {t.equirect_sql('lat0', 'lon0', 's.lat', 's.lon')} AS dd FROM segs0 s JOIN anchors a ON a.icao = s.icao WHERE lat0 IS NOT NULL AND (lat0 <> s.lat OR lon0 <> s.lon)),
isl AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY icao, hex, visit, piece, runway ORDER BY now, seq) AS island FROM segs),
runs AS (SELECT icao, hex, visit, piece, runway, ordinal, end_no, max(run) AS run_nm FROM (
  SELECT icao, hex, visit, piece, runway, ordinal, end_no, island, sum(CASE WHEN ok THEN dd ELSE 0 END) AS run FROM isl GROUP BY ALL) GROUP BY ALL),
votes AS (SELECT icao, hex, visit, piece, runway, run_nm FROM runs WHERE run_nm >= 0.2 QUALIFY row_number() OVER (PARTITION BY icao, hex, visit, piece ORDER BY run_nm DESC, ordinal DESC, end_no DESC) = 1)"""


def _runs(spark, sf):
    pieces, a = _pieces(spark, sf)
    return airport.final_runs(pieces, a)


@query("W13_longest_final_run", FINALS + " SELECT icao, hex, visit, piece, runway, round(run_nm, 5) AS run_nm FROM runs")
def longest_final_run(spark, sf):
    return _runs(spark, sf).select(*airport.APPROACH, "runway", F.round("run_nm", 5).alias("run_nm"))


@query("W14_runway_vote", FINALS + " SELECT icao, hex, visit, piece, runway FROM votes")
def runway_vote(spark, sf):
    return airport.runway_votes(_runs(spark, sf)).select(*airport.APPROACH, "runway")


@query("A7_runway_usage", FINALS + """, n AS (SELECT icao, runway, count(*) AS votes FROM votes GROUP BY 1, 2)
  SELECT icao, runway, votes, CAST(round_even(100.0 * votes / sum(votes) OVER (PARTITION BY icao), 0) AS BIGINT) AS pct FROM n""")
def runway_usage(spark, sf):
    return airport.runway_usage(airport.runway_votes(_runs(spark, sf)))


# The same aircraft, of which only reports up to 1500 ft above the field vote.
LOW_FINALS = FINALS.replace("(e.event_id // 25) % 2 * 0)", "(e.event_id // 25) % 2 * 0 WHERE (e.event_id * 7) % 3000 <= 1500)")


@query("A7_usage_from_reports", LOW_FINALS + """, n AS (SELECT icao, runway, count(*) AS votes FROM votes GROUP BY 1, 2)
  SELECT icao, runway, votes, CAST(round_even(100.0 * votes / sum(votes) OVER (PARTITION BY icao), 0) AS BIGINT) AS pct FROM n""")
def usage_from_reports(spark, sf):
    pts, a = _flown(spark, sf)
    field = airport.field_centers(a).select("icao", F.col("field_lat").alias("ap_lat"), F.col("field_lon").alias("ap_lon"), F.lit(100).alias("elev"))
    pts = pts.join(F.broadcast(field), "icao").withColumn("alt_baro", 100 + F.col("seq") * 7 % 3000)
    return airport.usage_from_reports(pts, t.runways(spark, sf))


WINDS = f"""WITH {t.RUNWAYS_SQL}, winds AS (
  SELECT event_id, 'K' || chr(CAST(65 + event_id % 25 AS INTEGER)) || 'XX' AS ident, CASE WHEN event_id % 6 = 0 THEN 'VRB05KT' WHEN event_id % 6 = 1 THEN '00000KT'
    ELSE lpad(CAST((event_id * 10) % 360 AS VARCHAR), 3, '0') || lpad(CAST(event_id % 30 AS VARCHAR), 2, '0') || CASE WHEN event_id % 4 = 0 THEN 'G35' ELSE '' END || 'KT' END AS raw FROM events),
parsed AS (SELECT *, regexp_extract(raw, '(\\d{{3}}|VRB)(\\d{{2,3}})(?:G\\d{{2,3}})?KT', 1) AS dd, CAST(regexp_extract(raw, '(\\d{{3}}|VRB)(\\d{{2,3}})(?:G\\d{{2,3}})?KT', 2) AS INTEGER) AS speed FROM winds),
wind AS (SELECT event_id, ident, raw, speed, CASE WHEN dd = 'VRB' OR (dd = '000' AND speed = 0) THEN NULL ELSE CAST(dd AS INTEGER) END AS direction FROM parsed)"""


def _winds(spark, sf):
    e = F.col("event_id")
    raw = F.when(e % 6 == 0, "VRB05KT").when(e % 6 == 1, "00000KT").otherwise(F.concat(
        F.lpad(((e * 10) % 360).cast("string"), 3, "0"), F.lpad((e % 30).cast("string"), 2, "0"), F.when(e % 4 == 0, "G35").otherwise(""), F.lit("KT")))
    w = t.table(spark, sf, "events").select("event_id", F.concat(F.lit("K"), F.char(65 + e % 25), F.lit("XX")).alias("ident"), raw.alias("raw"))
    return w.withColumn("w", weather.parse_wind("raw")).select("event_id", "ident", "raw", F.col("w.direction").alias("direction"), F.col("w.speed").alias("speed"))


@query("X14_parse_wind", WINDS + " SELECT event_id, raw, direction, speed FROM wind")
def parse_wind(spark, sf):
    return _winds(spark, sf).select("event_id", "raw", "direction", "speed")


@query("J14_wind_favored_runway", WINDS + """, e AS (SELECT ident, 0 AS k, le_ident AS runway, le_heading AS h FROM runways UNION ALL SELECT ident, 1, he_ident, he_heading FROM runways),
  c AS (SELECT event_id, w.ident, direction, runway, k, round(cos(radians(CASE WHEN abs(direction - h) > 180 THEN 360 - abs(direction - h) ELSE abs(direction - h) END)), 12) AS head
    FROM wind w JOIN e ON e.ident = w.ident WHERE direction IS NOT NULL AND h IS NOT NULL)
  SELECT event_id, ident, runway, round(head, 6) AS headwind FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY head DESC, k) = 1""")
def wind_favored(spark, sf):
    w = _winds(spark, sf).select("event_id", "ident", "direction")
    return airport.wind_favored(w, t.runways(spark, sf)).select("event_id", "ident", "runway", "headwind")


# Several runways per airport: parts are runways of the airport of their size.
@query("O6_longest_runway", """SELECT p_size AS ident, arg_max(p_partkey, p_retailprice * 1e6 - p_partkey) AS ordinal, CAST(max(CAST(p_retailprice AS BIGINT)) AS BIGINT) AS length_ft FROM (
  SELECT p_size, p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS p_retailprice FROM part) GROUP BY 1""")
def longest_runway(spark, sf):
    p = t.table(spark, sf, "part")
    r = p.select(F.col("p_size").alias("ident"), F.col("p_partkey").alias("ordinal"), F.floor("p_retailprice").alias("length_ft"),
                 F.lit("09").alias("le_ident"), F.lit("27").alias("he_ident"))
    return airport.longest_runway(r).select("ident", "ordinal", "length_ft")


@query("J9_nearest_airport_per_tile", f"""WITH {t.POSITIONS_SQL}, {t.AIRPORTS_SQL}, w AS (
  SELECT DISTINCT CAST(floor((lon + 180.0) / 360.0 * 2048) AS BIGINT) AS tx, CAST(floor((1.0 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2.0 * 2048) AS BIGINT) AS ty FROM positions),
  c AS (SELECT tx, ty, (degrees(atan(sinh(pi() * (1 - 2.0 * ty / 2048)))) + degrees(atan(sinh(pi() * (1 - 2.0 * (ty + 1) / 2048))))) / 2 AS clat, ((tx / 2048.0 * 360 - 180) + ((tx + 1) / 2048.0 * 360 - 180)) / 2 AS clon FROM w)
  SELECT tx, ty, ident, elev FROM (SELECT tx, ty, a.ident, a.elev, row_number() OVER (PARTITION BY tx, ty ORDER BY pow(clat - a.lat, 2) + pow(clon - a.lon, 2), a.ordinal) AS r FROM c, airports a) WHERE r = 1""")
def nearest_airport(spark, sf):
    from ..functions import tiles
    from ..operators import density

    w = t.positions(spark, sf).withColumn("_t", tiles.tile_pixel("lat", "lon", F.lit(11.0))).select(F.col("_t.tx").alias("tx"), F.col("_t.ty").alias("ty")).distinct()
    return density.tile_elevations(w, t.airports(spark, sf), 11)


@query("J8_airports_near_report", f"WITH {SHARD} SELECT seq, icao AS ident, round(d, 6) AS distance_nm FROM sharded WHERE d <= 5")
def airports_near(spark, sf):
    out = nearest_airports(t.positions(spark, sf), t.airports(spark, sf), ["seq"])
    return out.select("seq", "ident", F.round("distance_nm", 6).alias("distance_nm"))
