"""Proximity and loss-of-separation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import los, proximity, sequence
from ..session import stage
from . import tables as t
from .q_sequence import PERTURBED, perturbed_steps
from .registry import query


def _steps(spark, sf):
    return sequence.flight_steps(sequence.prefilter(t.positions(spark, sf)), carry=["category"])


def _hits(spark, sf):
    return proximity.near_pairs(proximity.track_pieces(_steps(spark, sf)), los.LATERAL_NM, los.VERTICAL_FT)


def _events(spark, sf):
    steps = stage(_steps(spark, sf), "steps")
    hits = proximity.near_pairs(proximity.track_pieces(steps), los.LATERAL_NM, los.VERTICAL_FT)
    return steps, stage(los.event_rows(stage(los.sessions(stage(hits, "pairs")), "hits")), "events")


@query("J2_resampled_proximity", f"""WITH {t.hits_sql()} SELECT sec, tail1, tail2, flight_id1, flight_id2, round(lateral_nm, 6) AS lateral_nm, alt_sep_ft FROM hits""")
def resampled_proximity(spark, sf):
    return _hits(spark, sf).select("sec", "tail1", "tail2", "flight_id1", "flight_id2", F.round("lateral_nm", 6).alias("lateral_nm"), "alt_sep_ft")


@query("W16_los_sessions", f"""WITH {t.SESSIONS_SQL} SELECT tail1, tail2, event_no, min(sec) AS first_sec, max(sec) AS last_sec, count(*) AS hits FROM event_hits GROUP BY 1, 2, 3""")
def los_sessions(spark, sf):
    return los.sessions(stage(_hits(spark, sf), "pairs")).groupBy("tail1", "tail2", "event_no").agg(
        F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), F.count(F.lit(1)).alias("hits"))


CPA = f"""WITH RECURSIVE {t.SESSIONS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY tail1, tail2, event_no ORDER BY sec) AS i FROM event_hits),
walk AS (
  SELECT tail1, tail2, event_no, i, sec, lateral_nm AS m_lat, alt_sep_ft AS m_alt, sec AS cpa FROM r WHERE i = 1
  UNION ALL
  SELECT r.tail1, r.tail2, r.event_no, r.i, r.sec,
    CASE WHEN r.lateral_nm < w.m_lat OR r.alt_sep_ft < w.m_alt THEN r.lateral_nm ELSE w.m_lat END,
    CASE WHEN r.lateral_nm < w.m_lat OR r.alt_sep_ft < w.m_alt THEN r.alt_sep_ft ELSE w.m_alt END,
    CASE WHEN r.lateral_nm < w.m_lat OR r.alt_sep_ft < w.m_alt THEN r.sec ELSE w.cpa END
  FROM walk w JOIN r ON r.tail1 = w.tail1 AND r.tail2 = w.tail2 AND r.event_no = w.event_no AND r.i = w.i + 1),
cpas AS (SELECT tail1, tail2, event_no, arg_max(cpa, i) AS cpa_sec, arg_max(m_lat, i) AS m_lat, arg_max(m_alt, i) AS m_alt,
  min(sec) AS first_sec, max(sec) AS last_sec, max(i) AS hits FROM walk GROUP BY 1, 2, 3)"""


@query("W17_closest_approach", CPA + """ SELECT tail1, tail2, event_no, CAST(cpa_sec AS DOUBLE) AS cpa_time, round(m_lat, 6) AS lateral_nm, m_alt AS alt_sep_ft,
  CAST(last_sec - first_sec AS DOUBLE) AS duration_s, hits FROM cpas""")
def closest_approach(spark, sf):
    events = los.event_rows(stage(los.sessions(stage(_hits(spark, sf), "pairs")), "hits"))
    return events.select("tail1", "tail2", "event_no", "cpa_time", F.round("lateral_nm", 6).alias("lateral_nm"), "alt_sep_ft", "duration_s", "hits")


EVENTS = CPA + """, events0 AS (
  SELECT c.tail1, c.tail2, c.event_no, CAST(c.first_sec AS DOUBLE) AS create_time, CAST(c.last_sec AS DOUBLE) AS last_time, CAST(c.cpa_sec AS DOUBLE) AS cpa_time,
    c.m_lat AS lateral_nm, c.m_alt AS alt_sep_ft, CAST(c.last_sec - c.first_sec AS DOUBLE) AS duration_s,
    h.flight_id1, h.flight_id2, (h.lat1 + h.lat2) / 2 AS lat, (h.lon1 + h.lon2) / 2 AS lon, CAST(trunc((h.alt1 + h.alt2) / 2) AS BIGINT) AS alt_ft
  FROM cpas c JOIN event_hits h ON h.tail1 = c.tail1 AND h.tail2 = c.tail2 AND h.sec = c.cpa_sec)"""
H = t.haversine_sql
FEATURES = EVENTS + f""", spans AS (
  SELECT flight_id, min(now) AS start, max(now) AS stop, arg_max(category, now) AS category FROM steps GROUP BY 1),
tele AS (
  SELECT flight_id, arg_min(kt, now) AS kt, arg_min(n1, now) AS t0, min(now) AS t1 FROM (
    SELECT flight_id, now, n1, {H('lat_1', 'lon_1', 'lat', 'lon')} / ((now - n1) / 3600.0) AS kt FROM steps WHERE now - n1 <= 60 AND now - n1 > 5)
  WHERE kt > 300 GROUP BY 1),
counts AS (
  SELECT tail1, tail2, event_no, {', '.join(f'''
    (SELECT count(*) FROM steps s WHERE s.flight_id = e.flight_id{i} AND abs(s.now - e.cpa_time) <= 10 AND {H('s.lat', 's.lon', 'e.lat', 'e.lon')} <= 0.5) AS near{i},
    (SELECT count(*) FROM steps s WHERE s.flight_id = e.flight_id{i} AND s.now BETWEEN e.create_time AND e.last_time) AS during{i}''' for i in (1, 2))}
  FROM events0 e),
starts AS (
  SELECT e.tail1, e.tail2, e.event_no, e.flight_id1, e.flight_id2, greatest(a.start, b.start, e.cpa_time - 120) AS t0
  FROM events0 e JOIN spans a ON a.flight_id = e.flight_id1 JOIN spans b ON b.flight_id = e.flight_id2),
near_start AS (
  SELECT e.tail1, e.tail2, e.event_no, i AS side, arg_min(s.lat, abs(s.now - t0) * 1e9 + s.now - {t.EPOCH0}) AS lat, arg_min(s.lon, abs(s.now - t0) * 1e9 + s.now - {t.EPOCH0}) AS lon
  FROM starts e, (VALUES (1), (2)) v(i), steps s
  WHERE s.flight_id = CASE WHEN i = 1 THEN flight_id1 ELSE flight_id2 END AND abs(s.now - t0) <= 5 GROUP BY 1, 2, 3, 4),
sep AS (
  SELECT a.tail1, a.tail2, a.event_no, {H('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS initial_sep_nm
  FROM near_start a JOIN near_start b ON a.side = 1 AND b.side = 2 AND a.tail1 = b.tail1 AND a.tail2 = b.tail2 AND a.event_no = b.event_no),
fpairs AS (SELECT DISTINCT flight_id1, flight_id2 FROM events0),
matched AS (
  SELECT p.flight_id1, p.flight_id2, a.now, arg_min(b.lat, abs(b.now - a.now) * 10 - (CASE WHEN b.now >= a.now THEN 1 ELSE 0 END)) AS blat,
    arg_min(b.lon, abs(b.now - a.now) * 10 - (CASE WHEN b.now >= a.now THEN 1 ELSE 0 END)) AS blon, any_value(a.lat) AS alat, any_value(a.lon) AS alon
  FROM fpairs p JOIN steps a ON a.flight_id = p.flight_id1 JOIN steps b ON b.flight_id = p.flight_id2 AND abs(b.now - a.now) <= 5 GROUP BY 1, 2, 3),
ratios AS (
  SELECT flight_id1, flight_id2, count(*) AS paired, count(*) FILTER (WHERE {H('alat', 'alon', 'blat', 'blon')} <= 0.6) / count(*) AS close_ratio FROM matched GROUP BY 1, 2),
feats AS (
  SELECT e.*, coalesce(c.near1, 0) AS near1, coalesce(c.near2, 0) AS near2, c.during1, c.during2, s.initial_sep_nm, r.paired, r.close_ratio,
    a.start AS start1, a.stop AS stop1, a.category AS category1, b.start AS start2, b.stop AS stop2, b.category AS category2,
    t1.kt AS kt1, t2.kt AS kt2, least(a.stop, e.last_time + 61) - a.start AS track_s1, least(b.stop, e.last_time + 61) - b.start AS track_s2
  FROM events0 e JOIN counts c USING (tail1, tail2, event_no) LEFT JOIN sep s USING (tail1, tail2, event_no)
    LEFT JOIN ratios r USING (flight_id1, flight_id2) JOIN spans a ON a.flight_id = e.flight_id1 JOIN spans b ON b.flight_id = e.flight_id2
    LEFT JOIN tele t1 ON t1.flight_id = e.flight_id1 LEFT JOIN tele t2 ON t2.flight_id = e.flight_id2),
base AS (
  SELECT *, (initial_sep_nm IS NULL OR initial_sep_nm <= 1) AS formation,
    CASE WHEN duration_s > 90 AND (initial_sep_nm IS NULL OR initial_sep_nm <= 1) THEN 'low' WHEN duration_s > 90 THEN 'medium'
      WHEN category1 = 'A7' OR category2 = 'A7' THEN 'low' WHEN least(track_s1, track_s2) < 60 THEN 'low' WHEN duration_s > 30 THEN 'medium'
      WHEN lateral_nm < 0.2 AND alt_sep_ft < 200 THEN 'vhigh' ELSE 'high' END AS q0 FROM feats),
sane AS (SELECT *, CASE WHEN near1 = 0 OR near2 = 0 THEN 'low' ELSE q0 END AS q1 FROM base),
dense AS (SELECT *, CASE WHEN q1 IN ('high', 'vhigh') AND duration_s > 5 AND least(during1, during2) / duration_s < 0.1 THEN 'medium' ELSE q1 END AS q2 FROM sane),
scored AS (SELECT *, CASE WHEN kt1 IS NOT NULL OR kt2 IS NOT NULL OR (formation AND close_ratio >= 0.5)
  OR stop1 < create_time OR stop2 < create_time THEN 'low' ELSE q2 END AS quality FROM dense)"""


@query("W18_event_teleport", f"""WITH {PERTURBED}, bad AS (
  SELECT flight_id, now, n1, {H('lat_1', 'lon_1', 'lat', 'lon')} / ((now - n1) / 3600.0) AS kt FROM steps WHERE now - n1 <= 60 AND now - n1 > 5)
  SELECT flight_id, min(now) AS at, round(arg_min(kt, now), 3) AS speed_kt FROM bad WHERE kt > 300 GROUP BY 1""")
def event_teleport(spark, sf):
    spans = los.flight_summary(perturbed_steps(spark, sf)).where("teleport IS NOT NULL")
    return spans.select("flight_id", F.col("teleport.now").alias("at"), F.round("teleport.kt", 3).alias("speed_kt"))


@query("W19_window_counts", FEATURES + " SELECT tail1, tail2, event_no, near1, near2, coalesce(during1, 0) AS during1, coalesce(during2, 0) AS during2 FROM feats")
def window_counts(spark, sf):
    steps, events = _events(spark, sf)
    got = events.select("tail1", "tail2", "event_no").join(los.window_counts(events, steps), los.EVENT_KEYS, "left").fillna(0, ["near1", "near2", "during1", "during2"])
    return got.select("tail1", "tail2", "event_no", "near1", "near2", "during1", "during2")


@query("W20_initial_separation", FEATURES + " SELECT tail1, tail2, event_no, round(initial_sep_nm, 6) AS initial_sep_nm FROM feats WHERE initial_sep_nm IS NOT NULL")
def initial_separation(spark, sf):
    steps, events = _events(spark, sf)
    out = los.initial_separation(events, steps, los.flight_summary(steps)).where("initial_sep_nm IS NOT NULL")
    return out.select("tail1", "tail2", "event_no", F.round("initial_sep_nm", 6).alias("initial_sep_nm"))


@query("J10_nearest_in_time", FEATURES + " SELECT flight_id1, flight_id2, paired, round(close_ratio, 6) AS close_ratio FROM ratios")
def nearest_in_time(spark, sf):
    steps, events = _events(spark, sf)
    out = los.proximity_ratio(events, steps, los.flight_summary(steps))
    return out.select("flight_id1", "flight_id2", "paired", F.round("close_ratio", 6).alias("close_ratio"))


@query("J10_asof_users", """SELECT a.event_id, arg_min(b.event_id, abs(epoch_us(b.ts) - epoch_us(a.ts)) * 10 - (CASE WHEN b.ts >= a.ts THEN 1 ELSE 0 END)) AS nearest
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 43200000000 GROUP BY 1""")
def asof_users(spark, sf):
    e = t.table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).select("event_id", "user_id", "event_type", "us")
    a = e.where("event_type = 'click'").drop("event_type")
    b = e.where("event_type = 'purchase'").select("user_id", "us", "event_id", F.col("event_id").alias("other"))
    out = proximity.nearest_in_time(a, b, ["user_id"], "us", ["other"], ["event_id"], tolerance=43200.0, width=86400.0)
    return out.where("b_us IS NOT NULL").select("event_id", F.col("b_other").alias("nearest"))


@query("W24_track_duration", FEATURES + " SELECT tail1, tail2, event_no, track_s1, track_s2 FROM feats")
def track_duration(spark, sf):
    steps, events = _events(spark, sf)
    return los.features(events, steps).select("tail1", "tail2", "event_no", "track_s1", "track_s2")


@query("W21_event_quality", FEATURES + """ SELECT tail1, tail2, event_no, cpa_time, round(lateral_nm, 6) AS lateral_nm, alt_sep_ft, duration_s, alt_ft, quality FROM scored""")
def event_quality(spark, sf):
    steps, events = _events(spark, sf)
    out = los.score(los.features(events, steps))
    return out.select("tail1", "tail2", "event_no", "cpa_time", F.round("lateral_nm", 6).alias("lateral_nm"), "alt_sep_ft", "duration_s", "alt_ft", "quality")


@query("W22_event_tracks", EVENTS + f""", m AS (
  SELECT tail1, tail2, event_no, i AS side, CASE WHEN i = 1 THEN flight_id1 ELSE flight_id2 END AS flight_id, CAST(cpa_time AS BIGINT) AS c FROM events0, (VALUES (1), (2)) v(i))
  SELECT tail1, tail2, event_no, side, r.sec, round(r.lat, 6) AS lat, round(r.lon, 6) AS lon, CAST(r.alt_baro AS BIGINT) AS alt_ft, CAST(r.resampled AS INTEGER) AS resampled
  FROM m JOIN resampled r ON r.flight_id = m.flight_id AND r.sec BETWEEN c - 120 AND c + 60""")
def event_tracks(spark, sf):
    """Every point of both tracks of every event."""
    steps, events = _events(spark, sf)
    out = los.tracks(events, sequence.resample(los.steps_near(events, steps)))
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"track{i}").alias("track")) for i in (1, 2)])).alias("s")
    points = out.select(*los.EVENT_KEYS, sides).select(*los.EVENT_KEYS, "s.side", F.explode("s.track").alias("p"))
    return points.select(*los.EVENT_KEYS, "side", F.col("p.t").alias("sec"), F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"),
                         F.col("p.alt_ft").cast("bigint").alias("alt_ft"), F.col("p.resampled").alias("resampled"))


# Raw reports held for up to five seconds, checked at every whole second.
HELD = f"""WITH {t.POSITIONS_SQL}, nexted AS (SELECT *, lead(now) OVER (PARTITION BY tail ORDER BY now, seq) AS nx FROM positions),
held AS (SELECT unnest(range(CAST(now AS BIGINT), CAST(least(now + 5, coalesce(nx - 1, now + 5)) AS BIGINT) + 1)) AS sec, * FROM nexted),
near AS (SELECT * FROM (SELECT a.sec, a.tail AS tail1, b.tail AS tail2, a.now AS now1, b.now AS now2, a.seq AS seq1, b.seq AS seq2, a.alt_baro AS alt1, b.alt_baro AS alt2,
  {H('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS lateral_nm FROM held a JOIN held b ON a.sec = b.sec AND a.tail <> b.tail AND abs(a.alt_baro - b.alt_baro) < 600) WHERE lateral_nm < 1.5)"""


def _held(spark, sf):
    steps = sequence.flight_steps(t.positions(spark, sf))
    return proximity.near_pairs(proximity.track_pieces(steps, hold=5, interpolate=False), 1.5, 600.0)


@query("J1_proximity_all_pairs", HELD + " SELECT sec, tail1, tail2, seq1, seq2, round(lateral_nm, 6) AS lateral_nm FROM near WHERE tail1 < tail2")
def proximity_all(spark, sf):
    return _held(spark, sf).select("sec", "tail1", "tail2", "seq1", "seq2", F.round("lateral_nm", 6).alias("lateral_nm"))


@query("J1_proximity_first_only", HELD + """, ruled AS (SELECT sec, tail1, arg_min(tail2, now2) AS tail2, arg_min(alt2, now2) AS alt2, arg_min(lateral_nm, now2) AS lateral_nm
  FROM near WHERE alt1 >= 1200 GROUP BY 1, 2) SELECT sec, tail1, tail2, round(lateral_nm, 6) AS lateral_nm FROM ruled WHERE alt2 >= 1200""")
def proximity_first(spark, sf):
    rows = proximity.directed(_held(spark, sf))
    out = proximity.first_neighbour(rows, F.col("alt_baro1") >= 1200, F.col("alt_baro2") >= 1200)
    return out.select("sec", "tail1", "tail2", F.round("lateral_nm", 6).alias("lateral_nm"))


@query("T8_stale_pairs", HELD + " SELECT sec, tail1, tail2 FROM near WHERE tail1 < tail2 AND abs(now1 - now2) > 3")
def stale_pairs(spark, sf):
    return _held(spark, sf).where(F.abs(F.col("now1") - F.col("now2")) > 3).select("sec", "tail1", "tail2")


@query("T9_hold_freshness", HELD.split(",\nnear AS")[0] + " SELECT tail, count(*) AS held_seconds, min(sec) AS first_sec, max(sec) AS last_sec FROM held GROUP BY 1")
def hold_freshness(spark, sf):
    pieces = proximity.track_pieces(sequence.flight_steps(t.positions(spark, sf)), hold=5, interpolate=False)
    return pieces.groupBy("tail").agg(F.sum(F.col("s1") - F.col("s0") + 1).alias("held_seconds"), F.min("s0").alias("first_sec"), F.max("s1").alias("last_sec"))


EVENT_AIRPORTS = EVENTS.replace("WITH RECURSIVE ", "WITH RECURSIVE " + t.AIRPORTS_SQL + ", ", 1) + f""", near AS (
  SELECT * FROM (SELECT e.*, p.ident, p.ordinal, p.elev, {t.equirect_sql('p.lat', 'p.lon', 'e.lat', 'e.lon')} AS d FROM events0 e, airports p) WHERE d <= 5)"""


@query("J8_airports_near_event", EVENT_AIRPORTS + " SELECT tail1, tail2, event_no, ident, round(d, 6) AS distance_nm FROM near")
def airports_near_event(spark, sf):
    _, events = _events(spark, sf)
    out = los.nearest_airports(events, t.airports(spark, sf), los.EVENT_KEYS)
    return out.select(*los.EVENT_KEYS, "ident", F.round("distance_nm", 6).alias("distance_nm"))


@query("F26_airborne_events", EVENT_AIRPORTS + """, decided AS (SELECT tail1, tail2, event_no, arg_min(elev, ordinal) AS elev FROM near GROUP BY 1, 2, 3)
  SELECT e.tail1, e.tail2, e.event_no, e.alt_ft FROM events0 e LEFT JOIN decided d USING (tail1, tail2, event_no) WHERE e.alt_ft > coalesce(d.elev + 200, 50)""")
def airborne_events(spark, sf):
    _, events = _events(spark, sf)
    return los.airborne(events, t.airports(spark, sf)).select(*los.EVENT_KEYS, "alt_ft")


BAND = "CASE WHEN alt_ft < 0 THEN '18k+' WHEN alt_ft < 3000 THEN '0k-3k' WHEN alt_ft < 6000 THEN '3k-6k' WHEN alt_ft < 10000 THEN '6k-10k' WHEN alt_ft < 18001 THEN '10k-18k' ELSE '18k+' END"
EVENT_TABLE = FEATURES.replace("WITH RECURSIVE ", "WITH RECURSIVE " + t.AIRPORTS_SQL + ", ", 1) + f""", decided AS (SELECT tail1, tail2, event_no, arg_min(elev, ordinal) AS elev FROM (
    SELECT e.tail1, e.tail2, e.event_no, p.ordinal, p.elev, {t.equirect_sql('p.lat', 'p.lon', 'e.lat', 'e.lon')} AS d FROM events0 e, airports p) WHERE d <= 5 GROUP BY 1, 2, 3)
  SELECT cpa_time AS timestamp, strftime(make_timestamp(CAST(cpa_time AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS datetime_utc, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon, alt_ft, {BAND} AS alt_band,
    tail1 AS flight1, tail2 AS flight2, round(lateral_nm, 6) AS lateral_nm, alt_sep_ft, duration_s, quality FROM scored s LEFT JOIN decided d USING (tail1, tail2, event_no) WHERE alt_ft > coalesce(d.elev + 200, 50)"""


@query("D12_los_event_table", EVENT_TABLE)
def los_event_table(spark, sf):
    out = los.los_events(t.positions(spark, sf), t.airports(spark, sf), hold=0)
    rounded = {c: F.round(c, 6) for c in ("lat", "lon", "lateral_nm")}
    return out.withColumns(rounded).drop("quality_explanation", "animation_path", "track1", "track2")
