"""Profiles, counts, joins, sets and bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import los, tables_ops as ops
from ..operators.timeline import running
from . import tables as t
from .registry import query

P = t.POSITIONS_SQL


@query("A8_dataset_profile", f"""WITH {P}, q AS (SELECT * REPLACE (CASE WHEN seq % 13 = 0 THEN NULL ELSE lat END AS lat, CASE WHEN seq % 17 = 0 THEN NULL ELSE alt_baro END AS alt_baro) FROM positions),
  per AS (SELECT hex, count(*) AS pts, max(now) - min(now) AS dur FROM q GROUP BY 1)
  SELECT (SELECT count(*) FROM q) AS points, (SELECT count(*) FROM per) AS aircraft, (SELECT count(*) FROM (SELECT DISTINCT hex, flight FROM q)) AS callsigns,
    (SELECT median(pts) FROM per) AS median_pts, (SELECT median(dur) FROM per WHERE dur > 0) AS median_dur, (SELECT median(alt_baro) FROM q WHERE NOT on_ground) AS median_alt,
    count(*) FILTER (WHERE lat IS NULL OR lon IS NULL) AS no_position, count(*) FILTER (WHERE on_ground) AS ground_reports, count(*) FILTER (WHERE NOT on_ground AND alt_baro IS NULL) AS no_altitude,
    round(avg(lat), 6) AS center_lat, round(avg(lon) FILTER (WHERE lat IS NOT NULL), 6) AS center_lon, round((max(lat) - min(lat)) * 60, 4) AS height_nm,
    round((max(lon) FILTER (WHERE lat IS NOT NULL) - min(lon) FILTER (WHERE lat IS NOT NULL)) * 60 * cos(radians((max(lat) + min(lat)) / 2)), 4) AS width_nm, round(avg(alt_baro) FILTER (WHERE NOT on_ground), 4) AS mean_alt FROM q""")
def dataset_profile(spark, sf):
    p = t.positions(spark, sf).withColumn("lat", F.when(F.col("seq") % 13 != 0, F.col("lat"))).withColumn("alt_baro", F.when(F.col("seq") % 17 != 0, F.col("alt_baro")))
    out = ops.dataset_profile(p)
    return out.select("points", "aircraft", "callsigns", "median_pts", "median_dur", "median_alt", "no_position", "ground_reports", "no_altitude",
                      *[F.round(c, 6).alias(c) for c in ("center_lat", "center_lon")], *[F.round(c, 4).alias(c) for c in ("height_nm", "width_nm", "mean_alt")])


@query("A9_tail_histogram", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
  top AS (SELECT user_id, event_type AS category FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
  SELECT e.user_id, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS points, min('CS' || (event_id % 9)) AS callsign, any_value(category) AS category
  FROM events e JOIN top ON top.user_id = e.user_id GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= 25""")
def tail_histogram(spark, sf):
    e = t.table(spark, sf, "events").withColumn("flight", F.concat(F.lit("CS"), (F.col("event_id") % 9).cast("string")))
    return ops.tail_histogram(e, "user_id", F.to_date("ts"), "flight", "event_type", 25)


@query("A10_points_per_hour", "SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def points_per_hour(spark, sf):
    return ops.counts_by(t.table(spark, sf, "events"), date=F.to_date("ts"), hour=F.hour("ts"))


# Rows of events read as scored events of airports: type is the quality, value the distance.
SCORED = """scored AS (SELECT 'K' || chr(CAST(65 + user_id % 25 AS INTEGER)) || 'XX' AS icao, CAST(ts AS DATE) AS date, value / 10 AS distance_nm, event_id,
  CASE event_type WHEN 'click' THEN 'low' WHEN 'view' THEN 'medium' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'vhigh' ELSE 'high' END AS quality FROM events)"""


def _scored(spark, sf):
    k = F.col("event_type")
    return t.table(spark, sf, "events").select(
        F.concat(F.lit("K"), F.char(65 + F.col("user_id") % 25), F.lit("XX")).alias("icao"), F.to_date("ts").alias("date"), (F.col("value") / 10).alias("distance_nm"), "event_id",
        F.when(k == "click", "low").when(k == "view", "medium").when(k == "purchase", "high").when(k == "signup", "vhigh").otherwise("high").alias("quality"))


@query("A11_event_stats", f"WITH {SCORED}, s AS (SELECT icao, count(*) AS total_events, count(*) FILTER (WHERE quality IN ('medium', 'high') AND distance_nm <= 5) AS near_medhigh, count(DISTINCT date) AS days FROM scored GROUP BY 1) SELECT *, round(near_medhigh / days, 2) AS events_per_day FROM s")
def event_stats(spark, sf):
    return ops.event_stats(_scored(spark, sf))


@query("A12_under_covered", f"WITH {SCORED}, {t.AIRPORTS_SQL} SELECT a.ident AS icao, count(s.icao) AS n FROM airports a LEFT JOIN scored s ON s.icao = a.ident AND s.quality = 'high' AND s.distance_nm <= 1 GROUP BY 1 HAVING count(s.icao) < 100")
def under_covered(spark, sf):
    s = _scored(spark, sf).where("quality = 'high' AND distance_nm <= 1")
    return ops.under_covered(s, t.airports(spark, sf).withColumnRenamed("ident", "icao"), 100)


@query("A13_quality_distribution", f"WITH {SCORED} SELECT quality, count(*) AS n FROM scored GROUP BY 1")
def quality_distribution(spark, sf):
    return ops.counts_by(_scored(spark, sf), quality=F.col("quality"))


@query("F28_event_eligibility", f"WITH {SCORED} SELECT icao, count(*) AS n FROM scored WHERE NOT contains('e' || event_id || ',' || quality, 'low') AND NOT contains('e' || event_id || ',' || quality, 'e77') AND distance_nm <= 4 GROUP BY 1")
def event_eligibility(spark, sf):
    s = _scored(spark, sf).withColumn("line", F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(","), "quality"))
    return ops.eligible_events(s, ["low", "e77"], radius_nm=4.0).groupBy("icao").agg(F.count(F.lit(1)).alias("n"))


# One state per (date, one-degree cell of the user); some cells never appear.
STATUS = """status AS (SELECT CAST(ts AS DATE) AS date, 36 + user_id % 5 AS cell_lat, -122 + (user_id // 5) % 6 AS cell_lon,
  CASE WHEN max(value) > 60 THEN 'ok' WHEN max(value) > 30 THEN 'empty' ELSE 'bad' END AS state FROM events WHERE user_id % 7 <> 3 GROUP BY ALL),
excl AS (SELECT DISTINCT 36 + n_nationkey % 5 AS cell_lat, -122 + n_nationkey % 6 AS cell_lon, DATE '2024-01-05' + CAST(n_nationkey AS INTEGER) AS start, DATE '2024-01-08' + CAST(n_nationkey AS INTEGER) AS stop FROM nation)"""


def _status(spark, sf):
    u = F.col("user_id")
    e = t.table(spark, sf, "events").where(u % 7 != 3)
    top = F.max("value")
    return e.groupBy(F.to_date("ts").alias("date"), (36 + u % 5).alias("cell_lat"), (-122 + F.floor(u / 5) % 6).alias("cell_lon")).agg(
        F.when(top > 60, "ok").when(top > 30, "empty").otherwise("bad").alias("state"))


def _exclusions(spark, sf):
    k = F.col("n_nationkey").cast("bigint")
    start = F.date_add(F.lit("2024-01-05").cast("date"), k.cast("int"))
    return t.table(spark, sf, "nation").select((36 + k % 5).alias("cell_lat"), (-122 + k % 6).alias("cell_lon"), start.alias("start"), F.date_add(start, 3).alias("stop"))


@query("A16_completeness", f"""WITH {STATUS}, days AS (SELECT DISTINCT date FROM status), cells AS (SELECT date, la AS cell_lat, lo AS cell_lon FROM days, range(36, 42) a(la), range(-122, -116) b(lo)),
  j AS (SELECT c.*, s.state, EXISTS (SELECT 1 FROM excl x WHERE x.cell_lat = c.cell_lat AND x.cell_lon = c.cell_lon AND c.date BETWEEN x.start AND x.stop) AS ex
    FROM cells c LEFT JOIN status s ON s.date = c.date AND s.cell_lat = c.cell_lat AND s.cell_lon = c.cell_lon)
  SELECT date, count(*) FILTER (WHERE NOT ex) AS expected, count(*) FILTER (WHERE NOT ex AND state = 'ok') AS present, count(*) FILTER (WHERE NOT ex AND state = 'empty') AS empty,
    count(*) FILTER (WHERE ex) AS excluded, count(*) FILTER (WHERE NOT ex AND coalesce(state, 'bad') = 'bad') AS missing FROM j GROUP BY 1""")
def completeness(spark, sf):
    s = _status(spark, sf)
    return ops.completeness(s, s, (36, 42, -122, -116), _exclusions(spark, sf))


@query("F27_exclusion_windows", f"WITH {STATUS} SELECT date, cell_lat, cell_lon, state FROM status s WHERE NOT EXISTS (SELECT 1 FROM excl x WHERE x.cell_lat = s.cell_lat AND x.cell_lon = s.cell_lon AND s.date BETWEEN x.start AND x.stop)")
def exclusion_windows(spark, sf):
    return ops.with_exclusions(_status(spark, sf), _exclusions(spark, sf)).where(~F.col("excluded")).select("date", "cell_lat", "cell_lon", "state")


MANIFEST = """manifest AS (SELECT CAST(ts AS DATE) AS date, user_id % 40 AS cell, 'sha' || max(CASE WHEN value > 50 THEN event_id % 3 ELSE 0 END) AS git_sha, bool_or(value > 200) AS git_dirty FROM events GROUP BY 1, 2)"""


def _manifest(spark, sf):
    return t.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date"), (F.col("user_id") % 40).alias("cell")).agg(
        F.concat(F.lit("sha"), F.max(F.when(F.col("value") > 50, F.col("event_id") % 3).otherwise(0)).cast("string")).alias("git_sha"), F.bool_or(F.col("value") > 200).alias("git_dirty"))


@query("A17_provenance_mix", f"WITH {MANIFEST} SELECT date, count(*) AS cells, count(DISTINCT git_sha) AS versions, count(*) FILTER (WHERE git_dirty) AS dirty, count(DISTINCT git_sha) > 1 AS mixed FROM manifest GROUP BY 1")
def provenance_mix(spark, sf):
    return ops.provenance_mix(_manifest(spark, sf))


@query("K15_manifest_merge", f"WITH {MANIFEST}, nw AS (SELECT date, cell, 'new' AS git_sha, false AS git_dirty FROM manifest WHERE git_dirty AND cell % 3 = 1) SELECT * FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.date = m.date AND nw.cell = m.cell) UNION ALL SELECT * FROM nw")
def manifest_merge(spark, sf):
    m = _manifest(spark, sf)
    new = m.where("git_dirty AND cell % 3 = 1").select("date", "cell", F.lit("new").alias("git_sha"), F.lit(False).alias("git_dirty"))
    return ops.upsert(m, new, ["date", "cell"])


RUNS = """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events), g AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS isl FROM d),
  r AS (SELECT user_id, isl, count(*) AS n, min(date) AS start, max(date) AS stop FROM g GROUP BY 1, 2), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, start DESC) = 1)"""


@query("A18_contiguous_run", RUNS + """, o AS (SELECT user_id, n AS days, start, stop, CAST(total - n AS BIGINT) AS other_days FROM b) SELECT *, CASE WHEN days = 1 AND other_days = 0 THEN strftime(start, '%-m/%-d/%y')
  ELSE strftime(start, '%-m/%-d/%y') || ' - ' || strftime(stop, '%-m/%-d/%y') || CASE WHEN other_days = 0 THEN '' ELSE ' + ' || other_days || ' other date' || CASE WHEN other_days > 1 THEN 's' ELSE '' END END END AS label FROM o""")
def contiguous_run(spark, sf):
    return ops.contiguous_run(t.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date")), ["user_id"])


@query("A19_region_summary", f"WITH {P} SELECT count(*) AS n, " + ", ".join(
    f"round({f}({c}), 6) AS {n}_{c}" for c in ("lat", "lon") for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_pop"))) + " FROM positions")
def region_summary(spark, sf):
    out = ops.region_summary(t.positions(spark, sf))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query("A20_run_statistics", """WITH d AS (SELECT CAST(ts AS DATE) AS date, user_id % 20 AS part, count(*) AS records, CAST(sum(event_id % 7) AS BIGINT) AS seconds FROM events GROUP BY 1, 2)
  SELECT date, count(*) AS parts, CAST(sum(records) AS BIGINT) AS records, CAST(sum(seconds) AS BIGINT) AS seconds, round(avg(records), 4) AS mean_records FROM d GROUP BY ROLLUP (date)""")
def run_statistics(spark, sf):
    d = t.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date"), (F.col("user_id") % 20).alias("part")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col("event_id") % 7).alias("seconds"))
    return ops.run_statistics(d)


DAYS = """d AS (SELECT CAST(ts AS DATE) AS date, CAST(sum(event_id % 50) AS BIGINT) AS shard_kb, CAST(CASE WHEN day(ts) % 4 = 0 THEN 0 ELSE 60 + day(ts) END AS BIGINT) AS shard_s,
  CAST(sum(event_id % 7) AS BIGINT) AS analyze_s, count(*) AS events, CAST(max(CASE WHEN user_id = 7 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY 1, day(ts)),
t AS (SELECT count(*) AS days, count(*) FILTER (WHERE shard_s = 0 AND errors = 0) AS skipped, CAST(sum(shard_kb) AS BIGINT) AS total_shard_kb, CAST(sum(shard_s) AS BIGINT) AS total_shard_s,
  CAST(sum(analyze_s) AS BIGINT) AS total_analyze_s, CAST(sum(events) AS BIGINT) AS total_events, CAST(sum(errors) AS BIGINT) AS total_errors FROM d),
m AS (SELECT *, CASE WHEN skipped < days THEN total_shard_s / (days - skipped) ELSE 90.0 END AS measured, total_analyze_s / days / 12 AS ac, total_shard_kb / days / 12 AS kc, total_events / days / 12 AS ec FROM t)"""


def _totals(spark, sf):
    day = F.dayofmonth("ts")
    d = t.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date"), day.alias("_d")).agg(
        F.sum(F.col("event_id") % 50).alias("shard_kb"), F.first(F.when(day % 4 == 0, 0).otherwise(60 + day)).cast("long").alias("shard_s"),
        F.sum(F.col("event_id") % 7).alias("analyze_s"), F.count(F.lit(1)).alias("events"), F.max(F.when(F.col("user_id") == 7, 1).otherwise(0)).cast("long").alias("errors"))
    return ops.pipeline_totals(d.drop("_d"), cells=12)


@query("A20_pipeline_totals", f"""WITH {DAYS} SELECT days, skipped, total_shard_kb, total_shard_s, total_analyze_s, total_events, total_errors, round(measured, 4) AS measured_shard_s,
  round(ac, 4) AS analyze_s_per_cell, round(kc, 4) AS shard_kb_per_cell, round(ec, 4) AS events_per_cell FROM m""")
def pipeline_totals(spark, sf):
    rates = ("measured_shard_s", "analyze_s_per_cell", "shard_kb_per_cell", "events_per_cell")
    return _totals(spark, sf).select("days", "skipped", *[f"total_{c}" for c in ("shard_kb", "shard_s", "analyze_s", "events", "errors")], *[F.round(c, 4).alias(c) for c in rates])


@query("A20_extrapolation", f"""WITH {DAYS} SELECT area, cells, round(measured / 60, 4) AS shard_min_day, round(ac * cells / 60, 4) AS analyze_min_day, round(ac * cells / 60 / 8, 4) AS analyze_min_8_cores,
  round(ac * cells / 60 / 32, 4) AS analyze_min_32_cores, round(kc * cells / 1024 * 30 / 1024, 4) AS shard_gb_30_days FROM m, (VALUES ('CONUS', 1560), ('Global', 3000)) v(area, cells)""")
def extrapolation(spark, sf):
    out = ops.extrapolated(_totals(spark, sf))
    return out.select("area", "cells", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


# --- joins ------------------------------------------------------------------------

KNOWN = "known AS (SELECT c_custkey AS user_id, 'id-' || c_custkey AS aircraft_id FROM customer WHERE c_custkey % 3 <> 0)"


def _known(spark, sf):
    return t.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("tail"), F.concat(F.lit("id-"), F.col("c_custkey").cast("string")).alias("aircraft_id"))


def _ops_rows(spark, sf):
    return t.table(spark, sf, "events").select("event_id", F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("tail"))


@query("J11_lookup_or_insert", f"WITH {KNOWN} SELECT event_id, 'T' || e.user_id AS tail, coalesce(aircraft_id, 'new-T' || e.user_id) AS aircraft_id FROM events e LEFT JOIN known k ON k.user_id = e.user_id")
def lookup_or_insert(spark, sf):
    return ops.lookup_or_insert(_ops_rows(spark, sf), _known(spark, sf))[0].select("event_id", "tail", "aircraft_id")


@query("J11_inserted_aircraft", f"WITH {KNOWN} SELECT DISTINCT 'T' || e.user_id AS tail, 'new-T' || e.user_id AS aircraft_id FROM events e WHERE e.user_id NOT IN (SELECT user_id FROM known)")
def inserted_aircraft(spark, sf):
    return ops.lookup_or_insert(_ops_rows(spark, sf), _known(spark, sf))[1].select("tail", "aircraft_id")


NOTES = """WITH a AS (SELECT 'T' || c_custkey AS tail, CASE WHEN c_custkey % 4 <> 1 THEN c_custkey % 5 END AS arrivals, c_custkey % 11 = 0 AS ban, c_custkey % 3 = 0 AS registered, c_custkey % 7 = 0 AS is_bxa,
    c_custkey % 13 = 0 AS medevac, c_custkey % 5 = 0 AS notes, c_nationkey AS lead_pilot FROM customer WHERE c_custkey % 10 <> 9),
  p AS (SELECT n_nationkey AS pilot_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Ace ' || n_name ELSE '' END AS alias, n_name AS name, 'P' || n_nationkey AS code FROM nation WHERE n_nationkey < 20),
  j AS (SELECT f.user_id, a.*, a.tail IS NOT NULL AS found, p.alias, p.name, p.code, NOT coalesce(registered, false) AND NOT coalesce(is_bxa, false) AND NOT coalesce(medevac, false) AS unreg
    FROM (SELECT DISTINCT user_id FROM events) f LEFT JOIN a ON a.tail = 'T' || f.user_id LEFT JOIN p ON p.pilot_id = a.lead_pilot)
  SELECT 'T' || user_id AS tail, CASE WHEN NOT found THEN '* No Reg ' ELSE coalesce('Arrivals=' || arrivals || ' ', '') || CASE WHEN ban THEN '*BANNED ' ELSE '' END || CASE WHEN NOT is_bxa AND coalesce(arrivals, 0) > 2 THEN '* >2 arrivals ' ELSE '' END
    || CASE WHEN unreg THEN '* No Reg ' ELSE '' END || CASE WHEN notes THEN '*Notes ' ELSE '' END || CASE WHEN is_bxa THEN 'BxA' ELSE '' END END AS note, NOT found OR ban OR unreg AS warning,
    substr(CASE WHEN alias <> '' THEN alias ELSE name END, 1, 7) AS pilot_label, code AS code_label FROM j"""


def _registered(spark, sf):
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    a = t.table(spark, sf, "customer").where(c % 10 != 9).select(
        F.concat(F.lit("T"), c.cast("string")).alias("tail"), F.when(c % 4 != 1, c % 5).alias("arrivals"), (c % 11 == 0).alias("ban"), (c % 3 == 0).alias("registered"),
        (c % 7 == 0).alias("is_bxa"), (c % 13 == 0).alias("medevac"), (c % 5 == 0).alias("notes"), F.col("c_nationkey").alias("lead_pilot"))
    p = t.table(spark, sf, "nation").where("n_nationkey < 20").select(
        n.alias("pilot_id"), F.when(n % 2 == 0, F.concat(F.lit("Ace "), "n_name")).otherwise("").alias("alias"), F.col("n_name").alias("name"), F.concat(F.lit("P"), n.cast("string")).alias("code"))
    return _ops_rows(spark, sf).select("tail").distinct(), a, p


@query("J12_registration_notes", NOTES)
def registration_notes(spark, sf):
    return ops.registration_notes(*_registered(spark, sf))


@query("D6u_registration_logic", NOTES[:NOTES.index("  SELECT 'T' || user_id AS tail")] + """  SELECT 'T' || user_id AS tail, CASE WHEN NOT found THEN 'visitor' WHEN medevac THEN 'medevac' ELSE 'seen ' || coalesce(arrivals, 0) END AS note,
  coalesce(ban, false) AND NOT coalesce(medevac, false) AS warning, substr(CASE WHEN alias <> '' THEN alias ELSE name END, 1, 7) AS pilot_label, code AS code_label FROM j""")
def registration_logic(spark, sf):
    """A logic of the user's own instead of the default one."""
    def own(found, of):
        medevac = F.coalesce(of("medevac"), F.lit(False))
        seen = F.concat(F.lit("seen "), F.coalesce(of("arrivals"), F.lit(0)).cast("string"))
        return F.when(~found, "visitor").when(medevac, "medevac").otherwise(seen), F.coalesce(of("ban"), F.lit(False)) & ~medevac

    return ops.registration_notes(*_registered(spark, sf), logic=own)


# Two event sets that differ in some rows and values.
SETS = """WITH base AS (SELECT event_id, 'N' || user_id AS f1, 'N' || (user_id * 7 % 151) AS f2, CAST(1704067200 + event_id * 20 AS DOUBLE) AS ts, value, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS quality FROM events),
  n AS (SELECT f1 AS flight1, f2 AS flight2, ts AS timestamp, quality, value AS lateral_nm, CAST(event_id % 400 AS DOUBLE) AS alt_sep_ft, 10.0 AS duration_s FROM base WHERE event_id % 10 <> 3),
  o AS (SELECT f2 AS flight1, f1 AS flight2, ts AS timestamp, CASE WHEN event_id % 7 = 1 THEN 'medium' ELSE quality END AS quality, value + CASE WHEN event_id % 6 = 0 THEN 0.01 ELSE 0 END AS lateral_nm, CAST(event_id % 400 AS DOUBLE) AS alt_sep_ft, 10.0 AS duration_s FROM base WHERE event_id % 9 <> 4),
  kn AS (SELECT least(flight1, flight2) || '|' || greatest(flight1, flight2) || '@' || strftime(make_timestamp(CAST(timestamp AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M') AS k, * FROM n),
  ko AS (SELECT least(flight1, flight2) || '|' || greatest(flight1, flight2) || '@' || strftime(make_timestamp(CAST(timestamp AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M') AS k, * FROM o),
  dn AS (SELECT * FROM kn QUALIFY row_number() OVER (PARTITION BY k ORDER BY timestamp, lateral_nm, alt_sep_ft, quality) = 1), dk AS (SELECT * FROM ko QUALIFY row_number() OVER (PARTITION BY k ORDER BY timestamp, lateral_nm, alt_sep_ft, quality) = 1),
  j AS (SELECT coalesce(dn.k, dk.k) AS event_key, dn.k IS NULL AS gone, dk.k IS NULL AS added, dn.quality <> dk.quality AS dq, coalesce(abs(dn.lateral_nm - dk.lateral_nm) > 1e-6, false) AS dl, coalesce(abs(dn.alt_sep_ft - dk.alt_sep_ft) > 1e-6, false) AS da FROM dn FULL JOIN dk ON dn.k = dk.k)"""


@query("J13_event_diff", SETS + " SELECT event_key, CASE WHEN added THEN 'ADDED' WHEN gone THEN 'REMOVED' WHEN dq OR dl OR da THEN 'CHANGED' ELSE 'SAME' END AS status, concat_ws(',', CASE WHEN dq THEN 'quality' END, CASE WHEN dl THEN 'lateral_nm' END, CASE WHEN da THEN 'alt_sep_ft' END) AS changed FROM j")
def event_diff(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    base = t.table(spark, sf, "events").select(
        e, F.concat(F.lit("N"), u.cast("string")).alias("f1"), F.concat(F.lit("N"), (u * 7 % 151).cast("string")).alias("f2"), (t.EPOCH0 + e * 20).cast("double").alias("timestamp"), "value",
        F.when(F.col("value") > 50, "high").otherwise("low").alias("quality"), (e % 400).cast("double").alias("alt_sep_ft"), F.lit(10.0).alias("duration_s"))
    new = base.where(e % 10 != 3).select(F.col("f1").alias("flight1"), F.col("f2").alias("flight2"), "timestamp", "quality", F.col("value").alias("lateral_nm"), "alt_sep_ft", "duration_s")
    old = base.where(e % 9 != 4).select(
        F.col("f2").alias("flight1"), F.col("f1").alias("flight2"), "timestamp", F.when(e % 7 == 1, "medium").otherwise(F.col("quality")).alias("quality"),
        (F.col("value") + F.when(e % 6 == 0, 0.01).otherwise(0)).alias("lateral_nm"), "alt_sep_ft", "duration_s")
    return ops.event_diff(new, old)


@query("J15_new_requests", """SELECT icao, min(event_id) AS first_seq FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'K' || c ELSE c END AS icao0, CASE WHEN length(icao0) = 3 AND regexp_matches(icao0, '^[A-Z]{3}$') THEN 'K' || icao0 ELSE icao0 END AS icao
    FROM (SELECT event_id, chr(CAST(65 + user_id % 26 AS INTEGER)) || CASE WHEN user_id % 5 = 0 THEN '1' ELSE 'Q' END || chr(CAST(65 + user_id % 11 AS INTEGER)) AS c FROM events))
  WHERE icao NOT IN (SELECT 'K' || chr(CAST(65 + n_nationkey AS INTEGER)) || 'QD' FROM nation) GROUP BY 1""")
def new_requests(spark, sf):
    u, e = F.col("user_id"), F.col("event_id")
    code = F.concat(F.char(65 + u % 26), F.when(u % 5 == 0, "1").otherwise("q"), F.char(65 + u % 11))
    r = t.table(spark, sf, "events").select(e.alias("seq"), F.when(e % 3 == 0, F.concat(F.lit("K"), code)).otherwise(code).alias("airport"))
    done = t.table(spark, sf, "nation").select(F.concat(F.lit("K"), F.char(65 + F.col("n_nationkey").cast("bigint")), F.lit("QD")).alias("icao"))
    return ops.new_requests(r, done)


# --- sets and order ---------------------------------------------------------------

@query("U1_union_missing_columns", "SELECT event_id AS id, event_type AS kind, NULL::DOUBLE AS price FROM events UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders")
def union_missing(spark, sf):
    e = t.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return e.unionByName(o, allowMissingColumns=True)


@query("U2_ordered_difference", "SELECT 'U' || user_id AS ident, event_id AS seq FROM events WHERE 'U' || user_id NOT IN (SELECT 'U' || c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def ordered_difference(spark, sf):
    ga = t.table(spark, sf, "events").select(F.concat(F.lit(" u"), F.col("user_id").cast("string")).alias("ARPT_ID"), F.col("event_id").alias("seq"))
    tower = t.table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("IDENT"))
    return ops.ordered_difference(ops.identifiers(ga), ops.identifiers(tower)).select("ident", "seq")


@query("U4_intersect_count", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM events INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def intersect_count(spark, sf):
    a = t.table(spark, sf, "events").select("user_id")
    b = t.table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id"))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n"))


@query("U5_ordered_dedupe", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def ordered_dedupe(spark, sf):
    return ops.first_seen(t.table(spark, sf, "events"), "user_id", "event_id")


@query("U3_distinct_events", "SELECT user_id AS flight1, event_type AS flight2, CAST(hour(ts) AS DOUBLE) AS timestamp, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def distinct_events(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", F.col("user_id").alias("flight1"), F.col("event_type").alias("flight2"), F.hour("ts").cast("double").alias("timestamp"))
    return los.deduplicate(e).select("flight1", "flight2", "timestamp", "event_id").orderBy("timestamp")


@query("O4_first_n", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 500")
def first_n(spark, sf):
    return t.table(spark, sf, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(500)


@query("O5_sorted_counts", "SELECT user_id, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def sorted_counts(spark, sf):
    out = t.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))
    return out.orderBy(F.desc("days"), F.desc("n"), "user_id")


@query("O7_latest_state", f"WITH {P} SELECT tail, max(now) AS now, arg_max(seq, now) AS seq, arg_max(alt_baro, now) AS alt_baro, round(arg_max(lat, now), 6) AS lat FROM positions GROUP BY 1")
def latest_state(spark, sf):
    s = t.positions(spark, sf).groupBy("tail").agg(F.max_by(F.struct("now", "seq", "alt_baro", F.round("lat", 6).alias("lat")), F.struct("now", "seq")).alias("s"))
    return s.select("tail", "s.*")


@query("K12_track_index", """WITH r AS (SELECT event_id, props || ',' || event_type || chr(10) AS line FROM events) SELECT event_id, CAST(sum(strlen(line)) OVER (ORDER BY event_id) - strlen(line) AS BIGINT) AS offset_bytes, CAST(strlen(line) AS BIGINT) AS length_bytes FROM r""")
def track_index(spark, sf):
    from ..sinks.exports import byte_index

    lines = t.table(spark, sf, "events").select("event_id", F.concat("props", F.lit(","), "event_type").alias("line"))
    return byte_index(lines, "event_id").select("event_id", "offset_bytes", "length_bytes")


@query("A21_rule_grid_stats", f"""WITH {t.AIRPORTS_SQL}, c AS (SELECT ident, unnest(range(CAST(floor(lat - 10 / 60.0) AS BIGINT), CAST(floor(lat + 10 / 60.0) AS BIGINT) + 1)) AS la, lon, lat FROM airports),
  g AS (SELECT la, unnest(range(CAST(floor(lon - 10 / (60.0 * cos(radians(lat)))) AS BIGINT), CAST(floor(lon + 10 / (60.0 * cos(radians(lat)))) AS BIGINT) + 1)) AS lo FROM c), n AS (SELECT la, lo, count(*) AS k FROM g GROUP BY 1, 2)
  SELECT count(*) AS cells, round(avg(k), 4) AS mean_rules, max(k) AS max_rules, min(k) AS min_rules FROM n""")
def rule_grid_stats(spark, sf):
    from ..plans.rule_grid import grid_stats, ring_cells

    rules = t.airports(spark, sf).select(F.col("ident").alias("rule"), F.lit(10.0).alias("radius_nm"), "lat", "lon")
    return grid_stats(ring_cells(rules))


@query("J4_rule_point_grid", f"""WITH {P}, {t.AIRPORTS_SQL} SELECT rule, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM (SELECT seq, ident AS rule, {t.haversine_sql('a.lat', 'a.lon', 'p.lat', 'p.lon')} AS d FROM positions p, airports a) WHERE d <= 6 GROUP BY 1""")
def rule_point_grid(spark, sf):
    from ..plans.rule_grid import match_rings

    rules = t.airports(spark, sf).select(F.col("ident").alias("rule"), F.lit(6.0).alias("radius_nm"), "lat", "lon")
    return match_rings(t.positions(spark, sf).select("seq", "lat", "lon"), rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))
