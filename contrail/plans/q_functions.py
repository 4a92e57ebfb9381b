"""Scalar functions over the positions view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, idents, labels, times
from . import tables as t
from .registry import query

P = t.POSITIONS_SQL
CLAT, CLON = "CAST(36.7 AS DOUBLE)", "CAST(-121.7 AS DOUBLE)"
LA, LO = 36.7, -121.7


def _p(spark, sf):
    return t.positions(spark, sf)


@query("X1_haversine", f"WITH {P} SELECT seq, round({t.haversine_sql('lat', 'lon', CLAT, CLON)}, 6) AS nm FROM positions")
def haversine(spark, sf):
    return _p(spark, sf).select("seq", F.round(geo.haversine_nm("lat", "lon", LA, LO), 6).alias("nm"))


@query("X2_equirectangular", f"WITH {P} SELECT seq, round({t.equirect_sql('lat', 'lon', CLAT, CLON)}, 6) AS nm FROM positions")
def equirect(spark, sf):
    return _p(spark, sf).select("seq", F.round(geo.equirect_nm("lat", "lon", LA, LO), 6).alias("nm"))


@query("X3_bounds", f"WITH {P} SELECT seq, round(lat - 5 / 60.0, 6) AS south, round(lon - 5 / (60.0 * cos(radians(lat))), 6) AS west, round(lat + 5 / 60.0, 6) AS north, round(lon + 5 / (60.0 * cos(radians(lat))), 6) AS east FROM positions")
def bounds(spark, sf):
    return _p(spark, sf).withColumn("b", geo.bounds("lat", "lon", F.lit(5.0))).select("seq", *[F.round(f"b.{c}", 6).alias(c) for c in ("south", "west", "north", "east")])


@query("X4_bearing_and_headings", f"""WITH {P} SELECT seq, round({t.bearing_sql('lat', 'lon', CLAT, CLON)}, 6) AS bearing, {t.circular_sql('track', '350.0')} AS diff,
  track >= 300 OR track <= 45 AS northerly, CAST((track - 25 + 360) % 360 AS INTEGER) AS h0, CAST((track + 25) % 360 AS INTEGER) AS h1 FROM positions""")
def bearing(spark, sf):
    r = geo.heading_range("track", F.lit(25))
    return _p(spark, sf).select(
        "seq", F.round(geo.bearing_deg("lat", "lon", LA, LO), 6).alias("bearing"), geo.circular_diff("track", F.lit(350.0)).alias("diff"),
        geo.heading_between("track", F.lit(300.0), F.lit(45.0)).alias("northerly"), r["start"].alias("h0"), r["end"].alias("h1"))


@query("X5_point_at", f"WITH {P} SELECT seq, round(lat + 2.5 / 60.0 * cos(radians(track)), 6) AS lat, round(lon + 2.5 / (60.0 * cos(radians(lat))) * sin(radians(track)), 6) AS lon FROM positions")
def point_at(spark, sf):
    return _p(spark, sf).withColumn("d", geo.point_at("lat", "lon", F.lit(2.5), "track")).select("seq", F.round("d.lat", 6).alias("lat"), F.round("d.lon", 6).alias("lon"))


_C, _S = "round(lat + {r} / 60.0 * cos(radians({b})), 6)", "round(lon + {r} / (60.0 * cos(radians(lat))) * sin(radians({b})), 6)"


@query("X5_circle_ring", f"WITH {P} SELECT seq, 37 AS points, {_C.format(r='0.5', b='90.0')} AS y9, {_S.format(r='0.5', b='90.0')} AS x9 FROM positions")
def circle(spark, sf):
    return _p(spark, sf).withColumn("r", geo.circle_ring("lat", "lon", F.lit(0.5))).select(
        "seq", F.size("r").alias("points"), F.round(F.col("r")[9]["y"], 6).alias("y9"), F.round(F.col("r")[9]["x"], 6).alias("x9"))


RING = [(-121.80, 36.50), (-121.66, 36.52), (-121.72, 36.60), (-121.64, 36.72), (-121.79, 36.68)]


@query("X6_point_in_polygon", f"WITH {P} SELECT seq, {t._crossings(RING)} AS inside FROM positions")
def point_in_polygon(spark, sf):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    return _p(spark, sf).select("seq", geo.point_in_ring("lat", "lon", ring).alias("inside"))


_N, _E, _O = f"((lat - {CLAT}) * 60.0)", f"((lon - ({CLON})) * 60.0 * cos(radians({CLAT})))", "radians(CAST(200.0 AS DOUBLE))"


@query("X7_approach_box", f"WITH {P} SELECT seq, round({_N} * cos({_O}) + {_E} * sin({_O}), 6) AS along, round({_E} * cos({_O}) - {_N} * sin({_O}), 6) AS across FROM positions")
def approach_box(spark, sf):
    o = geo.approach_offsets("lat", "lon", LA, LO, F.lit(20.0))
    return _p(spark, sf).select("seq", F.round(o["along"], 6).alias("along"), F.round(o["cross"], 6).alias("across"))


L = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({i} AS INTEGER) + 1, 1)"


@query("X8_icao_to_tail_canada", f"""WITH v AS (SELECT event_id, 12582913 + (event_id * 7919) % 35152 AS v FROM events), o AS (SELECT event_id, v, CASE WHEN v - 12582913 < 17576 THEN 'C-F' ELSE 'C-G' END AS pre, (v - 12582913) % 17576 AS o FROM v)
  SELECT event_id, printf('%x', v) AS hex, pre || {L.format(i='o // 676')} || {L.format(i='o % 676 // 26')} || {L.format(i='o % 26')} AS tail FROM o""")
def tail_canada(spark, sf):
    v = 12582913 + (F.col("event_id") * 7919) % 35152
    e = t.table(spark, sf, "events").select("event_id", F.lower(F.hex(v)).alias("hex"))
    return e.withColumn("tail", idents.icao_to_tail("hex"))


U = "substr('ABCDEFGHJKLMNPQRSTUVWXYZ', CAST({i} AS INTEGER) + 1, 1)"
SFX = f"CASE WHEN {{r}} = 0 THEN '' ELSE {U.format(i='(({r}) - 1) // 25')} || CASE WHEN (({{r}}) - 1) % 25 = 0 THEN '' ELSE {U.format(i='(({r}) - 1) % 25 - 1')} END END"


@query("X8_icao_to_tail_us", f"""WITH v AS (SELECT event_id, (event_id * 9173) % 915399 AS o FROM events), a AS (SELECT *, o // 101711 + 1 AS d1, o % 101711 AS r1 FROM v), b AS (SELECT *, (r1 - 601) // 10111 AS d2, (r1 - 601) % 10111 AS r2 FROM a),
  c AS (SELECT *, (r2 - 601) // 951 AS d3, (r2 - 601) % 951 AS r3 FROM b), d AS (SELECT *, (r3 - 601) // 35 AS d4, (r3 - 601) % 35 AS r4 FROM c)
  SELECT event_id, printf('%x', o + 10485761) AS hex, 'N' || d1 || CASE WHEN r1 < 601 THEN {SFX.format(r='r1')} ELSE d2 || CASE WHEN r2 < 601 THEN {SFX.format(r='r2')} ELSE d3 || CASE WHEN r3 < 601 THEN {SFX.format(r='r3')}
    ELSE d4 || CASE WHEN r4 = 0 THEN '' WHEN r4 <= 24 THEN {U.format(i='r4 - 1')} ELSE CAST(r4 - 25 AS VARCHAR) END END END END AS tail FROM d""")
def tail_us(spark, sf):
    v = 10485761 + (F.col("event_id") * 9173) % 915399
    e = t.table(spark, sf, "events").select("event_id", F.lower(F.hex(v)).alias("hex"))
    return e.withColumn("tail", idents.icao_to_tail("hex"))


CODES = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'k' || c || 'vi' WHEN 1 THEN c || 'bd' WHEN 2 THEN c || '43' ELSE 'eg' || c || 'l' END AS code FROM (SELECT event_id, chr(CAST(97 + user_id % 26 AS INTEGER)) AS c FROM events)"


@query("X9_airport_codes", f"""WITH c AS ({CODES}), u AS (SELECT event_id, upper(code) AS u FROM c) SELECT event_id, CASE WHEN regexp_matches(u, '^[A-Z]{{3}}$') THEN 'K' || u ELSE u END AS icao,
  CASE WHEN length(u) = 4 AND u LIKE 'K%' THEN substr(u, 2) ELSE u END AS faa FROM u""")
def airport_codes(spark, sf):
    c, e = F.char(97 + F.col("user_id") % 26), F.col("event_id")
    code = F.when(e % 4 == 0, F.concat(F.lit("k"), c, F.lit("vi"))).when(e % 4 == 1, F.concat(c, F.lit("bd"))).when(e % 4 == 2, F.concat(c, F.lit("43"))).otherwise(F.concat(F.lit("eg"), c, F.lit("l")))
    rows = t.table(spark, sf, "events").select("event_id", code.alias("code"))
    return rows.select("event_id", idents.faa_to_icao("code").alias("icao"), idents.icao_to_faa("code").alias("faa"))


@query("X10_runway_number", """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN n || 'L' WHEN 1 THEN ' ' || n || ' ' WHEN 2 THEN 'H' || n WHEN 3 THEN n || 'r' ELSE 'NE' END AS ident, CAST(n AS INTEGER) AS k, event_id % 5 AS m
  FROM (SELECT event_id, CAST(event_id % 40 AS VARCHAR) AS n FROM events)) SELECT event_id, CASE WHEN m IN (0, 1, 3) AND k BETWEEN 1 AND 36 THEN lpad(CAST(k AS VARCHAR), 2, '0') ELSE '' END AS runway FROM r""")
def runway_number(spark, sf):
    e = F.col("event_id")
    n = (e % 40).cast("string")
    ident = F.when(e % 5 == 0, F.concat(n, F.lit("L"))).when(e % 5 == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(e % 5 == 2, F.concat(F.lit("H"), n)).when(e % 5 == 3, F.concat(n, F.lit("r"))).otherwise("NE")
    return t.table(spark, sf, "events").select("event_id", idents.runway_number(ident).alias("runway"))


@query("X11_altitude_label", """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'unknown' WHEN a < 0 THEN '18k+' WHEN a < 3000 THEN '0k-3k' WHEN a < 6000 THEN '3k-6k' WHEN a < 10000 THEN '6k-10k' WHEN a < 18001 THEN '10k-18k' ELSE '18k+' END AS label
  FROM (SELECT event_id, event_id * 3 % 19000 - 500 AS a FROM events)""")
def altitude_label(spark, sf):
    a = F.when(F.col("event_id") % 50 == 0, "ground").otherwise((F.col("event_id") * 3 % 19000 - 500).cast("string"))
    return t.table(spark, sf, "events").select("event_id", labels.altitude_label(a).alias("label"))


@query("X15_time_functions", """SELECT event_id, CAST(hour(ts) * 100 + minute(ts) AS INTEGER) AS hhmm, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sod,
  strftime(ts, '%m%d%y') AS mmddyy, strftime(ts, '%Y%m%d') AS yyyymmdd, CAST(ts AS DATE) AS parsed FROM events""")
def time_functions(spark, sf):
    e = t.table(spark, sf, "events").withColumn("now", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.select("event_id", times.hhmm_utc("now").alias("hhmm"), times.day_type("ts").alias("day_type"), F.floor(times.seconds_of_day("now")).alias("sod"),
                    times.tag_mmddyy("ts").alias("mmddyy"), times.tag_yyyymmdd("ts").alias("yyyymmdd"), times.date_from_mmddyy(times.tag_mmddyy("ts")).alias("parsed"))


@query("X16_cells", f"WITH {P} SELECT seq, CAST(floor(lat * 3) AS BIGINT) AS la, CAST(floor(lon * 3) AS BIGINT) AS lo, CAST(floor(lat * 3) AS BIGINT) || '_' || CAST(floor(lon * 3) AS BIGINT) AS tag FROM positions")
def cells(spark, sf):
    c = geo.cell_of(F.col("lat") * 3, F.col("lon") * 3)
    return _p(spark, sf).select("seq", c["lat"].alias("la"), c["lon"].alias("lo"), geo.cell_tag(F.col("lat") * 3, F.col("lon") * 3).alias("tag"))


@query("X19_mean_location", f"WITH {P} SELECT seq, round((lat + {CLAT}) / 2, 6) AS lat, round((lon + {CLON}) / 2, 6) AS lon, CAST(trunc((alt_baro + 1325) / 2) AS BIGINT) AS alt FROM positions")
def mean_location(spark, sf):
    m = geo.mean_location("lat", "lon", "alt_baro", LA, LO, F.lit(1325.0))
    return _p(spark, sf).select("seq", F.round(m["lat"], 6).alias("lat"), F.round(m["lon"], 6).alias("lon"), m["alt"].alias("alt"))


@query("X20_links", f"""WITH {P} SELECT seq, 'https://globe.adsbexchange.com/?replay=' || strftime(make_timestamp(CAST(now AS BIGINT) * 1000000), '%Y-%m-%d-%H:%M') || '&lat=' || round(lat, 4) || '&lon=' || round(lon, 4) || '&zoom=12' AS replay,
  'https://globe.adsbexchange.com/?lat=' || round(lat, 4) || '&lon=' || round(lon, 4) || '&zoom=10' AS live FROM positions""")
def links(spark, sf):
    la, lo = F.round("lat", 4), F.round("lon", 4)
    return _p(spark, sf).select("seq", labels.replay_link("now", la, lo, 12).alias("replay"), labels.live_link(la, lo).alias("live"))


@query("X21_pair_key", f"WITH {P} SELECT seq, least(tail, flight) || ' ' || greatest(tail, flight) AS pair FROM positions")
def pair_key(spark, sf):
    return _p(spark, sf).select("seq", geo.pair_key("tail", "flight").alias("pair"))


@query("X22_quality_colors", """SELECT event_id, CASE event_type WHEN 'click' THEN 'rgba(0,200,0,0.7)' WHEN 'view' THEN 'rgba(255,255,0,0.78)' WHEN 'purchase' THEN 'rgba(255,140,0,0.85)' WHEN 'signup' THEN 'rgba(255,0,255,0.85)' ELSE 'rgba(100,100,100,0.7)' END AS color,
  CASE event_id % 4 WHEN 0 THEN '#2ecc40' WHEN 1 THEN '#ffdc00' WHEN 2 THEN '#ff4136' ELSE '#ffdc00' END AS score_color, CASE event_id % 4 WHEN 0 THEN 'Good' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Poor' ELSE 'Unknown' END AS label,
  CASE WHEN event_id % 6 = 0 THEN 'Insufficient low-altitude track data' ELSE printf('%.0f%% of tracks completed to surface', CAST(event_id % 101 AS DOUBLE)) END || chr(10) || 'Based on ' || (event_id % 31) || ' days of data' AS tooltip FROM events""")
def quality_colors(spark, sf):
    k, e = F.col("event_type"), F.col("event_id")
    q = F.when(k == "click", "low").when(k == "view", "medium").when(k == "purchase", "high").when(k == "signup", "vhigh").otherwise("none")
    s = F.when(e % 4 == 0, "green").when(e % 4 == 1, "yellow").when(e % 4 == 2, "red").otherwise("none")
    none = F.lit(None)
    tip = labels.score_tooltip(F.when(e % 6 != 0, (e % 101) / 100), none.cast("double"), none.cast("array<struct<runway:string,pct:bigint>>"), e % 31)
    return t.table(spark, sf, "events").select("event_id", labels.event_color(q).alias("color"), labels.score_color(s).alias("score_color"), labels.score_label(s).alias("label"), tip.alias("tooltip"))
