"""Tiles, pyramids, hotspots and generated regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tiles
from ..operators import density, regions
from . import tables as t
from .registry import query

Z = 11


def _world(lat: str, lon: str, z: int) -> tuple[str, str]:
    return (f"(({lon} + 180.0) / 360.0 * {2 ** z})",
            f"((1.0 - ln(tan(radians({lat})) + 1.0 / cos(radians({lat}))) / pi()) / 2.0 * {2 ** z})")


def _tile_cols(lat: str, lon: str, z: int) -> str:
    x, y = _world(lat, lon, z)
    px = lambda v: f"greatest(0, least(255, CAST(trunc(({v} - floor({v})) * 256) AS BIGINT)))"
    return f"CAST(floor({x}) AS BIGINT) AS tx, CAST(floor({y}) AS BIGINT) AS ty, {px(x)} AS px, {px(y)} AS py"


@query("X17_tile_pixel", f"WITH {t.POSITIONS_SQL} SELECT seq, {_tile_cols('lat', 'lon', Z)} FROM positions")
def tile_pixel(spark, sf):
    p = t.positions(spark, sf).withColumn("_t", tiles.tile_pixel("lat", "lon", F.lit(float(Z))))
    return p.select("seq", "_t.*")


@query("X17_tile_bounds", f"""WITH {t.POSITIONS_SQL}, w AS (SELECT DISTINCT tx, ty FROM (SELECT {_tile_cols('lat', 'lon', 13)} FROM positions))
  SELECT tx, ty, round(degrees(atan(sinh(pi() * (1 - 2.0 * (ty + 1) / 8192)))), 6) AS south, round(tx / 8192.0 * 360 - 180, 6) AS west,
    round(degrees(atan(sinh(pi() * (1 - 2.0 * ty / 8192)))), 6) AS north, round((tx + 1) / 8192.0 * 360 - 180, 6) AS east, 8191 - ty AS tms FROM w""")
def tile_bounds(spark, sf):
    z = F.lit(13.0)
    w = t.positions(spark, sf).withColumn("_t", tiles.tile_pixel("lat", "lon", z)).select("_t.tx", "_t.ty").distinct()
    b = tiles.tile_bounds("tx", "ty", z)
    return w.withColumn("b", b).select("tx", "ty", *[F.round(f"b.{c}", 6).alias(c) for c in ("south", "west", "north", "east")],
                                       tiles.tms_row("ty", z).alias("tms"))


SEGMENTS = f"""WITH {t.POSITIONS_SQL}, pix AS (SELECT *, tx * 256 + px AS wx, ty * 256 + py AS wy FROM (SELECT *, {_tile_cols('lat', 'lon', Z)} FROM positions)),
lagged AS (SELECT *, lag(now) OVER w AS pn, lag(wx) OVER w AS x0, lag(wy) OVER w AS y0, lag(alt_baro) OVER w AS pa FROM pix WINDOW w AS (PARTITION BY hex ORDER BY now, seq)),
numbered AS (SELECT *, CAST(1 + sum(CASE WHEN now - pn > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY hex ORDER BY now, seq) AS BIGINT) AS flight_no FROM lagged),
segments AS (SELECT hex, flight_no, seq, x0, y0, wx AS x1, wy AS y1, (alt_baro + pa) // 2 AS alt FROM numbered WHERE now - pn > 0 AND now - pn < 120)"""


def _segments(spark, sf):
    return density.track_segments(t.positions(spark, sf), Z)


@query("G1_track_segments", SEGMENTS + " SELECT hex, flight_no, seq, x0, y0, x1, y1, alt FROM segments")
def track_segments(spark, sf):
    return _segments(spark, sf).drop("now")


def _span(a: str, b: str, tile: str) -> tuple[str, str]:
    d, lo, hi = f"({b} - {a})", f"({tile} * 256 - {a})", f"(({tile} + 1) * 256 - 1 - {a})"
    return (f"CASE WHEN {d} > 0 THEN {lo} / {d} WHEN {d} < 0 THEN {hi} / {d} WHEN {lo} <= 0 AND {hi} >= 0 THEN 0.0 ELSE 2.0 END",
            f"CASE WHEN {d} > 0 THEN {hi} / {d} WHEN {d} < 0 THEN {lo} / {d} WHEN {lo} <= 0 AND {hi} >= 0 THEN 1.0 ELSE -1.0 END")


(_xa, _xb), (_ya, _yb) = _span("x0", "x1", "tx"), _span("y0", "y1", "ty")


@query("G2_segment_tiles", SEGMENTS + f""", spread AS (SELECT *, unnest(range(least(y0, y1) // 256, greatest(y0, y1) // 256 + 1)) AS ty FROM (
  SELECT *, unnest(range(least(x0, x1) // 256, greatest(x0, x1) // 256 + 1)) AS tx FROM segments)),
  clipped AS (SELECT *, greatest(0.0, {_xa}, {_ya}) AS u0, least(1.0, {_xb}, {_yb}) AS u1 FROM spread)
  SELECT hex, seq, tx, ty, round(u0, 6) AS u0, round(u1, 6) AS u1 FROM clipped WHERE u0 <= u1""")
def segment_tiles(spark, sf):
    return density.segment_tiles(_segments(spark, sf)).select("hex", "seq", "tx", "ty", F.round("u0", 6).alias("u0"), F.round("u1", 6).alias("u1"))


# The elevation of every tile that a query names in ``tl``.
ELEVATIONS = """tc AS (
  SELECT tx, ty, (degrees(atan(sinh(pi() * (1 - 2.0 * ty / 2048)))) + degrees(atan(sinh(pi() * (1 - 2.0 * (ty + 1) / 2048))))) / 2 AS clat, ((tx / 2048.0 * 360 - 180) + ((tx + 1) / 2048.0 * 360 - 180)) / 2 AS clon FROM tl),
  te AS (SELECT tx, ty, elev FROM (SELECT tx, ty, a.elev, row_number() OVER (PARTITION BY tx, ty ORDER BY pow(clat - a.lat, 2) + pow(clon - a.lon, 2), a.ordinal) AS r FROM tc, airports a) WHERE r = 1)"""


@query("G2_segment_tiles_agl", SEGMENTS + f""", {t.AIRPORTS_SQL}, spread AS (SELECT *, unnest(range(least(y0, y1) // 256, greatest(y0, y1) // 256 + 1)) AS ty FROM (
  SELECT *, unnest(range(least(x0, x1) // 256, greatest(x0, x1) // 256 + 1)) AS tx FROM segments)),
  tl AS (SELECT DISTINCT tx, ty FROM spread), {ELEVATIONS},
  clipped AS (SELECT s.*, greatest(0.0, {_xa.replace('tx', 's.tx')}, {_ya.replace('ty', 's.ty')}) AS u0, least(1.0, {_xb.replace('tx', 's.tx')}, {_yb.replace('ty', 's.ty')}) AS u1
    FROM spread s JOIN te ON te.tx = s.tx AND te.ty = s.ty WHERE alt BETWEEN elev - 200 AND elev + 500)
  SELECT tx, ty, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM clipped WHERE u0 <= u1 GROUP BY 1, 2""")
def segment_tiles_agl(spark, sf):
    out = density.segment_tiles_agl(_segments(spark, sf), t.airports(spark, sf), Z, 500)
    return out.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


PIXELS = SEGMENTS + """, stepped AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n, unnest(range(0, greatest(abs(x1 - x0), abs(y1 - y0)) + 1)) AS i FROM segments),
line AS (SELECT *, CAST(floor(x0 + (CASE WHEN n > 0 THEN i / n ELSE 0.0 END) * (x1 - x0) + 0.5) AS BIGINT) AS lx, CAST(floor(y0 + (CASE WHEN n > 0 THEN i / n ELSE 0.0 END) * (y1 - y0) + 0.5) AS BIGINT) AS ly,
  abs(x1 - x0) >= abs(y1 - y0) AS flat FROM stepped),
thick AS (SELECT hex, flight_no, lx + CASE WHEN flat THEN 0 ELSE w END AS wx, ly + CASE WHEN flat THEN w ELSE 0 END AS wy FROM line, (VALUES (0), (1)) v(w)),
density AS (SELECT wx // 256 AS tx, wy // 256 AS ty, wx % 256 AS px, wy % 256 AS py, least(count(DISTINCT hex || ':' || flight_no), 65535) AS cnt FROM thick GROUP BY 1, 2, 3, 4)"""


def _density(spark, sf):
    return density.traffic_density(_segments(spark, sf), Z)


@query("G3_segment_pixels", PIXELS + " SELECT hex, count(*) AS n, CAST(sum(wx) AS BIGINT) AS sx, CAST(sum(wy) AS BIGINT) AS sy FROM thick GROUP BY 1")
def segment_pixels(spark, sf):
    return density.segment_pixels(_segments(spark, sf)).groupBy("hex").agg(F.count(F.lit(1)).alias("n"), F.sum("wx").alias("sx"), F.sum("wy").alias("sy"))


@query("A14_pixel_density", PIXELS + " SELECT tx, ty, px, py, cnt FROM density")
def pixel_density(spark, sf):
    return _density(spark, sf).drop("z")


@query("G4_pixel_density_by_tile", PIXELS + " SELECT tx, ty, count(*) AS pixels, CAST(sum(cnt) AS BIGINT) AS flights, max(cnt) AS busiest FROM density GROUP BY 1, 2")
def density_by_tile(spark, sf):
    return _density(spark, sf).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("pixels"), F.sum("cnt").alias("flights"), F.max("cnt").alias("busiest"))


AGL_PIXELS = PIXELS.replace("SELECT hex, flight_no, lx", "SELECT hex, flight_no, alt, lx") + f""", {t.AIRPORTS_SQL}, tl AS (SELECT DISTINCT wx // 256 AS tx, wy // 256 AS ty FROM thick), {ELEVATIONS},
low AS (SELECT p.wx // 256 AS tx, p.wy // 256 AS ty, wx % 256 AS px, wy % 256 AS py, least(count(DISTINCT hex || ':' || flight_no), 65535) AS cnt FROM thick p JOIN te ON te.tx = p.wx // 256 AND te.ty = p.wy // 256
  WHERE alt BETWEEN elev - 200 AND elev + 500 GROUP BY 1, 2, 3, 4)"""


@query("A14_pixel_density_agl", AGL_PIXELS + " SELECT tx, ty, px, py, cnt FROM low")
def pixel_density_agl(spark, sf):
    return density.traffic_density(_segments(spark, sf), Z, t.airports(spark, sf), 500).drop("z")


@query("G4_pixel_density_by_tile_agl", AGL_PIXELS + " SELECT tx, ty, count(*) AS pixels, CAST(sum(cnt) AS BIGINT) AS flights, max(cnt) AS busiest FROM low GROUP BY 1, 2")
def density_by_tile_agl(spark, sf):
    return pixel_density_agl(spark, sf).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("pixels"), F.sum("cnt").alias("flights"), F.max("cnt").alias("busiest"))


COLOR = """norm AS (SELECT *, least(ln(1 + cnt) / ln(1 + 40), 1.0) AS nm FROM density), band AS (SELECT *, trunc((1.0 - nm) * 9 + 0.5) / 9.0 AS fr FROM norm),
colored AS (SELECT tx, ty, px, py, cnt, CAST(trunc(nm * nm * 255.0) AS INTEGER) AS a,
  CAST(trunc(CASE WHEN fr < 0.5 THEN 128.0 * (1.0 - fr / 0.5) ELSE 150.0 * ((fr - 0.5) / 0.5) END * 0.9 + 0.5) AS INTEGER) AS r,
  CAST(trunc(CASE WHEN fr < 0.5 THEN 64.0 * (fr / 0.5) ELSE 64.0 + 156.0 * ((fr - 0.5) / 0.5) END * 0.9 + 0.5) AS INTEGER) AS g, CAST(230 AS INTEGER) AS b FROM band)"""


@query("X18_density_color", f"{PIXELS}, {COLOR} SELECT tx, ty, px, py, r, g, b, a FROM colored")
def density_color(spark, sf):
    return density.colored(_density(spark, sf)).select("tx", "ty", "px", "py", "r", "g", "b", "a")


@query("X18_altitude_band", f"""WITH {t.POSITIONS_SQL} SELECT seq, CAST(trunc(greatest(0.0, least(1.0, (alt_baro - 1000.0) / 900.0)) * 9 + 0.5) AS INTEGER) AS band FROM positions""")
def altitude_band(spark, sf):
    return t.positions(spark, sf).select("seq", tiles.altitude_band("alt_baro", F.lit(1000.0), F.lit(1900.0)).alias("band"))


def _level(src: str, dst: str, z: int) -> str:
    fl, ga = density.PYRAMID_FLOOR[z], density.PYRAMID_GAMMA[z]
    byte = lambda c: f"CAST(floor(greatest(0.0, least(255.0, s{c} / 4 / (CASE WHEN sa / 4 > 1.0 / 255.0 THEN sa / 4 ELSE 1.0 END))) + 1e-9) AS INTEGER) AS {c}"
    return f"""{dst} AS (SELECT {z} AS z, tx, ty, px, py, {byte('r')}, {byte('g')}, {byte('b')}, CAST(floor(greatest(0.0, least(255.0, pow(sa / 4, {ga}) * 255.0)) + 1e-9) AS INTEGER) AS a FROM (
  SELECT tx // 2 AS tx, ty // 2 AS ty, (tx % 2) * 128 + px // 2 AS px, (ty % 2) * 128 + py // 2 AS py, sum(r * (a / 255.0)) AS sr, sum(g * (a / 255.0)) AS sg, sum(b * (a / 255.0)) AS sb, sum(a / 255.0) AS sa
  FROM {src} WHERE a > {fl} GROUP BY 1, 2, 3, 4))"""


_LEVELS = ", ".join(_level("colored" if z == 10 else f"z{z + 1}", f"z{z}", z) for z in range(10, 2, -1))


@query("G5_zoom_pyramid", f"{PIXELS}, {COLOR}, {_LEVELS} " + " UNION ALL ".join(f"SELECT * FROM z{z}" for z in range(10, 2, -1)))
def zoom_pyramid(spark, sf):
    return density.pyramid(density.colored(_density(spark, sf)), Z)


@query("G6_overlay_alpha", f"{PIXELS}, {COLOR} SELECT overlay, count(*) AS pixels FROM (SELECT CASE WHEN a < 20 THEN 0 ELSE least(255, a // 32 * 32 + 31) END AS overlay FROM (SELECT least(255, a * 4) AS a FROM colored) WHERE a >= 55 OR a < 20) GROUP BY 1")
def overlay_alpha(spark, sf):
    a = density.colored(_density(spark, sf)).select(F.least(F.lit(255), F.col("a") * 4).alias("a")).where("a >= 55 OR a < 20")
    return a.groupBy(density.overlay_alpha("a").alias("overlay")).agg(F.count(F.lit(1)).alias("pixels"))


EVENT_TILES = f"""WITH {t.POSITIONS_SQL}, home AS (""" + " UNION ALL ".join(
    f"SELECT seq, {z} AS z, {density.EVENT_RADIUS_PX[z]} AS r, {_tile_cols('lat', 'lon', z)} FROM positions" for z in range(7, 12)) + """),
spread AS (SELECT seq, z, r, tx + i AS tile_x, ty + j AS tile_y, px - i * 256 AS tile_px, py - j * 256 AS tile_py FROM home, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j))"""


@query("G7_event_tiles", EVENT_TILES + " SELECT seq, z, tile_x, tile_y, tile_px, tile_py FROM spread WHERE tile_px BETWEEN -r AND 256 + r AND tile_py BETWEEN -r AND 256 + r")
def event_tiles(spark, sf):
    p = t.positions(spark, sf).select("seq", "lat", "lon")
    out = None
    for z in range(7, 12):
        one = density.event_tiles(p, z).drop("lat", "lon")
        out = one if out is None else out.unionByName(one)
    return out


@query("A15_hotspot_surface", f"""WITH {t.POSITIONS_SQL}, st AS (SELECT count(*) AS n, var_samp(lat) AS vy, var_samp(lon) AS vx, covar_samp(lat, lon) AS vxy, min(lat) AS y0, max(lat) AS y1, min(lon) AS x0, max(lon) AS x1 FROM positions),
  pr AS (SELECT *, pow(n, -1.0 / 3.0) AS f2 FROM st), mesh AS (
  SELECT k AS node, y0 - 0.1 * (y1 - y0) + (k // 20) * (1.2 * (y1 - y0) / 19) AS gy, x0 - 0.1 * (x1 - x0) + (k % 20) * (1.2 * (x1 - x0) / 19) AS gx, vy * f2 AS cy, vx * f2 AS cx, vxy * f2 AS cxy, n FROM pr, range(400) r(k)),
  d AS (SELECT node, gy, gx, sum(exp(-0.5 * (((gy - lat) * (gy - lat) * cx + (gx - lon) * (gx - lon) * cy - 2 * (gy - lat) * (gx - lon) * cxy) / (cy * cx - cxy * cxy)))) / (2 * pi() * sqrt(any_value(cy * cx - cxy * cxy)) * any_value(n)) AS d
    FROM mesh, positions GROUP BY 1, 2, 3)
  SELECT CAST(node AS INTEGER) AS node, round(gy, 6) AS lat, round(gx, 6) AS lon, round(i, 6) AS intensity FROM (SELECT *, (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER () + 1e-10) AS i FROM d) WHERE i > 0.1""")
def hotspot_surface(spark, sf):
    out = density.hotspots(t.positions(spark, sf), grid=20)
    return out.select("node", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("intensity", 6).alias("intensity"))


# --- generated regions and rules ------------------------------------------------

def _field(spark, sf):
    return t.runways(spark, sf).where("le_heading IS NOT NULL").select(
        "ident", "elev", F.col("le_ident").alias("app_ident"), F.col("le_lat").alias("app_lat"), F.col("le_lon").alias("app_lon"), F.col("le_heading").alias("app_heading"),
        F.col("le_ident").alias("dep_ident"), F.col("he_lat").alias("dep_lat"), F.col("he_lon").alias("dep_lon"), F.col("le_heading").alias("dep_heading"),
        "length_ft", "width_ft", "lat", "lon")


_R = "CAST(trunc((({h} {s} {d}) % 360 + 360) % 360) AS DOUBLE)"


def _point(lat: str, lon: str, d: str, b: str) -> tuple[str, str]:
    return f"({lat} + {d} / 60.0 * cos(radians({b})))", f"({lon} + {d} / (60.0 * cos(radians({lat}))) * sin(radians({b})))"


_far = _point("he_lat", "he_lon", "3.0", "le_heading")
_lf = _point(_far[0], _far[1], "(0.75 / 2)", "(le_heading - 90)")


@query("G8_airport_regions", f"""WITH {t.RUNWAYS_SQL}, f AS (SELECT * FROM runways WHERE le_heading IS NOT NULL)
  SELECT ident, 0 AS idx, 'RWY' || le_ident || ' Departure' AS name, CAST(elev - 500 AS BIGINT) AS min_alt, CAST(elev + 3000 AS BIGINT) AS max_alt, {_R.format(h='le_heading', s='-', d=25)} AS hdg0, {_R.format(h='le_heading', s='+', d=25)} AS hdg1, 5 AS points,
    round({_lf[1]}, 6) AS x1, round({_lf[0]}, 6) AS y1 FROM f
  UNION ALL SELECT ident, 1, 'RWY' || le_ident || ' Approach', CAST(elev - 500 AS BIGINT), CAST(elev + 5000 AS BIGINT), {_R.format(h='le_heading', s='-', d=30)}, {_R.format(h='le_heading', s='+', d=30)}, 5,
    round({_point(*_point('le_lat', 'le_lon', '5.0', '((le_heading + 180) % 360)'), '0.5', '((le_heading + 180) % 360 - 90)')[1]}, 6), round({_point(*_point('le_lat', 'le_lon', '5.0', '((le_heading + 180) % 360)'), '0.5', '((le_heading + 180) % 360 - 90)')[0]}, 6) FROM f
  UNION ALL SELECT ident, 2, 'Ground', CAST(elev - 500 AS BIGINT), CAST(elev + 500 AS BIGINT), 0.0, 360.0, 37,
    round({_point('lat', 'lon', '(length_ft / 6076 / 2 + 0.3)', '10.0')[1]}, 6), round({_point('lat', 'lon', '(length_ft / 6076 / 2 + 0.3)', '10.0')[0]}, 6) FROM f
  UNION ALL SELECT ident, 3, 'Vicinity', CAST(elev - 500 AS BIGINT), CAST(elev + 10000 AS BIGINT), 0.0, 360.0, 37, round({_point('lat', 'lon', '10.0', '10.0')[1]}, 6), round({_point('lat', 'lon', '10.0', '10.0')[0]}, 6) FROM f""")
def airport_regions(spark, sf):
    r = regions.airport_regions(_field(spark, sf))
    return r.select("ident", "idx", "name", "min_alt", "max_alt", "hdg0", "hdg1", F.size("ring").alias("points"),
                    F.round(F.col("ring")[1]["x"], 6).alias("x1"), F.round(F.col("ring")[1]["y"], 6).alias("y1"))


@query("G9_airport_rules", f"""WITH {t.RUNWAYS_SQL}, f AS (SELECT * FROM runways WHERE le_heading IS NOT NULL)
  SELECT ident, unnest(['takeoff', 'takeoff_popup', 'landing', 'vicinity_traffic', 'region_change', 'prox']) AS rule, unnest([
    '{{"latlongring":[10.0,' || lat || ',' || lon || '],"transition_regions":["Ground","RWY' || le_ident || ' Departure"]}}', '{{"transition_regions":["Ground","~"]}}', '{{"transition_regions":["RWY' || le_ident || ' Approach","Ground"]}}',
    '{{"regions":["RWY' || le_ident || ' Departure","RWY' || le_ident || ' Approach","Vicinity","Ground"],"cooldown":10}}', '{{"changed_regions":"strict"}}',
    '{{"min_alt":' || CAST(elev + 500 AS BIGINT) || ',"max_alt":' || CAST(elev + 10000 AS BIGINT) || ',"regions":["Vicinity"],"proximity":[400.0,0.3]}}']) AS conditions FROM f""")
def airport_rules(spark, sf):
    return regions.airport_rules(_field(spark, sf))


def _corner(base: str) -> str:
    """Wedge corners as (k, lat, lon): base and far end, left and right of heading ``h``."""
    far = _point("lat0", "lon0", "len", "h")
    left, right = "(h - 90)", "(h + 90)"
    spots = [_point("lat0", "lon0", f"({base} / 2)", left), _point(*far, "(far / 2)", left), _point(*far, "(far / 2)", right), _point("lat0", "lon0", f"({base} / 2)", right)]
    return ", ".join(f"{{'k': {k}, 'y': {la}, 'x': {lo}}}" for k, (la, lo) in enumerate([*spots, spots[0]]))


_ring_at = _point("lat", "lon", "radius", "(k * 10.0)")
GENERATED = f"""{t.RUNWAYS_SQL}, {t.POSITIONS_SQL}, f AS (SELECT * FROM runways WHERE le_heading IS NOT NULL),
wedge AS (SELECT ident, ordinal * 4 AS idx, 'RWY' || le_ident || ' Departure' AS name, elev - 500 AS low, elev + 3000 AS high, {_R.format(h='le_heading', s='-', d=25)} AS hdg0, {_R.format(h='le_heading', s='+', d=25)} AS hdg1,
    he_lat AS lat0, he_lon AS lon0, le_heading AS h, 3.0 AS len, 0.15 AS base, 0.75 AS far FROM f
  UNION ALL SELECT ident, ordinal * 4 + 1, 'RWY' || le_ident || ' Approach', elev - 500, elev + 5000, {_R.format(h='le_heading', s='-', d=30)}, {_R.format(h='le_heading', s='+', d=30)},
    le_lat, le_lon, (le_heading + 180) % 360, 5.0, width_ft * 4 / 6076, 1.0 FROM f),
circle AS (SELECT ident, ordinal * 4 + 2 AS idx, 'Ground' AS name, elev - 500 AS low, elev + 500 AS high, lat, lon, length_ft / 6076 / 2 + 0.3 AS radius FROM f
  UNION ALL SELECT ident, ordinal * 4 + 3, 'Vicinity', elev - 500, elev + 10000, lat, lon, 10.0 FROM f),
made AS (SELECT ident, idx, name, low, high, hdg0, hdg1, unnest([{_corner('base')}]) AS p FROM wedge
  UNION ALL SELECT ident, idx, name, low, high, 0.0, 360.0, {{'k': k, 'y': {_ring_at[0]}, 'x': {_ring_at[1]}}} FROM (SELECT *, CAST(unnest(range(37)) AS INTEGER) AS k FROM circle)),
spots AS (SELECT idx, lower(ident || ' ' || name) AS name, low, high, hdg0, hdg1, p.k AS k, p.x AS x, p.y AS y FROM made),
edge AS (SELECT a.*, b.x AS x2, b.y AS y2 FROM spots a JOIN spots b ON a.idx = b.idx AND b.k = a.k + 1),
crossed AS (SELECT seq, e.idx, e.name FROM positions p JOIN edge e ON p.alt_baro BETWEEN e.low AND e.high
    AND CASE WHEN hdg0 <= hdg1 THEN p.track BETWEEN hdg0 AND hdg1 ELSE p.track >= hdg0 OR p.track <= hdg1 END
    AND (e.y > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x) * (p.lat - e.y) / (e.y2 - e.y) + e.x
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
first AS (SELECT seq, arg_min(name, idx) AS region FROM crossed GROUP BY 1)"""


@query("G8_assign_generated_regions", f"WITH {GENERATED} SELECT region, count(*) AS n FROM positions LEFT JOIN first USING (seq) GROUP BY 1")
def assign_generated(spark, sf):
    r = regions.airport_regions(_field(spark, sf))
    ordinal = F.ascii(F.substring("ident", 2, 1)) - 65
    r = r.withColumn("layer", F.lit(0)).withColumn("idx", F.col("idx") + ordinal * 4).withColumn("name", F.concat_ws(" ", "ident", "name")).withColumn("file", F.col("ident"))
    out = regions.assign_join(t.positions(spark, sf), r)
    return out.groupBy(F.col("inside")[0].alias("region")).agg(F.count(F.lit(1)).alias("n"))
