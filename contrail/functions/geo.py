"""Distances, bearings, polygons and tiles as Column expressions.

Distances are nautical miles, headings degrees true.  Longitude wrap at +-180
and the poles are not treated specially.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_NM = 3443.92
NM_PER_DEGREE = 60.0
FEET_PER_NM = 6076.12


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2.0 * EARTH_RADIUS_NM * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


def equirect_nm(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (_c(v) for v in (lat1, lon1, lat2, lon2))
    dx = (o2 - o1) * F.cos(F.radians((a1 + a2) / 2))
    dy = a2 - a1
    return F.sqrt(dy * dy + dx * dx) * NM_PER_DEGREE


def lat_span(radius_nm) -> Column:
    return _c(radius_nm) / NM_PER_DEGREE


def lon_span(radius_nm, lat) -> Column:
    return _c(radius_nm) / (NM_PER_DEGREE * F.cos(F.radians(_c(lat))))


def lon_reach(reach_deg, lat) -> Column:
    """Degrees of longitude that a reach in degrees of latitude can span from a latitude, at most half the globe."""
    top = F.least(F.abs(_c(lat)) + _c(reach_deg), F.lit(89.9))
    return F.least(_c(reach_deg) / F.cos(F.radians(top)), F.lit(180.0))


def bounds(lat, lon, radius_nm) -> Column:
    """South-west and north-east corners of the box around a circle."""
    dy, dx = lat_span(radius_nm), lon_span(radius_nm, lat)
    return F.struct(
        (_c(lat) - dy).alias("south"), (_c(lon) - dx).alias("west"),
        (_c(lat) + dy).alias("north"), (_c(lon) + dx).alias("east"),
    )


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon2) - _c(lon1))
    east = F.sin(dl) * F.cos(a2)
    north = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def circular_diff(a, b) -> Column:
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def heading_between(heading, start, end) -> Column:
    """Inclusive test; a start above the end wraps through north."""
    h, s, e = _c(heading), _c(start), _c(end)
    return F.when(s <= e, (h >= s) & (h <= e)).otherwise((h >= s) | (h <= e))


def heading_range(heading, spread) -> Column:
    """Whole-degree start and end of ``heading +- spread`` on the compass."""
    h, r = _c(heading), _c(spread)
    full = F.lit(360.0)
    return F.struct(
        F.pmod(h - r, full).cast("int").alias("start"),
        F.pmod(h + r, full).cast("int").alias("end"),
    )


def point_at(lat, lon, distance_nm, bearing) -> Column:
    """Flat-earth destination point as struct(lat, lon)."""
    b = F.radians(_c(bearing))
    return F.struct(
        (_c(lat) + lat_span(distance_nm) * F.cos(b)).alias("lat"),
        (_c(lon) + lon_span(distance_nm, lat) * F.sin(b)).alias("lon"),
    )


def _xy(p: Column) -> Column:
    return F.struct(p["lon"].alias("x"), p["lat"].alias("y"))


def circle_ring(lat, lon, radius_nm, points: int = 36) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(points)),
        lambda i: _xy(point_at(lat, lon, radius_nm, i * (360.0 / points))),
    )


def wedge_ring(lat, lon, heading, length_nm, base_nm, far_nm) -> Column:
    """Closed ring of a wedge leaving (lat, lon) along ``heading``."""
    h = _c(heading)
    far = point_at(lat, lon, length_nm, h)
    corner = [
        point_at(lat, lon, _c(base_nm) / 2, h - 90),
        point_at(far["lat"], far["lon"], _c(far_nm) / 2, h - 90),
        point_at(far["lat"], far["lon"], _c(far_nm) / 2, h + 90),
        point_at(lat, lon, _c(base_nm) / 2, h + 90),
    ]
    return F.array(*[_xy(p) for p in (*corner, corner[0])])


def point_in_ring(lat, lon, ring) -> Column:
    """Even-odd test of a point against an ARRAY<STRUCT<x,y>> ring, in the JVM.

    Each edge is an index pair, so an open ring is closed by its first vertex.
    """
    y, x, r = _c(lat), _c(lon), _c(ring)
    n = F.size(r)

    def crosses(i: Column) -> Column:
        a, b = F.get(r, i), F.get(r, F.pmod(i + 1, n))
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(spans & (x < at), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i))
    return (hits % 2) == 1


def ring_edges(ring) -> Column:
    """The edges of a ring as ARRAY<STRUCT<a, b>>, the one that closes it included."""
    r = _c(ring)
    return F.transform(r, lambda p, i: F.struct(p.alias("a"), F.get(r, F.pmod(i + 1, F.size(r))).alias("b")))


def odd_crossings(lat, lon, edges) -> Column:
    """The test of ``point_in_ring`` on edges.  Those that end west of the point, or above or below it, count nothing."""
    y, x = _c(lat), _c(lon)

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(_c(edges), F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1


def ring_box(ring) -> Column:
    r = _c(ring)
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("west"), F.array_max(xs).alias("east"),
        F.array_min(ys).alias("south"), F.array_max(ys).alias("north"),
    )


# Approach box of the runway vote.
APPROACH_LENGTH_NM = 1.5
APPROACH_WIDTH_FT = 2500.0


def approach_offsets(lat, lon, rwy_lat, rwy_lon, heading) -> Column:
    """Distance out along final and sideways from the centreline."""
    north = (_c(lat) - _c(rwy_lat)) * NM_PER_DEGREE
    east = (_c(lon) - _c(rwy_lon)) * NM_PER_DEGREE * F.cos(F.radians(_c(rwy_lat)))
    out = F.radians(F.pmod(_c(heading) + 180.0, F.lit(360.0)))
    return F.struct(
        (north * F.cos(out) + east * F.sin(out)).alias("along"),
        (east * F.cos(out) - north * F.sin(out)).alias("cross"),
    )


def in_approach_box(lat, lon, rwy_lat, rwy_lon, heading) -> Column:
    o = approach_offsets(lat, lon, rwy_lat, rwy_lon, heading)
    return o["along"].between(0.0, APPROACH_LENGTH_NM) & (
        F.abs(o["cross"]) <= APPROACH_WIDTH_FT / 2 / FEET_PER_NM)


def within_ring(lat, lon, radius_nm: float, lat0: float, lon0: float) -> Column:
    """Circle test: constant lat/lon bands first, so they reach the scan, then distance."""
    dy = radius_nm / NM_PER_DEGREE
    dx = radius_nm / (NM_PER_DEGREE * math.cos(math.radians(lat0)))
    return (
        _c(lat).between(lat0 - dy, lat0 + dy)
        & _c(lon).between(lon0 - dx, lon0 + dx)
        & (haversine_nm(lat, lon, F.lit(lat0), F.lit(lon0)) <= radius_nm)
    )


def mean_location(lat1, lon1, alt1, lat2, lon2, alt2) -> Column:
    return F.struct(
        ((_c(lat1) + _c(lat2)) / 2).alias("lat"),
        ((_c(lon1) + _c(lon2)) / 2).alias("lon"),
        ((_c(alt1) + _c(alt2)) / 2).cast("bigint").alias("alt"),
    )


def cell_of(lat, lon) -> Column:
    """One-degree cell; floor, so -122.3 belongs to cell -123."""
    return F.struct(F.floor(_c(lat)).alias("lat"), F.floor(_c(lon)).alias("lon"))


def cell_tag(lat, lon) -> Column:
    return F.concat_ws("_", F.floor(_c(lat)).cast("string"), F.floor(_c(lon)).cast("string"))


def pair_key(a, b) -> Column:
    return F.concat_ws(" ", F.least(F.trim(_c(a)), F.trim(_c(b))), F.greatest(F.trim(_c(a)), F.trim(_c(b))))
