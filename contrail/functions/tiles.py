"""Web Mercator tiles, density colouring."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

TILE = 256
# Colour ramp and density scale.
BANDS = 10
FULL_DENSITY = 40
VIBRANCY = 0.9


def world_xy(lat, lon, zoom) -> Column:
    """Fractional tile coordinates as struct(x, y)."""
    n = F.pow(F.lit(2.0), _c(zoom))
    rad = F.radians(_c(lat))
    merc = F.log(F.tan(rad) + F.lit(1.0) / F.cos(rad))
    return F.struct(
        ((_c(lon) + 180.0) / 360.0 * n).alias("x"),
        ((1.0 - merc / math.pi) / 2.0 * n).alias("y"),
    )


def tile_pixel(lat, lon, zoom) -> Column:
    w = world_xy(lat, lon, zoom)

    def pixel(v: Column) -> Column:
        inside = ((v - F.floor(v)) * TILE).cast("bigint")
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(TILE - 1).cast("bigint"), inside))

    return F.struct(
        F.floor(w["x"]).alias("tx"), F.floor(w["y"]).alias("ty"),
        pixel(w["x"]).alias("px"), pixel(w["y"]).alias("py"),
    )


def _edge_lat(ty: Column, n: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * ty / n))))


def tile_bounds(tx, ty, zoom) -> Column:
    n = F.pow(F.lit(2.0), _c(zoom))
    return F.struct(
        _edge_lat(_c(ty) + 1, n).alias("south"), (_c(tx) / n * 360.0 - 180.0).alias("west"),
        _edge_lat(_c(ty), n).alias("north"), ((_c(tx) + 1) / n * 360.0 - 180.0).alias("east"),
    )


def tile_center(tx, ty, zoom) -> Column:
    b = tile_bounds(tx, ty, zoom)
    return F.struct(
        ((b["south"] + b["north"]) / 2).alias("lat"), ((b["west"] + b["east"]) / 2).alias("lon"))


def tms_row(ty, zoom) -> Column:
    return (F.pow(F.lit(2.0), _c(zoom)) - 1 - _c(ty)).cast("bigint")


def altitude_band(alt, floor, ceil) -> Column:
    lo, hi = _c(floor), _c(ceil)
    frac = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_c(alt) - lo) / (hi - lo)))
    return F.when(hi <= lo, F.lit(0)).otherwise((frac * (BANDS - 1) + 0.5).cast("int"))


def density_norm(count) -> Column:
    return F.least(F.log1p(_c(count).cast("double")) / math.log1p(FULL_DENSITY), F.lit(1.0))


def density_alpha(count) -> Column:
    norm = density_norm(count)
    return F.when(_c(count) > 0, (norm * norm * 255.0).cast("int")).otherwise(0)


def density_color(count) -> Column:
    """Busy pixels purple, sparse ones light blue, as struct(r, g, b)."""
    band = ((1.0 - density_norm(count)) * (BANDS - 1) + 0.5).cast("int")
    frac = band / float(BANDS - 1)
    low, high = frac / 0.5, (frac - 0.5) / 0.5

    def channel(first: Column, second: Column) -> Column:
        return (F.when(frac < 0.5, first).otherwise(second) * VIBRANCY + 0.5).cast("int")

    return F.struct(
        channel(128.0 * (1.0 - low), 150.0 * high).alias("r"),
        channel(64.0 * low, 64.0 + 156.0 * high).alias("g"),
        channel(F.lit(255.0), F.lit(255.0)).alias("b"),
    )
