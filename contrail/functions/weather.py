"""Ceiling, flight category, wind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

# Worst category first.
CATEGORIES = ["LIFR", "IFR", "MVFR", "VFR"]
CEILING_COVERS = ["BKN", "OVC", "VV"]
PILOT_TERMS = {"VFR": "VMC", "MVFR": "MVMC", "IFR": "IMC", "LIFR": "IMC"}


def ceiling_ft(covers: list[str], heights: list[str]) -> Column:
    """Height of the first broken, overcast or obscured layer that has one."""
    return F.coalesce(*[
        F.when(_c(c).isin(CEILING_COVERS), _c(h).try_cast("double")) for c, h in zip(covers, heights)
    ])


def flight_category(visibility, ceiling) -> Column:
    v, c = _c(visibility), _c(ceiling)
    by_ceiling = F.when(c < 500, 0).when(c < 1000, 1).when(c < 3000, 2).otherwise(3)
    by_visibility = F.when(v < 1, 0).when(v < 3, 1).when(v <= 5, 2).otherwise(3)
    names = F.array(*[F.lit(n) for n in CATEGORIES])
    return F.when(v.isNull() & c.isNull(), F.lit("UNKNOWN")).otherwise(
        F.get(names, F.least(by_ceiling, by_visibility)))


def pilot_term(category) -> Column:
    out = _c(category)
    for code, term in PILOT_TERMS.items():
        out = F.when(_c(category) == code, F.lit(term)).otherwise(out)
    return out


WIND = r"(\d{3}|VRB)(\d{2,3})(?:G\d{2,3})?KT"


def parse_wind(metar) -> Column:
    """struct(direction, speed); calm and variable winds have no direction."""
    m = _c(metar)
    direction, speed = F.regexp_extract(m, WIND, 1), F.regexp_extract(m, WIND, 2)
    kt = F.when(speed == "", 0).otherwise(speed.try_cast("int"))
    deg = direction.try_cast("int")
    return F.struct(
        F.when((deg == 0) & (kt == 0), F.lit(None)).otherwise(deg).cast("int").alias("direction"),
        kt.alias("speed"),
    )
