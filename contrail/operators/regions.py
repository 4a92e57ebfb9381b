"""Region membership: first matching region per layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..schema import REGION
from ..session import stage
from .skew import dimension_join

# Up to this many regions are compiled into the row expression itself.
INLINE_REGIONS = 64
# Sides of the cells of a cover, in degrees, each a quarter of the one before (powers of two, so borders are exact).
COVER_SIDES = (16.0, 4.0, 1.0, 0.25, 0.0625)
# A region's finest cells are such that its box is no more than this many wide or high, so a cover
# has at most (28 + 2) ** 2 = 900 cells (360 x 180 degrees have 288 of the coarsest).
COVER_SPAN = 28
TOUCH_EPS = 1e-9

# Fixed values of generated airport regions (nm, ft, degrees).
DEPARTURE_NM, APPROACH_NM, VICINITY_NM, GROUND_MARGIN_NM = 3.0, 5.0, 10.0, 0.3
DEPARTURE_SPREAD, APPROACH_SPREAD = 25, 30
FLOOR_FT, GROUND_TOP_FT, DEPARTURE_TOP_FT, APPROACH_TOP_FT, VICINITY_TOP_FT = -500, 500, 3000, 5000, 10000
FEET_PER_NM_REGION = 6076


def _ring_literal(ring: Sequence) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])


def matches(region: dict, lat="lat", lon="lon", alt="alt_baro", track="track") -> Column:
    """Box, altitude, polygon, heading; the cheap tests come first."""
    xs, ys = [p[0] for p in region["ring"]], [p[1] for p in region["ring"]]
    return (
        F.col(lon).between(min(xs), max(xs)) & F.col(lat).between(min(ys), max(ys))
        & F.col(alt).between(region["min_alt"], region["max_alt"])
        & geo.point_in_ring(lat, lon, _ring_literal(region["ring"]))
        & geo.heading_between(track, F.lit(float(region["hdg0"])), F.lit(float(region["hdg1"])))
    )


def assign_inline(df: DataFrame, layers: Sequence[Sequence[dict]], name: str = "inside") -> DataFrame:
    """``inside``: one region name or null per layer, without a join."""
    if sum(len(layer) for layer in layers) > INLINE_REGIONS:
        raise ValueError(f"more than {INLINE_REGIONS} regions: use assign_join")
    slots = [
        F.coalesce(*[F.when(matches(r), F.lit(r["name"].lower())) for r in layer], F.lit(None).cast("string"))
        for layer in layers
    ]
    return df.withColumn(name, F.array(*slots))


def region_table(spark: SparkSession, layers: Sequence[Sequence[dict]], files: Sequence[str] = ()) -> DataFrame:
    """Layers of a rule document as a table with ``schema.REGION``."""
    names = [*files, *[f"layer{i}" for i in range(len(files), len(layers))]]
    rows = [(i, names[i], k, r["name"], r["min_alt"], r["max_alt"], float(r["hdg0"]), float(r["hdg1"]), [(float(x), float(y)) for x, y in r["ring"]])
            for i, layer in enumerate(layers) for k, r in enumerate(layer)]
    return spark.createDataFrame(rows, REGION)


def _side(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in COVER_SIDES]), level + 1)


def _touches(e: Column, west: Column, east: Column, south: Column, north: Column) -> Column:
    """Does an edge come within ``TOUCH_EPS`` of a cell?  Boxes first, then the cell's corners beside the edge's line."""
    a, b = e["a"], e["b"]
    side = lambda x, y: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    corners = [side(x, y) for x in (west, east) for y in (south, north)]
    return (
        (F.greatest(a["x"], b["x"]) >= west - TOUCH_EPS) & (F.least(a["x"], b["x"]) <= east + TOUCH_EPS)
        & (F.greatest(a["y"], b["y"]) >= south - TOUCH_EPS) & (F.least(a["y"], b["y"]) <= north + TOUCH_EPS)
        & (F.least(*corners) <= TOUCH_EPS) & (F.greatest(*corners) >= -TOUCH_EPS))


def region_cover(regions: DataFrame) -> DataFrame:
    """Cells that cover each region (adds level, cy, cx, edges): large ones inside, small ones along its border.

    A cell that no edge touches lies wholly inside or outside; of a cell that one touches, the
    sixteen parts are looked at, two levels deep.  ``edges`` is null in an inner cell, whose
    points need no ring; a border cell holds the edges that can count for a point in it.
    At most 900 cells a region, whatever its size.  A region without a ring has none.
    """
    kept = [c for c in regions.columns if c != "ring"]
    rows = regions.withColumns({"_edges": geo.ring_edges("ring"), "_box": geo.ring_box("ring")})
    extent = F.greatest(F.col("_box.east") - F.col("_box.west"), F.col("_box.north") - F.col("_box.south"))
    finest = F.lit(0)
    for level, side in enumerate(COVER_SIDES):
        finest = F.when(extent <= side * COVER_SPAN, level).otherwise(finest)
    rows = rows.withColumn("_finest", finest).withColumn("level", F.greatest(F.col("_finest") - 2, F.lit(0)))
    at = lambda c: F.floor(F.col(f"_box.{c}") / _side(F.col("level")))
    rows = rows.withColumn("cy", F.explode(F.sequence(at("south"), at("north")))).withColumn("cx", F.explode(F.sequence(at("west"), at("east"))))
    rows = rows.withColumn("_kind", F.lit(None).cast("int"))

    size = _side(F.col("level"))
    spot = F.array(F.struct(
        (F.col("cx") * size).alias("w"), ((F.col("cx") + 1) * size).alias("e"), (F.col("cy") * size).alias("s"), ((F.col("cy") + 1) * size).alias("n")))
    w, e, s, n = (F.col(f"_at.{c}") for c in "wesn")
    rows = rows.select(*kept, "_edges", "_finest", "level", "cy", "cx", "_kind")
    for step in range(3):
        # exploded, so that a cell's sides are worked out once and not for each edge
        rows = rows.withColumn("_at", F.explode(spot))
        met = F.exists("_edges", lambda x: _touches(x, w, e, s, n))
        kind = F.when(met, 1).when(geo.odd_crossings((s + n) / 2, (w + e) / 2, "_edges"), 2).otherwise(0)
        rows = rows.withColumn("_kind", F.coalesce("_kind", kind)).where(F.col("_kind") > 0)
        if step == 2:
            break
        itself = F.array(F.struct("level", "cy", "cx", F.col("_kind").alias("kind")))
        parts = F.array(*[F.struct((F.col("level") + 1).alias("level"), (F.col("cy") * 4 + i).alias("cy"), (F.col("cx") * 4 + j).alias("cx"), F.lit(None).cast("int").alias("kind"))
                          for i in range(4) for j in range(4)])
        rows = rows.withColumn("_c", F.explode(F.when((F.col("_kind") == 1) & (F.col("level") < F.col("_finest")), parts).otherwise(itself)))
        rows = rows.select(*kept, "_edges", "_finest", "_c.level", "_c.cy", "_c.cx", F.col("_c.kind").alias("_kind"))
    counts = lambda x: (
        (F.greatest(x["a"]["y"], x["b"]["y"]) >= s) & (F.least(x["a"]["y"], x["b"]["y"]) <= n) & (F.greatest(x["a"]["x"], x["b"]["x"]) >= w - TOUCH_EPS))
    return rows.select(*kept, "level", "cy", "cx", F.when(F.col("_kind") == 1, F.filter("_edges", counts)).alias("edges"))


def assign_join(df: DataFrame, regions: DataFrame, name: str = "inside", layers: int | None = None) -> DataFrame:
    """Same result for any number of regions (a table with ``schema.REGION``).

    Regions become covers of cells (``region_cover``), gathered into one list per cell.  A report
    meets the list of its cell on each level in use (five at most) and takes the first match per
    layer.  While the lists of a level fit a broadcast, reports are not shuffled for it.
    ``layers`` is the number of layers (counted from the table when not given).
    """
    cover = region_cover(regions.withColumn("name", F.lower("name")))
    r = F.struct("layer", "idx", "name", "min_alt", "max_alt", "hdg0", "hdg1", "edges")
    cells = stage(cover.groupBy("level", F.col("cy").alias("_cy"), F.col("cx").alias("_cx")).agg(F.collect_list(r).alias("_list")), "cover")
    used = sorted(x["level"] for x in cells.select("level").distinct().collect())
    met = df
    for level in used:
        side = COVER_SIDES[level]
        met = met.withColumn("_cy", F.floor(F.col("lat") / side)).withColumn("_cx", F.floor(F.col("lon") / side))
        there = cells.where(F.col("level") == level).select("_cy", "_cx", F.col("_list").alias(f"_l{level}"))
        met = dimension_join(met, there, ["_cy", "_cx"], "left").drop("_cy", "_cx")

    def hit(r: Column) -> Column:
        return (
            F.col("alt_baro").between(r["min_alt"], r["max_alt"])
            & (r["edges"].isNull() | geo.odd_crossings("lat", "lon", r["edges"]))
            & geo.heading_between("track", r["hdg0"], r["hdg1"])
        )

    def first(layer: int) -> Column:
        """Of the first match on each level, the first in the layer."""
        tops = [F.array_min(F.transform(F.filter(f"_l{x}", lambda r: (r["layer"] == layer) & hit(r)), lambda r: F.struct(r["idx"], r["name"]))) for x in used]
        if not tops:
            return F.lit(None).cast("string")
        return (F.least(*tops) if len(tops) > 1 else tops[0])["name"]

    if layers is None:
        layers = int(regions.agg(F.max("layer")).first()[0] or 0) + 1
    return met.withColumn(name, F.array(*[first(i) for i in range(layers)])).drop(*[f"_l{x}" for x in used])


def in_any_region(layers: Sequence[Sequence[dict]], rings: Sequence[Sequence[float]] = ()) -> Column:
    """Spatial test only (no altitude, no heading); true when nothing is configured.

    Circles use the haversine distance, at most 0.5 % off the geodesic one.
    """
    tests = []
    for region in (r for layer in layers for r in layer):
        xs, ys = [p[0] for p in region["ring"]], [p[1] for p in region["ring"]]
        tests.append(
            F.col("lon").between(min(xs), max(xs)) & F.col("lat").between(min(ys), max(ys))
            & geo.point_in_ring("lat", "lon", _ring_literal(region["ring"])))
    tests += [geo.within_ring("lat", "lon", r, lat0, lon0) for r, lat0, lon0 in rings]
    if not tests:
        return F.lit(True)
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def matches_any(inside, names: Sequence | None, files: Sequence[str] = ()) -> Column:
    """Does a slot array satisfy a region list of a rule?

    An empty list, null or "~" asks for no region in any layer; "~file" for none
    of that file's layer; other entries name a region.
    """
    slots = inside if isinstance(inside, Column) else F.col(inside)
    nowhere = F.forall(slots, lambda s: s.isNull())
    if not names:
        return nowhere
    tests = []
    named = [str(e).lower() for e in names if e is not None and not str(e).startswith("~")]
    if named:
        tests.append(F.exists(slots, lambda s: F.coalesce(s.isin(named), F.lit(False))))
    for entry in names:
        if entry is None or entry == "~":
            tests.append(nowhere)
        elif isinstance(entry, str) and entry.startswith("~"):
            if entry[1:] not in files:
                raise ValueError(f"unknown region file in rule: {entry[1:]!r}")
            tests.append(F.get(slots, F.lit(list(files).index(entry[1:]))).isNull())
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def airport_regions(runways: DataFrame) -> DataFrame:
    """Four regions per airport, in matching order Departure, Approach, Ground,
    Vicinity, as one projection over the runway table.

    Input columns: ident, elev, app_ident, app_lat, app_lon, app_heading,
    dep_ident, dep_lat, dep_lon (lift-off end), dep_heading, length_ft,
    width_ft, lat, lon.
    """
    def whole(offset: int) -> Column:
        return (F.col("elev") + offset).cast("bigint")

    def region(idx: int, name: Column, low: int, high: int, hdg: Column | None, ring: Column) -> Column:
        start = F.lit(0) if hdg is None else hdg["start"]
        end = F.lit(360) if hdg is None else hdg["end"]
        return F.struct(
            F.lit(idx).alias("idx"), name.alias("name"), whole(low).alias("min_alt"), whole(high).alias("max_alt"),
            start.cast("double").alias("hdg0"), end.cast("double").alias("hdg1"), ring.alias("ring"))

    base = F.col("width_ft") * 4 / FEET_PER_NM_REGION
    back = F.pmod(F.col("app_heading") + 180.0, F.lit(360.0))
    ground = F.col("length_ft") / FEET_PER_NM_REGION / 2 + GROUND_MARGIN_NM
    rows = F.array(
        region(0, F.concat(F.lit("RWY"), "dep_ident", F.lit(" Departure")), FLOOR_FT, DEPARTURE_TOP_FT,
               geo.heading_range("dep_heading", F.lit(DEPARTURE_SPREAD)),
               geo.wedge_ring("dep_lat", "dep_lon", "dep_heading", DEPARTURE_NM, 0.15, 0.75)),
        region(1, F.concat(F.lit("RWY"), "app_ident", F.lit(" Approach")), FLOOR_FT, APPROACH_TOP_FT,
               geo.heading_range("app_heading", F.lit(APPROACH_SPREAD)),
               geo.wedge_ring("app_lat", "app_lon", back, APPROACH_NM, base, 1.0)),
        region(2, F.lit("Ground"), FLOOR_FT, GROUND_TOP_FT, None, geo.circle_ring("lat", "lon", ground)),
        region(3, F.lit("Vicinity"), FLOOR_FT, VICINITY_TOP_FT, None, geo.circle_ring("lat", "lon", VICINITY_NM)),
    )
    return runways.select("ident", F.explode(rows).alias("r")).select("ident", "r.*")


def airport_rules(runways: DataFrame) -> DataFrame:
    """Six monitoring rules per airport as rows (ident, rule, conditions JSON)."""
    ident = F.col("ident")
    dep = F.concat(F.lit("RWY"), "dep_ident", F.lit(" Departure"))
    app = F.concat(F.lit("RWY"), "app_ident", F.lit(" Approach"))
    low, high = (F.col("elev") + GROUND_TOP_FT).cast("bigint"), (F.col("elev") + VICINITY_TOP_FT).cast("bigint")

    def rule(name: str, body: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.to_json(body, {"ignoreNullFields": "false"}).alias("conditions"))

    rules = F.array(
        rule("takeoff", F.struct(
            F.array(F.lit(VICINITY_NM), F.col("lat"), F.col("lon")).alias("latlongring"),
            F.array(F.lit("Ground"), dep).alias("transition_regions"))),
        rule("takeoff_popup", F.struct(F.array(F.lit("Ground"), F.lit("~")).alias("transition_regions"))),
        rule("landing", F.struct(F.array(app, F.lit("Ground")).alias("transition_regions"))),
        rule("vicinity_traffic", F.struct(
            F.array(dep, app, F.lit("Vicinity"), F.lit("Ground")).alias("regions"), F.lit(10).alias("cooldown"))),
        rule("region_change", F.struct(F.lit("strict").alias("changed_regions"))),
        rule("prox", F.struct(
            low.alias("min_alt"), high.alias("max_alt"), F.array(F.lit("Vicinity")).alias("regions"),
            F.array(F.lit(400.0), F.lit(0.3)).alias("proximity"))),
    )
    return runways.select(ident, F.explode(rules).alias("r")).select("ident", "r.*")
