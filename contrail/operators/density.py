"""Traffic density tiles, zoom pyramid, event tiles, hotspot surface."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, tiles
from ..session import stage
from .skew import dimension_join
from .timeline import SLICE_S, timeline

# Fixed values.
SEGMENT_GAP_S = 120
BELOW_FT, ABOVE_FT = -200, 4000
SATURATE = 65535
PYRAMID_GAMMA = {10: 0.9, 9: 0.75, 8: 0.6, 7: 0.5, 6: 0.4, 5: 0.3, 4: 0.25, 3: 0.2}
PYRAMID_FLOOR = {10: 0, 9: 8, 8: 12, 7: 14, 6: 15, 5: 15, 4: 15, 3: 15}
ALPHA_MIN, ALPHA_LEVELS = 55, 8
EVENT_RADIUS_PX = {7: 0.67, 8: 0.67, 9: 1.33, 10: 2.0, 11: 4.0}
# Segments that one task draws of a tile, steps along them in all and at once, and marks that it holds unmerged.
DRAW_ROWS, DRAW_STEPS, DRAW_AT_ONCE, MARKS_HELD = 200_000, 1_000_000, 100_000, 2_000_000
# Points that a task adds to its grid at once.
POINTS_AT_ONCE = 4096
EVENT_TILE_QUALITIES = ["vhigh", "high", "medium"]


def track_segments(df: DataFrame, zoom: int, key: str = "hex", width: float = SLICE_S) -> DataFrame:
    """Consecutive reports less than 120 s apart as segments in world pixels.

    ``x0, y0, x1, y1`` are integer pixels of the whole world at ``zoom``; the mean
    altitude is floor-divided.
    """
    px = tiles.tile_pixel("lat", "lon", F.lit(float(zoom)))
    rows = df.withColumn("_w", px).withColumn("wx", F.col("_w.tx") * tiles.TILE + F.col("_w.px")).withColumn(
        "wy", F.col("_w.ty") * tiles.TILE + F.col("_w.py")).drop("_w")
    out = timeline(rows, [key], "now", ["seq"], lag=["wx", "wy", "alt_baro"], gap=SEGMENT_GAP_S, width=width)
    gap = F.col("now") - F.col("prev1.now")
    out = out.where((gap > 0) & (gap < SEGMENT_GAP_S) & F.col("alt_baro").isNotNull() & F.col("prev1.alt_baro").isNotNull())
    return out.select(
        key, F.col("session_no").alias("flight_no"), "now", "seq",
        F.col("prev1.wx").alias("x0"), F.col("prev1.wy").alias("y0"), F.col("wx").alias("x1"), F.col("wy").alias("y1"),
        F.floor((F.col("alt_baro") + F.col("prev1.alt_baro")) / 2).alias("alt"))


def segment_tiles(segments: DataFrame, elevations: DataFrame | None = None, max_agl: int = ABOVE_FT, margin: int = 0) -> DataFrame:
    """Tiles each segment really crosses, with its part inside the tile.

    The columns of tiles between both ends are walked, and in each of them only the rows that
    the line passes there: copies grow with the tiles crossed, not with the segment's box.
    Clipping is the parametric line test: the stretch u0..u1 of the segment that lies in the
    tile, grown by ``margin`` pixels, on both axes.  ``elevations`` (tx, ty, elev) adds the
    height filter.
    """
    size, m = F.lit(tiles.TILE), F.lit(margin)

    def span(a: Column, b: Column) -> Column:
        return F.sequence(F.floor((F.least(a, b) - m) / size), F.floor((F.greatest(a, b) + m) / size))

    def enter(a: str, b: str, tile: str) -> tuple[Column, Column]:
        d = (F.col(b) - F.col(a)).cast("double")
        low, high = F.col(tile) * size - F.col(a) - m, (F.col(tile) + 1) * size - 1 - F.col(a) + m
        inside = (low <= 0) & (high >= 0)
        first = F.when(d > 0, low / d).when(d < 0, high / d).when(inside, 0.0).otherwise(2.0)
        last = F.when(d > 0, high / d).when(d < 0, low / d).when(inside, 1.0).otherwise(-1.0)
        return first, last

    rows = segments.withColumn("tx", F.explode(span(F.col("x0"), F.col("x1"))))
    xa, xb = enter("x0", "x1", "tx")
    rows = rows.withColumn("_ua", F.greatest(F.lit(0.0), xa)).withColumn("_ub", F.least(F.lit(1.0), xb)).where("_ua <= _ub")
    height = lambda u: F.col("y0") + F.col(u) * (F.col("y1") - F.col("y0"))
    rows = rows.withColumn("ty", F.explode(span(height("_ua"), height("_ub"))))
    if elevations is not None:
        rows = dimension_join(rows, elevations, ["tx", "ty"]).where(
            F.col("alt").between(F.col("elev") + BELOW_FT, F.col("elev") + max_agl))
    ya, yb = enter("y0", "y1", "ty")
    rows = rows.withColumn("u0", F.greatest("_ua", ya)).withColumn("u1", F.least("_ub", yb)).drop("_ua", "_ub")
    return rows.where(F.col("u0") <= F.col("u1"))


def segment_tiles_agl(segments: DataFrame, airports: DataFrame, zoom: int, max_agl: int = ABOVE_FT, margin: int = 0) -> DataFrame:
    """``segment_tiles`` with the height filter: every crossed tile gets the elevation
    of its nearest airport, also tiles without a report of their own."""
    crossed = stage(segment_tiles(segments, margin=margin), "crossed")
    elevations = tile_elevations(crossed.select("tx", "ty").distinct(), airports, zoom).select("tx", "ty", "elev")
    return dimension_join(crossed, elevations, ["tx", "ty"]).where(F.col("alt").between(F.col("elev") + BELOW_FT, F.col("elev") + max_agl))


def traffic_density(segments: DataFrame, zoom: int, airports: DataFrame | None = None, max_agl: int = ABOVE_FT, key: str = "hex", width: int = 2) -> DataFrame:
    """Distinct flights per tile pixel, saturating at 65535; with ``airports`` only of
    the segments within each tile's height band.

    Segments go to the tiles they cross, and those outside the band are gone before a pixel
    is drawn. A task draws the segments of one tile, or, of a busy tile, those of a share of
    its flights: flights are whole in a share, so counts of shares add up. Shares are cut by the
    steps to draw, not by segments, however long these are. What is shuffled is segments, and
    then one count for each pixel and share.
    """
    parts = segment_tiles(segments, margin=width) if airports is None else segment_tiles_agl(segments, airports, zoom, max_agl, width)
    # an aircraft that stands still repeats its segments: they are one before they meet
    longer = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    steps = F.ceil(longer * (F.col("u1") - F.col("u0"))) + 1 + 2 * width
    parts = stage(parts.select("tx", "ty", F.xxhash64(key, "flight_no").alias("flight"), "x0", "y0", "x1", "y1", steps.alias("steps")).distinct(), "tile-parts")
    busy = parts.groupBy("tx", "ty").agg(F.ceil(F.greatest(F.count(F.lit(1)) / DRAW_ROWS, F.sum("steps") / DRAW_STEPS)).alias("_shares")).where("_shares > 1")
    dealt = dimension_join(parts, busy, ["tx", "ty"], "left").withColumn("_share", F.coalesce(F.pmod("flight", "_shares"), F.lit(0)).cast("int"))

    def draw(group: pa.Table) -> pa.Table:
        tx, ty = (group.column(c)[0].as_py() for c in ("tx", "ty"))
        flight, x0, y0, x1, y1, steps = (group.column(c).to_numpy() for c in ("flight", "x0", "y0", "x1", "y1", "steps"))
        flight = np.unique(flight, return_inverse=True)[1]
        marks, cuts = [], np.flatnonzero(np.diff(np.cumsum(steps) // DRAW_AT_ONCE)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(flight)]):
            if sum(map(len, marks)) > MARKS_HELD:
                marks = [np.unique(np.concatenate(marks))]
            x, y, which = line_pixels(x0[lo:hi], y0[lo:hi], x1[lo:hi], y1[lo:hi], width, tx * tiles.TILE, ty * tiles.TILE)
            own = (x >= 0) & (x < tiles.TILE) & (y >= 0) & (y < tiles.TILE)
            marks.append(np.unique(flight[lo:hi][which[own]] * tiles.TILE**2 + y[own] * tiles.TILE + x[own]))
        places, counts = np.unique(np.unique(np.concatenate(marks)) % tiles.TILE**2, return_counts=True)
        n = len(places)
        return pa.table({"tx": np.full(n, tx), "ty": np.full(n, ty), "place": places.astype(np.int64), "n": counts.astype(np.int64)})

    drawn = dealt.drop("_shares").groupBy("tx", "ty", "_share").applyInArrow(draw, "tx bigint, ty bigint, place bigint, n bigint")
    counted = drawn.groupBy("tx", "ty", "place").agg(F.least(F.sum("n"), F.lit(SATURATE).cast("bigint")).alias("cnt"))
    return counted.select(F.lit(zoom).alias("z"), "tx", "ty", (F.col("place") % tiles.TILE).alias("px"), F.floor(F.col("place") / tiles.TILE).alias("py"), "cnt")


def line_pixels(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, width: int, left: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of lines in and beside the tile that begins at ``left, top``, counted from there, and the
    line of each: one step per pixel of the longer axis, ``width`` pixels across the shorter one.
    Steps more than ``width`` outside the tile are left out."""
    dx, dy = x1 - x0, y1 - y0
    n = np.maximum(np.abs(dx), np.abs(dy))
    flat = np.abs(dx) >= np.abs(dy)
    first, step = np.where(flat, x0, y0), np.where(flat, dx, dy)
    # along the longer axis a step is a pixel, so the tile's steps are a range
    low = np.where(flat, left, top) - width
    high = low + tiles.TILE + 2 * width
    begin = np.where(step >= 0, low - first, first - high).clip(0, n)
    end = np.where(step >= 0, high - first, first - low).clip(0, n)
    many = np.maximum(end - begin + 1, 0)
    which = np.repeat(np.arange(len(n)), many)
    i = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + begin[which]
    u = np.divide(i, n[which], out=np.zeros(len(i)), where=n[which] > 0)
    x = np.floor(x0[which] + u * dx[which] + 0.5).astype(np.int64)
    y = np.floor(y0[which] + u * dy[which] + 0.5).astype(np.int64)
    across = np.tile(np.arange(width), len(which))
    x, y, which = (np.repeat(v, width) for v in (x, y, which))
    return x - left + np.where(flat[which], 0, across), y - top + np.where(flat[which], across, 0), which


def segment_pixels(segments: DataFrame, width: int = 2) -> DataFrame:
    """World pixels along each segment, one step per pixel of its longer axis.

    A line ``width`` 2 also covers the neighbour across the shorter axis.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    steps = F.greatest(F.abs(dx), F.abs(dy))
    rows = segments.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), steps)))
    u = F.when(F.col("_n") > 0, F.col("_i") / F.col("_n")).otherwise(0.0)
    flat = F.abs(dx) >= F.abs(dy)
    rows = rows.withColumn("_x", F.floor(F.col("x0") + u * dx + 0.5)).withColumn("_y", F.floor(F.col("y0") + u * dy + 0.5)).withColumn("_flat", flat)
    rows = rows.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    x = F.col("_x") + F.when(F.col("_flat"), 0).otherwise(F.col("_w"))
    y = F.col("_y") + F.when(F.col("_flat"), F.col("_w")).otherwise(0)
    return rows.withColumn("wx", x).withColumn("wy", y).drop("_n", "_i", "_x", "_y", "_w", "_flat")


def colored(pixels: DataFrame) -> DataFrame:
    c = tiles.density_color("cnt")
    return pixels.withColumn("_c", c).select("*", F.col("_c.r").alias("r"), F.col("_c.g").alias("g"), F.col("_c.b").alias("b"),
                                             tiles.density_alpha("cnt").alias("a")).drop("_c")


def pyramid(px: DataFrame, source_zoom: int, min_zoom: int = 3, fold: int = 2) -> DataFrame:
    """All parent zooms.  ``fold`` zooms are made in one task from the pixels below a common
    ancestor tile, so rows are shuffled once for each ``fold`` zooms; only the coarsest of
    them, 16 times fewer pixels, goes on. A task holds the pixels of 16 tiles, a million, at most."""
    levels, cur, zoom = None, px.select("tx", "ty", "px", "py", "r", "g", "b", "a"), source_zoom
    while zoom > min_zoom:
        depth = min(fold, zoom - min_zoom)
        made = stage(_folded(cur, zoom, depth), f"zoom{zoom - depth}")
        zoom -= depth
        cur = made.where(F.col("z") == zoom).drop("z")
        levels = made if levels is None else levels.unionByName(made)
    return levels


def _folded(px: DataFrame, zoom: int, depth: int) -> DataFrame:
    names = ["tx", "ty", "px", "py", "r", "g", "b", "a"]

    def fold(group: pa.Table) -> pa.Table:
        v = {c: group.column(c).to_numpy().astype(np.int64) for c in names}
        out = []
        for z in range(zoom - 1, zoom - 1 - depth, -1):
            v = _halved(v, PYRAMID_FLOOR.get(z, 0), PYRAMID_GAMMA.get(z, 1.0))
            out.append({"z": np.full(len(v["tx"]), z)} | v)
        return pa.table({c: np.concatenate([x[c] for x in out]).astype(np.int64 if c in names[:4] else np.int32) for c in ["z", *names]})

    above = [F.shiftright(c, depth).alias(f"_{c}") for c in ("tx", "ty")]
    return px.groupBy(*above).applyInArrow(fold, "z int, tx bigint, ty bigint, px bigint, py bigint, r int, g int, b int, a int")


def _halved(v: dict[str, np.ndarray], floor: int, gamma: float) -> dict[str, np.ndarray]:
    """One pyramid step on arrays of pixels: premultiplied 2x2 means, noise floor, gamma.

    Absent pixels count as transparent, so sums divide by four.
    """
    keep = v["a"] > floor
    x, y = ((v[t][keep] * tiles.TILE + v[p][keep]) for t, p in (("tx", "px"), ("ty", "py")))
    # the pixel above and the place in it, as one number
    key = ((x >> 1) << 32 | y >> 1) << 2 | (y & 1) << 1 | x & 1
    del x, y
    order = np.argsort(key)
    key = key[order] >> 2
    alpha = v["a"][keep][order] / 255.0
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    mean = lambda w: np.add.reduceat(w, begins) / 4 if len(begins) else np.zeros(0)
    a = mean(alpha)
    safe = np.where(a > 1.0 / 255.0, a, 1.0)
    # 1e-9 keeps sums that are whole up to rounding from truncating one lower
    byte = lambda w: np.floor(np.clip(w, 0.0, 255.0) + 1e-9).astype(np.int64)
    x, y = key[begins] >> 32, key[begins] & 0xFFFFFFFF
    out = {"tx": x // tiles.TILE, "ty": y // tiles.TILE, "px": x % tiles.TILE, "py": y % tiles.TILE}
    out |= {c: byte(mean(v[c][keep][order] * alpha) / safe) for c in "rgb"}
    return out | {"a": byte(np.power(a, gamma) * 255.0)}


def overlay_alpha(alpha) -> Column:
    """Drop faint pixels, round the others up to the top of one of eight levels."""
    a, step = geo._c(alpha), 256 // ALPHA_LEVELS
    return F.when(a < ALPHA_MIN, F.lit(0)).otherwise(
        F.least(F.lit(255), (F.floor(a / step) * step + step - 1).cast("int")))


def event_tiles(events: DataFrame, zoom: int, radius_px: float | None = None) -> DataFrame:
    """Tiles an event's disc reaches (its own and close neighbours) with its pixel there."""
    r = EVENT_RADIUS_PX[zoom] if radius_px is None else radius_px
    p = tiles.tile_pixel("lat", "lon", F.lit(float(zoom)))
    rows = events.withColumn("_p", p)
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rows = rows.withColumn("_d", F.explode(around))
    px, py = F.col("_p.px") - F.col("_d.dx") * tiles.TILE, F.col("_p.py") - F.col("_d.dy") * tiles.TILE
    rows = rows.withColumn("z", F.lit(zoom)).withColumn("tile_x", F.col("_p.tx") + F.col("_d.dx")).withColumn(
        "tile_y", F.col("_p.ty") + F.col("_d.dy")).withColumn("tile_px", px).withColumn("tile_py", py)
    near = F.col("tile_px").between(-r, tiles.TILE + r) & F.col("tile_py").between(-r, tiles.TILE + r)
    return rows.where(near).drop("_p", "_d")


def tile_elevations(tile_list: DataFrame, airports: DataFrame, zoom: int) -> DataFrame:
    """Elevation of the airport nearest to each tile centre, in degrees.

    Ring search over a one-degree grid: airports near the tile's cell first, and
    only tiles still undecided look one ring further, until all are decided.
    """
    center = tiles.tile_center("tx", "ty", F.lit(float(zoom)))
    rows = tile_list.select("tx", "ty").distinct().withColumn("_c", center).select(
        "tx", "ty", F.col("_c.lat").alias("clat"), F.col("_c.lon").alias("clon"))
    near = nearest_point(rows, ["tx", "ty"], "clat", "clon", airports.select("ordinal", "ident", "lat", "lon", "elev"))
    return near.select("tx", "ty", F.col("point.ident").alias("ident"), F.col("point.elev").alias("elev"))


def nearest_point(rows: DataFrame, row_id: Sequence[str], lat: str, lon: str, points: DataFrame, rings: int = 2,
                  cell: float = 1.0) -> DataFrame:
    """Euclidean nearest point in degrees; ties to the lowest ordinal.

    A match within ``rings`` cells is certain to be the nearest when it is no
    further than ``rings * cell``; the remaining rows (far from every point) are
    compared with the per-cell representatives level by level on coarser grids.
    """
    out, todo, size = None, rows, cell
    for level in range(8):
        reach = rings * size
        dim = points.select(F.struct(*points.columns).alias("point"), F.floor(F.col("lat") / size).alias("_y"), F.floor(F.col("lon") / size).alias("_x"))
        for axis in ("_y", "_x"):
            dim = dim.withColumn(axis, F.explode(F.sequence(F.col(axis) - rings, F.col(axis) + rings)))
        probe = todo.withColumn("_y", F.floor(F.col(lat) / size)).withColumn("_x", F.floor(F.col(lon) / size))
        met = dimension_join(probe, dim, ["_y", "_x"])
        d = F.pow(F.col(lat) - F.col("point.lat"), 2) + F.pow(F.col(lon) - F.col("point.lon"), 2)
        best = met.withColumn("_d", d).groupBy(*row_id).agg(F.min(F.struct("_d", "point.ordinal", "point")).alias("_b"))
        found = best.where(F.col("_b._d") <= reach * reach).select(*row_id, F.col("_b.point").alias("point"))
        out = found if out is None else out.unionByName(found)
        todo = todo.join(found.select(*row_id), list(row_id), "left_anti")
        size *= 4
        if size > 400 or todo.isEmpty():
            break
    return out


def hotspots(points: DataFrame, grid: int = 50, factor: float | None = None, threshold: float = 0.1) -> DataFrame:
    """Gaussian density of points on a padded grid x grid mesh, scaled to 0..1.

    Every task adds its points to one grid of ``grid * grid`` nodes, and grids are added in two
    steps: what is shuffled is one row a task.  One row of statistics (count, bounds,
    covariance) reaches the driver.
    """
    pts = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("lat", "lon")
    st = pts.agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("lat").alias("vy"), F.var_samp("lon").alias("vx"), F.covar_samp("lat", "lon").alias("vxy"),
        F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1")).first()
    if st["n"] < 2 or not st["vy"] > 1e-20 or not st["vx"] > 1e-20:
        raise ValueError("need at least two points that vary in latitude and longitude")
    f2 = (st["n"] ** (-1.0 / 6.0) if factor is None else float(factor)) ** 2
    cyy, cxx, cxy = st["vy"] * f2, st["vx"] * f2, st["vxy"] * f2
    det = cyy * cxx - cxy * cxy
    pad, last = 0.1, grid - 1

    def node(low: float, high: float, i: Column) -> Column:
        span = high - low
        return F.lit(low - pad * span) + i * F.lit((1 + 2 * pad) * span / last)

    mesh_y, mesh_x = (np.linspace(lo - pad * (hi - lo), hi + pad * (hi - lo), grid) for lo, hi in ((st["y0"], st["y1"]), (st["x0"], st["x1"])))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((grid, grid))
        for batch in batches:
            lat, lon = (batch.column(i).to_numpy() for i in range(2))
            for lo in range(0, len(lat), POINTS_AT_ONCE):
                dy, dx = mesh_y[:, None] - lat[lo:lo + POINTS_AT_ONCE], mesh_x[:, None] - lon[lo:lo + POINTS_AT_ONCE]
                near_y, near_x = -0.5 * dy * dy * (cxx / det), -0.5 * dx * dx * (cyy / det)
                for i in range(grid):
                    total[i] += np.exp(near_y[i] + near_x + dy[i] * dx * (cxy / det)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["d"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grid * grid)
        for batch in batches:
            for one in batch.column(0):
                total += one.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["d"])

    grids = pts.select(F.col("lat").cast("double"), F.col("lon").cast("double")).mapInArrow(partial, "d array<double>")
    grids = stage(grids, "grids")  # one row for each task
    grids = grids.repartition(math.ceil(math.sqrt(grids.count()))).mapInArrow(added, "d array<double>").repartition(1).mapInArrow(added, "d array<double>")
    scale = 2 * math.pi * math.sqrt(det) * st["n"]
    dens = grids.select(F.posexplode("d").alias("node", "d")).withColumn("d", F.col("d") / scale)
    gy, gx = node(st["y0"], st["y1"], F.floor(F.col("node") / grid)), node(st["x0"], st["x1"], F.col("node") % grid)
    # grid * grid rows, whatever the input
    mesh = Window.partitionBy(F.lit(0))
    low, high = F.min("d").over(mesh), F.max("d").over(mesh)
    out = dens.withColumn("intensity", (F.col("d") - low) / (high - low + 1e-10))
    return out.where(F.col("intensity") > threshold).select("node", gy.alias("lat"), gx.alias("lon"), "intensity")
