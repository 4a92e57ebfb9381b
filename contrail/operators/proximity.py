"""Spatio-temporal proximity join and nearest-in-time join."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import stage, task_count
from .sequence import FLIGHT_GAP_S, HOLD_S, interpolated, second_of
from .timeline import SLICE_S, running

# Join cell: one minute by 0.05 degrees by 1000 ft.
CELL_S = 60
CELL_DEG = 0.05
CELL_FT = 1000.0
GRID = (("lat", CELL_DEG), ("lon", CELL_DEG), ("alt_baro", CELL_FT))


def track_pieces(steps: DataFrame, hold: int = 0, interpolate: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Stretches of whole seconds over which an aircraft's position is known.

    ``s0..s1`` are the seconds; positions run linearly from ``p`` to ``q`` (real
    reports).  With ``hold``, the last report before a silence stays valid for
    that many seconds more.  A second belongs to one piece of an aircraft.
    """
    now, nxt = F.col("now"), F.col("next_time")
    last = second_of(now)
    point = F.struct("now", "lat", "lon", "alt_baro", "gs", "track")
    before = F.struct(*[F.col(f"prev.{c}").alias(c) for c in ("now", "lat", "lon", "alt_baro", "gs", "track")])
    joined = F.lit(interpolate) & F.col("prev").isNotNull() & (now - F.col("prev.now") > 1)
    first = F.when(joined, F.least(second_of(F.col("prev.now")) + 1, last)).otherwise(last)
    # a later report within the same second replaces this one there
    end = F.when(nxt.isNotNull() & (second_of(nxt) == last), last - 1).otherwise(last)
    pieces = [F.struct(first.alias("s0"), end.alias("s1"), F.when(joined, before).otherwise(point).alias("p"), point.alias("q"))]
    if hold:
        bridged = F.lit(interpolate) & (nxt - now <= FLIGHT_GAP_S)
        stop = F.least(last + hold, F.coalesce(second_of(nxt) - 1, last + hold))
        stop = F.when(F.coalesce(bridged, F.lit(False)), last).otherwise(stop)
        pieces.append(F.struct((last + 1).alias("s0"), stop.alias("s1"), point.alias("p"), point.alias("q")))
    names = [c for c in ("tail", "flight_id", "seq", *keep) if c in steps.columns]
    out = steps.select(*dict.fromkeys(names), F.explode(F.array(*pieces)).alias("_p"))
    return out.select(*dict.fromkeys(names), "_p.*").where(F.col("s0") <= F.col("s1"))


def _place(at: Column, field: str) -> Column:
    """Of a piece's straight line at a time; the report itself at its last second."""
    p, q = F.col("p"), F.col("q")
    span = q["now"] - p["now"]
    line = p[field] + (at - p["now"]) / span * (q[field] - p[field])
    return F.when((span <= 0) | (at == second_of(q["now"])), q[field]).otherwise(line).cast("double")


def _crossing(begin: Column, a: Column, pace: Column, size: float) -> Callable[[Column], Column]:
    """The first whole second at or behind cell border ``k`` on the way from ``a``."""
    return lambda k: F.ceil(begin + (k * size - a) * pace)


def _cut(pieces: DataFrame) -> DataFrame:
    """Pieces cut at the seconds in which their line enters another cell.

    Each axis gives the times at which the line crosses its cell borders; all of them in order
    are the way of the line through the grid.  Only whole seconds are compared later, so a cut
    falls on one, and a piece faster than a cell a second, as after a wrong position, is cut at
    every second: it takes one place a second, however far it jumps.
    """
    s0, s1 = F.col("s0"), F.col("s1")
    none = F.array().cast("array<bigint>")
    first, last = F.floor(s0 / CELL_S), F.floor(s1 / CELL_S)
    ways, still = [F.when(first < last, F.transform(F.sequence(first + 1, last), lambda k: k * CELL_S)).otherwise(none)], first == last
    for field, size in GRID:
        a, b = _place(s0, field), _place(s1, field)
        lo, hi = (F.floor(f(a, b) / size) for f in (F.least, F.greatest))
        times = F.transform(F.sequence(lo + 1, hi), _crossing(s0, a, (s1 - s0) / (b - a), size))
        ways.append(F.when(lo == hi, none).when(hi - lo > s1 - s0, F.sequence(s0, s1)).otherwise(times))
        still = still & (lo == hi)
    begins = F.array_sort(F.array_distinct(F.concat(F.array(s0), F.filter(F.concat(*ways), lambda t: (t > s0) & (t <= s1)))))
    rest = [c for c in pieces.columns if c not in ("s0", "s1")]
    out = pieces.withColumn("_begins", F.when(still, F.array(s0)).otherwise(begins))
    out = out.select(*rest, "s1", "_begins", F.posexplode_outer("_begins").alias("_i", "s0"))
    return out.select(*rest, "s0", F.coalesce(F.get("_begins", F.col("_i") + 1) - 1, "s1").alias("s1"))


def _spread(pieces: DataFrame, reach_deg: Column, reach_lon: Column, reach_ft: Column) -> DataFrame:
    """Copy each cut piece to the cells that its places (grown by the reach) touch."""
    out = pieces
    for (field, size), name, reach in zip(GRID, "yxz", (reach_deg, reach_lon, reach_ft)):
        a, b = _place(F.col("s0"), field), _place(F.col("s1"), field)
        out = out.withColumn(f"{name}0", F.floor((F.least(a, b) - reach) / size)).withColumn(
            f"{name}1", F.floor((F.greatest(a, b) + reach) / size))
    out = out.withColumn("t0", F.floor(F.col("s0") / CELL_S)).withColumn("t1", F.floor(F.col("s1") / CELL_S))
    # one number for each cell of the box, taken apart again
    lengths = {axis: F.col(f"{axis}1") - F.col(f"{axis}0") + 1 for axis in "tyxz"}
    out = out.withColumn("_k", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), math.prod(lengths.values()) - 1))).where("_k is not null")
    for axis, n in lengths.items():
        out = out.withColumn(f"c{axis}", F.col(f"{axis}0") + F.col("_k") % n).withColumn("_k", ((F.col("_k") - F.col("_k") % n) / n).cast("bigint"))
    return out.drop("_k")


def _at(side: str, sec: Column) -> dict[str, Column]:
    p, q = F.col(f"{side}.p"), F.col(f"{side}.q")
    real = (p["now"] == q["now"]) | (sec == second_of(q["now"]))
    mid = interpolated(p, {c: q[c] for c in ("lat", "lon", "alt_baro")}, q["now"], sec)
    out = {c: F.when(real, q[c]).otherwise(mid[c]) for c in ("lat", "lon", "alt_baro")}
    out["now"] = F.when(real, q["now"]).otherwise(sec.cast("double"))
    return out


def _close_seconds(met: DataFrame, lateral_nm: float, vertical_ft: float) -> DataFrame:
    """Whole seconds (``sec``) at which two linear pieces, ``a`` and ``b``, can be in reach.

    Both aircraft move linearly, so their flat-earth offset does too, and the
    times within a radius are the span between two roots.  The radius carries a
    margin for the projection; the exact test follows.  The last second of a piece
    uses the report itself, which matters when its time is not whole.
    Every step is a column of its own: an expression that holds the steps before it would work them out again. For the same
    reason the seconds are exploded with ``explode_outer``: before a plain one Spark puts a filter that works its input out, too.
    """
    radius = lateral_nm * 1.02 + 0.005
    kept = met.columns
    c = F.col
    met = met.withColumns({"_lo": F.greatest("a.s0", "b.s0"), "_hi": F.least("a.s1", "b.s1")})
    ends = {"0": c("_lo").cast("double"), "1": c("_hi").cast("double")}

    def share(side: str, at: Column) -> Column:
        begin, span = c(f"{side}.p.now"), c(f"{side}.q.now") - c(f"{side}.p.now")
        return F.when(span > 0, (at - begin) / span).otherwise(0.0)

    def place(side: str, end: str, field: str) -> Column:
        return c(f"{side}.p.{field}") + c(f"_f{side}{end}") * (c(f"{side}.q.{field}") - c(f"{side}.p.{field}"))

    def apart(end: str, field: str) -> Column:
        return place("a", end, field) - place("b", end, field)

    met = met.withColumns({f"_f{side}{end}": share(side, at) for side in "ab" for end, at in ends.items()})
    top = F.greatest(*[F.abs(c(f"{s}.{e}.lat")) for s in "ab" for e in "pq"])
    met = met.withColumn("_shrink", F.cos(F.radians(top)) * geo.NM_PER_DEGREE)
    met = met.withColumns({f"_{x}{end}": apart(end, field) for x, field in (("x", "lon"), ("y", "lat"), ("z", "alt_baro")) for end in "01"})
    met = met.withColumns({f"_x{end}": c(f"_x{end}") * c("_shrink") for end in "01"} | {f"_y{end}": c(f"_y{end}") * geo.NM_PER_DEGREE for end in "01"})
    whole = (c("a.q.now") == F.floor("a.q.now")) & (c("b.q.now") == F.floor("b.q.now"))
    high = (F.least("_z0", "_z1") > vertical_ft + 2) | (F.greatest("_z0", "_z1") < -vertical_ft - 2)
    met = met.withColumns({"_whole": whole, "_high": F.coalesce(high, F.lit(False))})
    met = met.withColumns({"_dx": c("_x1") - c("_x0"), "_dy": c("_y1") - c("_y0")})
    met = met.withColumns({"_qa": c("_dx") * c("_dx") + c("_dy") * c("_dy"), "_qb": c("_x0") * c("_dx") + c("_y0") * c("_dy"),
                           "_qc": c("_x0") * c("_x0") + c("_y0") * c("_y0") - radius * radius})
    met = met.withColumns({"_disc": c("_qb") * c("_qb") - c("_qa") * c("_qc"), "_still": c("_qa") < 1e-12})
    root = F.sqrt("_disc")
    met = met.withColumns({
        "_first": F.when(c("_still"), 0.0).otherwise(F.greatest((-c("_qb") - root) / c("_qa"), F.lit(0.0))),
        "_last": F.when(c("_still"), 1.0).otherwise(F.least((-c("_qb") + root) / c("_qa"), F.lit(1.0)))})
    meets = F.when(c("_still"), c("_qc") <= 0).otherwise((c("_disc") >= 0) & (c("_first") <= c("_last")))
    met = met.withColumn("_meets", F.coalesce(meets, F.lit(False)) & ~(c("_whole") & c("_high")))
    length = (c("_hi") - c("_lo")).cast("double")
    secs = F.when(c("_meets"), F.sequence(
        F.greatest(c("_lo"), c("_lo") + F.floor(c("_first") * length - 1e-6)), F.least(c("_hi"), c("_lo") + F.ceil(c("_last") * length + 1e-6))))
    none = F.array().cast("array<bigint>")
    secs = F.when(c("_whole"), secs).otherwise(F.array_union(F.coalesce(secs, none), F.array("_hi")))
    return met.select(*kept, F.explode_outer(secs).alias("sec")).where("sec is not null")


def near_pairs(pieces: DataFrame, lateral_nm: float, vertical_ft: float) -> DataFrame:
    """Unordered aircraft pairs closer than both limits, per whole second.

    Pieces are cut along their lines, which leaves each second of a pair in one pair of
    cut pieces.  Two of them meet in a cell that both touch; a pair of pieces sharing several
    cells is evaluated only in the lowest shared one, so no distinct is needed.
    Seconds are generated after the join, and only those within reach, so the
    join shuffles reports, not one row per second.  The reach in longitude follows
    from each piece's own latitude.
    """
    dy = lateral_nm / geo.NM_PER_DEGREE * 1.01
    top = F.greatest(*[F.abs(F.col(f"{e}.lat").cast("double")) for e in "pq"])
    dx = geo.lon_reach(dy, top)
    cells = ["ct", "cy", "cx", "cz"]
    point = lambda e: F.struct(*[F.col(f"{e}.{c}").alias(c) for c in ("now", "lat", "lon", "alt_baro")])
    # both sides of the join read them
    pieces = stage(_cut(pieces.withColumns({"p": point("p"), "q": point("q")})), "cut-pieces")
    names = pieces.columns
    left = _spread(pieces, F.lit(dy), dx, F.lit(vertical_ft + 2.0)).select(F.struct(*names, *[f"{a}0" for a in "tyxz"]).alias("a"), *cells)
    right = _spread(pieces, F.lit(0.0), F.lit(0.0), F.lit(0.0)).select(F.struct(*names, *[f"{a}0" for a in "tyxz"]).alias("b"), *cells)
    lowest = F.lit(True)
    for axis in "tyxz":
        lowest = lowest & (F.col(f"c{axis}") == F.greatest(F.col(f"a.{axis}0"), F.col(f"b.{axis}0")))
    # a cell is one minute of one small square, so no cell can be large; the work
    # after the join is computation, which AQE would not split by size
    n = task_count(pieces)
    met = left.repartition(n, *cells).join(right.repartition(n, *cells), cells).where(
        (F.col("a.tail") < F.col("b.tail")) & lowest
        & (F.col("a.s0") <= F.col("b.s1")) & (F.col("b.s0") <= F.col("a.s1")))
    met = _close_seconds(met.select("a", "b"), lateral_nm, vertical_ft)
    sec = F.col("sec")
    one, two = _at("a", sec), _at("b", sec)
    ids = [c for c in names if c not in ("s0", "s1", "p", "q")]
    rows = met.select(
        "sec",
        *[F.col(f"a.{c}").alias(f"{c}1") for c in ids], *[F.col(f"b.{c}").alias(f"{c}2") for c in ids],
        *[v.alias(f"{k}1") for k, v in one.items()], *[v.alias(f"{k}2") for k, v in two.items()])
    rows = rows.where(F.abs(F.col("alt_baro1") - F.col("alt_baro2")) < vertical_ft)
    rows = rows.withColumn("lateral_nm", geo.haversine_nm("lat1", "lon1", "lat2", "lon2")).where(F.col("lateral_nm") < lateral_nm)
    return rows.withColumn("alt_sep_ft", F.abs(F.col("alt_baro1") - F.col("alt_baro2")).cast("double"))


def directed(pairs: DataFrame) -> DataFrame:
    """Both directions of unordered pairs: flight1 looks, flight2 is seen."""
    names = [c[:-1] for c in pairs.columns if c.endswith("1")]
    rest = [c for c in pairs.columns if c not in [f"{n}{i}" for n in names for i in "12"]]
    back = pairs.select(*rest, *[F.col(f"{n}2").alias(f"{n}1") for n in names], *[F.col(f"{n}1").alias(f"{n}2") for n in names])
    return pairs.unionByName(back)


def first_neighbour(rows: DataFrame, rule1: Column, rule2: Column) -> DataFrame:
    """Rule firing on directed pairs: per second and flight1 only the neighbour
    seen longest ago is taken, and it must satisfy the rule too.

    The neighbour is chosen by an aggregate, which combines on the map side.
    """
    fields = [c for c in rows.columns if c not in ("sec", "tail1")]
    best = rows.where(rule1).groupBy("sec", "tail1").agg(
        F.min_by(F.struct(*fields), F.struct("now2", "seq2", "tail2")).alias("n"))
    return best.select("sec", "tail1", "n.*").where(rule2)


def nearest_in_time(a: DataFrame, b: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str], order: Sequence[str] = (),
                    tolerance: float = 5.0, width: float = SLICE_S) -> DataFrame:
    """For each row of ``a`` the row of ``b`` with the same keys nearest in time.

    Ties go to the later-or-equal row.  Rows without a match within ``tolerance``
    seconds get nulls in ``b_*``.  One union and one two-level pass: linear in the
    rows, whatever the share of one key.
    """
    keys, order = list(keys), list(order)
    extra = [c for c in a.columns if c not in (*keys, time, *order)]
    left = a.withColumn("_side", F.lit(0))
    right = b.select(*keys, time, *order, *[F.col(f).alias(f"_b_{f}") for f in fields]).withColumn("_side", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True)
    stamp = F.struct(F.col(time).alias("t"), *[F.col(f"_b_{f}").alias(f) for f in fields])
    seen = F.when(F.col("_side") == 1, stamp)
    out = running(both, keys, time, ["_side", *order], lasts={"_before": seen}, nexts={"_after": seen}, inclusive=False, width=width)
    out = out.where(F.col("_side") == 0)
    ahead, behind = F.col("_after.t") - F.col(time), F.col(time) - F.col("_before.t")
    pick = F.when(behind.isNull() | (ahead <= behind), F.col("_after")).otherwise(F.col("_before"))
    out = out.withColumn("_m", pick).withColumn("_m", F.when(F.abs(F.col("_m.t") - F.col(time)) <= tolerance, F.col("_m")))
    return out.select(*keys, time, *order, *extra, F.col("_m.t").alias(f"b_{time}"), *[F.col(f"_m.{f}").alias(f"b_{f}") for f in fields])
