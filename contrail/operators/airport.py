"""Airport analytics: busyness, weather, receiver coverage, runway usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, idents, weather
from ..functions.times import day_type
from ..session import stage
from .automata import longest_runs, visits_and_pieces
from .los import nearest_airports
from .skew import dimension_join, exact_rank
from .timeline import SLICE, SLICE_S, sliced

# Fixed values.
BAND_BELOW_FT, BAND_ABOVE_FT = -200, 4000
RING_NM = 5.0
CORRIDOR_LOW_FT, CORRIDOR_HIGH_FT, SURFACE_FT = 800, 1500, 500
MAX_GAP_S = 300
LOST_GREEN, LOST_YELLOW = 0.25, 0.50
GAP_GREEN_S, GAP_YELLOW_S = 5.0, 15.0
FINAL_TOLERANCE_DEG, MIN_FINAL_NM = 20.0, 0.2
VISIT_GAP_S = 600
NEAR_FIELD_NM, FAR_FIELD_NM = 0.4, 1.0


def agl_band(alt, elev, below: int = BAND_BELOW_FT, above: int = BAND_ABOVE_FT) -> Column:
    """Altitude within the airport's band; a missing altitude passes."""
    a, e = geo._c(alt), geo._c(elev)
    return a.isNull() | a.between(e + below, e + above)


# --- busyness ---------------------------------------------------------------

def hourly_unique(df: DataFrame, key: str, date: Column, hour: Column, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, date.alias("date"), hour.alias("hour")).agg(F.countDistinct(key).alias("aircraft"))


def hourly_category(metar: DataFrame) -> DataFrame:
    """Last classified observation per hour; unknown ones do not count."""
    sky = [f"skyc{i}" for i in (1, 2, 3)], [f"skyl{i}" for i in (1, 2, 3)]
    obs = metar.withColumn("category", weather.flight_category(F.col("vsby").try_cast("double"), weather.ceiling_ft(*sky)))
    obs = obs.where(F.col("category") != "UNKNOWN")
    order = F.struct("valid", *([c for c in ("event_id",) if c in metar.columns]))
    return obs.groupBy(F.to_date("valid").alias("date"), F.hour("valid").alias("hour")).agg(F.max_by("category", order).alias("category"))


def with_weather(hourly: DataFrame, categories: DataFrame | None) -> DataFrame:
    if categories is None:
        return hourly.withColumn("weather", F.lit("UNKNOWN"))
    out = dimension_join(hourly, categories, ["date", "hour"], "left")
    return out.withColumn("weather", F.coalesce(weather.pilot_term("category"), F.lit("UNKNOWN"))).drop("category")


def busyness(hourly: DataFrame, categories: DataFrame | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Mean hourly traffic and sample count by (hour, day type or 'all', weather or 'ALL')."""
    rows = with_weather(hourly, categories).withColumn("day_type", day_type("date"))
    g = [F.col(c) for c in groups]
    h, d, w = F.col("hour"), F.col("day_type"), F.col("weather")
    cube = rows.groupingSets([[*g, h, d, w], [*g, h, d], [*g, h, w], [*g, h]], *g, h, d, w).agg(
        F.avg("aircraft").alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping("day_type").alias("_gd"), F.grouping("weather").alias("_gw"))
    cube = cube.where((F.col("_gw") == 1) | (F.col("weather") != "UNKNOWN"))
    return cube.select(
        *groups, "hour", F.when(F.col("_gd") == 1, "all").otherwise(F.col("day_type")).alias("day_type"),
        F.when(F.col("_gw") == 1, "ALL").otherwise(F.col("weather")).alias("weather"), "mean", "n")


def busyness_summary(cube: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    known = F.when(F.col("weather") != "ALL", F.col("weather"))
    return cube.groupBy(*groups).agg(
        F.round(F.max("mean"), 1).alias("global_max"), F.count(F.lit(1)).alias("buckets"),
        F.array_join(F.sort_array(F.collect_set(known)), ",").alias("weather_categories"))


# --- receiver coverage ------------------------------------------------------

TRACK = ["icao", "date", "hex"]


def shard_by_airport(reports: DataFrame, airports: DataFrame, radius_nm: float = 10.0) -> DataFrame:
    """Each report once per airport within the radius (adds icao, elev, ap_lat, ap_lon).

    ``airports`` may carry its own ``radius_nm`` per row.  Airports at the same place
    each get their shard.
    """
    near = nearest_airports(reports, airports, reports.columns, radius_nm, merge=False)
    return near.select(*reports.columns, F.col("ident").alias("icao"), F.col("airport_elev").alias("elev"),
                       F.col("airport_lat").alias("ap_lat"), F.col("airport_lon").alias("ap_lon"), "distance_nm")


def airport_cells(airports: DataFrame, radius_nm: float = 5.0) -> DataFrame:
    """Every airport once per one-degree cell that its box of ``radius_nm`` touches (cell_lat, cell_lon);
    ``airports`` may carry its own ``radius_nm`` per row."""
    reach = F.coalesce("radius_nm", F.lit(radius_nm)) if "radius_nm" in airports.columns else F.lit(radius_nm)
    rows = airports.withColumn("_b", geo.bounds("lat", "lon", reach))
    rows = rows.withColumn("cell_lat", F.explode(F.sequence(F.floor("_b.south"), F.floor("_b.north"))))
    return rows.withColumn("cell_lon", F.explode(F.sequence(F.floor("_b.west"), F.floor("_b.east")))).drop("_b")


def airport_points(shards: DataFrame, airports: DataFrame, radius_nm: float = 5.0) -> DataFrame:
    """Reports of grid shards (cell_lat, cell_lon, lat, lon) within the radius of each airport, once per airport.

    Airports find their reports by cell, so only folders of cells that an airport touches are
    read: the join's keys prune the partitions of the shards.
    """
    kept = shards.columns
    near = airport_cells(airports.select(*[c for c in airports.columns if c in ("ident", "lat", "lon", "elev", "radius_nm")]), radius_nm)
    near = near.select("cell_lat", "cell_lon", F.col("ident").alias("icao"), "elev", F.col("lat").alias("ap_lat"), F.col("lon").alias("ap_lon"),
                       (F.coalesce("radius_nm", F.lit(radius_nm)) if "radius_nm" in near.columns else F.lit(radius_nm)).alias("_reach"))
    rows = dimension_join(shards, near, ["cell_lat", "cell_lon"]).withColumn("distance_nm", geo.equirect_nm("ap_lat", "ap_lon", "lat", "lon"))
    return rows.where(F.col("distance_nm") <= F.col("_reach")).select(*kept, "icao", "elev", "ap_lat", "ap_lon", "distance_nm")


def coverage_steps(points: DataFrame, width: float = SLICE_S) -> DataFrame:
    """What coverage asks of reports, and of the one before in their track, counted within slices of time: a row for each
    slice of a track (``in_slice``), which holds what its neighbours need, and one for each (icao, date, gap).
    Written, since tracks and gaps both read it; reports are shuffled once.

    ``points``: icao, date, hex, now, seq, lat, lon, alt_baro, elev, ap_lat, ap_lon.
    """
    alt, elev = F.col("alt_baro"), F.col("elev")
    inside = geo.equirect_nm("ap_lat", "ap_lon", "lat", "lon") <= RING_NM
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("inside", inside).select(
        *TRACK, "now", "seq", "inside", yes(F.col("inside") & alt.between(elev + CORRIDOR_LOW_FT, elev + CORRIDOR_HIGH_FT)).alias("in_corridor"),
        yes(F.col("inside") & (alt < elev + CORRIDOR_LOW_FT)).alias("descended"), yes(alt <= elev + SURFACE_FT).alias("surface"))
    # sorted by a number first: of two slices it tells the order without comparing keys
    rows = sliced(rows, "now", width).withColumn("_key", F.xxhash64(*TRACK, SLICE))
    w = Window.partitionBy("_key", *TRACK, SLICE).orderBy("now", "seq")
    rows = rows.withColumn("_now1", F.lag("now").over(w)).withColumn("_in1", F.lag("inside").over(w)).withColumn("_more", F.lead(F.lit(1)).over(w))
    rows = rows.withColumn("gap", _gap(F.col("now") - F.col("_now1"))).withColumn("_gap", F.col("gap"))
    per = rows.groupingSets([[*TRACK, SLICE], ["icao", "date", "gap"]], *TRACK, SLICE, "gap").agg(
        (F.grouping("hex") == 0).alias("in_slice"), F.count(F.lit(1)).alias("times"), F.count_if(F.col("_in1") != F.col("inside")).alias("flips"),
        *[F.bool_or(c).alias(c) for c in ("in_corridor", "descended", "surface")], F.max("_gap").alias("widest"),
        F.min("now").alias("first_now"), F.max("now").alias("last_now"),
        F.bool_or(F.when(F.col("_now1").isNull(), F.col("inside"))).alias("first_in"), F.bool_or(F.when(F.col("_more").isNull(), F.col("inside"))).alias("last_in"))
    return stage(per, "coverage-steps")


def _gap(seconds: Column) -> Column:
    return F.when((seconds > 0) & (seconds <= MAX_GAP_S), seconds)


def _edges(steps: DataFrame) -> DataFrame:
    """Slices of tracks, with the gap and the change between a slice and the one before."""
    w = Window.partitionBy(*TRACK).orderBy(SLICE)
    slices = steps.where("in_slice").withColumn("gap", _gap(F.col("first_now") - F.lag("last_now").over(w)))
    return slices.withColumn("flip", F.coalesce(F.lag("last_in").over(w) != F.col("first_in"), F.lit(False)))


def coverage_tracks(points: DataFrame, width: float = SLICE_S) -> DataFrame:
    """One row per (icao, date, hex) and what it did."""
    return _tracks(coverage_steps(points, width))


def _tracks(steps: DataFrame) -> DataFrame:
    return _edges(steps).groupBy(*TRACK).agg(
        F.sum("times").alias("points"), (F.sum("flips") + F.count_if("flip")).alias("transitions"), F.max(F.greatest("gap", "widest")).alias("widest"),
        *[F.bool_or(c).alias(c) for c in ("in_corridor", "descended", "surface")])


def coverage_gaps(points: DataFrame, width: float = SLICE_S) -> DataFrame:
    """Gaps of up to 300 s between reports of tracks with at least three points, counted per icao and date."""
    return _gaps(coverage_steps(points, width))


def _gaps(steps: DataFrame) -> DataFrame:
    row = lambda df, n: df.where(F.col("gap").isNotNull()).select("icao", "date", "gap", n.alias("times"))
    inner, edges = row(steps.where("not in_slice"), F.col("times")), row(_edges(steps), F.lit(1).cast("bigint"))
    # a track of two points has one gap at most, its widest
    short = row(_tracks(steps).where("points = 2").withColumn("gap", F.col("widest")), F.lit(-1).cast("bigint"))
    return inner.unionByName(edges).unionByName(short).groupBy("icao", "date", "gap").agg(F.sum("times").alias("times")).where("times > 0")


def coverage_quality(points: DataFrame, width: float = SLICE_S) -> DataFrame:
    """Per (icao, date): completed, lost and passing tracks, loss rate, gap statistics."""
    steps = coverage_steps(points, width)
    t = _tracks(steps)
    long = F.col("points") >= 3
    passing = long & F.col("in_corridor") & ((F.col("transitions") >= 2) | ~F.col("descended"))
    landing = long & F.col("in_corridor") & (F.col("transitions") < 2) & F.col("descended")
    per = t.groupBy("icao", "date").agg(
        F.count(F.lit(1)).alias("total_tracks"), F.count_if(landing & F.col("surface")).alias("completed"),
        F.count_if(landing & ~F.col("surface")).alias("lost"), F.count_if(passing).alias("through"))
    low = F.col("completed") + F.col("lost")
    per = per.withColumn("low_alt_tracks", low).withColumn("lost_rate", F.when(low > 0, F.col("lost") / low))
    gaps = gap_percentiles(_gaps(steps), ["icao", "date"])
    return per.join(gaps, ["icao", "date"], "left").withColumn("total_gaps", F.coalesce("total_gaps", F.lit(0).cast("bigint")))


def gap_percentiles(gaps: DataFrame, groups: Sequence[str], value: str = "gap", times: str = "times", bucket: float = 1.0) -> DataFrame:
    """Upper median and 90th percentile by rank (no interpolation) of counted values."""
    counted = gaps.groupBy(*groups, value).agg(F.sum(times).alias("_cnt"))
    return exact_rank(counted, groups, value, {
        "median_gap_s": F.floor(F.col("_total") / 2), "p90_gap_s": F.floor(F.col("_total") * 0.9)}, bucket, weight="_cnt"
    ).withColumnRenamed("n", "total_gaps")


def score_termination(rate) -> Column:
    r = geo._c(rate)
    return F.when(r.isNull(), "none").when(r < LOST_GREEN, "green").when(r < LOST_YELLOW, "yellow").otherwise("red")


def score_gap(gap) -> Column:
    g = geo._c(gap)
    return F.when(g.isNull(), "none").when(g < GAP_GREEN_S, "green").when(g < GAP_YELLOW_S, "yellow").otherwise("red")


def overall_score(term: Column, gap: Column) -> Column:
    """The worse of the two; no termination score means none at all."""
    return (
        F.when(term == "none", "none").when(gap == "none", term)
        .when((term == "red") | (gap == "red"), "red").when((term == "yellow") | (gap == "yellow"), "yellow").otherwise("green"))


def _upper_median(values: Column) -> Column:
    v = F.sort_array(F.array_compact(values))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def quality_rollup(per_date: DataFrame) -> DataFrame:
    """Airport scores over its dates (one value per date, so the lists are short)."""
    out = per_date.groupBy("icao").agg(
        F.count(F.lit(1)).alias("num_dates"), F.sum("low_alt_tracks").alias("low_alt_tracks"), F.sum("completed").alias("completed"),
        F.collect_list("median_gap_s").alias("_m"), F.collect_list("p90_gap_s").alias("_p"))
    low = F.col("low_alt_tracks")
    rate = F.when(low > 0, 1.0 - F.col("completed") / low)
    gap, p90 = _upper_median(F.col("_m")), _upper_median(F.col("_p"))
    term, gscore = score_termination(rate), score_gap(gap)
    return out.select(
        "icao", overall_score(term, gscore).alias("score"), F.round(rate, 3).alias("lost_rate"),
        F.round(F.when(low > 0, F.col("completed") / low), 3).alias("completion_rate"),
        F.round(gap, 1).alias("median_gap_s"), F.round(p90, 1).alias("p90_gap_s"), "num_dates", "low_alt_tracks", "completed",
        term.alias("termination_score"), gscore.alias("gap_score"))


# --- runway usage -----------------------------------------------------------

def runway_anchors(runways: DataFrame) -> DataFrame:
    """Landing threshold and heading of every usable runway end.

    One row per normalised number of an airport, the first in (runway, low end,
    high end) order.  Needs ident, ordinal, closed, le_*/he_* (ident, lat, lon, heading).
    """
    def end(no: int, this: str, other: str) -> Column:
        derived = geo.bearing_deg(f"{this}_lat", f"{this}_lon", f"{other}_lat", f"{other}_lon")
        heading = F.coalesce(F.pmod(F.col(f"{this}_heading"), F.lit(360.0)), derived)
        return F.struct(
            F.lit(no).alias("end_no"), idents.runway_number(F.coalesce(f"{this}_ident", F.lit(""))).alias("runway"),
            heading.alias("heading"), F.col(f"{this}_lat").alias("rwy_lat"), F.col(f"{this}_lon").alias("rwy_lon"))

    ends = runways.where(F.coalesce(F.trim("closed"), F.lit("")) != "1").select(
        F.col("ident").alias("icao"), "ordinal", F.explode(F.array(end(0, "le", "he"), end(1, "he", "le"))).alias("e"))
    ends = ends.select("icao", "ordinal", "e.*").where(
        (F.col("runway") != "") & F.col("rwy_lat").isNotNull() & F.col("rwy_lon").isNotNull() & F.col("heading").isNotNull())
    first = ends.groupBy("icao", "runway").agg(F.min_by(
        F.struct("heading", "rwy_lat", "rwy_lon", "ordinal", "end_no"), F.struct("ordinal", "end_no")).alias("a"))
    return first.select("icao", "runway", "a.*")


def field_centers(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("icao").agg(F.avg("rwy_lat").alias("field_lat"), F.avg("rwy_lon").alias("field_lon"))


APPROACH = ["icao", "hex", "visit", "piece"]


def approach_reports(points: DataFrame, ceiling_ft: float = CORRIDOR_HIGH_FT) -> DataFrame:
    """Reports that may vote for a runway: inside the ring and no more than ``ceiling_ft`` above the field.

    ``points`` as from ``shard_by_airport``; reports without a position or height don't vote."""
    height = F.col("alt_baro") - F.col("elev")
    return points.where((geo.equirect_nm("ap_lat", "ap_lon", "lat", "lon") <= RING_NM) & (height <= ceiling_ft))


def usage_from_reports(points: DataFrame, runways: DataFrame, width: float = SLICE_S) -> DataFrame:
    """Runway usage of reports by airport: those low enough, split into approaches, each with its vote."""
    anchors = stage(runway_anchors(runways), "anchors")
    low = approach_reports(points).select("icao", "hex", "now", "seq", "lat", "lon")
    return runway_usage(runway_votes(final_runs(split_approaches(low, field_centers(anchors), width), anchors)))


def split_approaches(points: DataFrame, centers: DataFrame, width: float = SLICE_S) -> DataFrame:
    """Number the approaches of each aircraft: by silences above 600 s (``visit``), then by field
    overpasses, within 0.4 nm and out beyond 1.0 nm again (``piece``).

    The row that cuts still belongs to the approach it ends.  ``before`` is the report before
    in the same approach.
    """
    rows = dimension_join(points, centers, ["icao"])
    rows = rows.withColumn("_d", geo.equirect_nm("field_lat", "field_lon", "lat", "lon")).drop("field_lat", "field_lon")
    return visits_and_pieces(
        rows, ["icao", "hex"], "now", ["seq"], F.col("_d") < NEAR_FIELD_NM, F.col("_d") > FAR_FIELD_NM, VISIT_GAP_S, ["lat", "lon"], width).drop("_d")


def final_runs(pieces: DataFrame, anchors: DataFrame) -> DataFrame:
    """Longest stretch each approach of ``split_approaches`` stays established on each runway's final."""
    seg = pieces.where((F.col("before.lat") != F.col("lat")) | (F.col("before.lon") != F.col("lon")))
    seg = seg.select(*APPROACH, SLICE, "now", "seq", "lat", "lon", F.col("before.lat").alias("lat0"), F.col("before.lon").alias("lon0"))
    seg = dimension_join(seg, anchors, ["icao"])
    box = lambda la, lo: geo.in_approach_box(la, lo, "rwy_lat", "rwy_lon", "heading")
    course = geo.bearing_deg("lat0", "lon0", "lat", "lon")
    ok = box("lat0", "lon0") & box("lat", "lon") & (geo.circular_diff(course, "heading") <= FINAL_TOLERANCE_DEG)
    seg = seg.withColumn("_ok", ok).withColumn("_d", F.when(ok, geo.equirect_nm("lat0", "lon0", "lat", "lon")).otherwise(0.0))
    return longest_runs(seg, [*APPROACH, "runway", "ordinal", "end_no"], "now", ["seq"], "_ok", "_d").withColumnRenamed("run", "run_nm")


def runway_votes(runs: DataFrame) -> DataFrame:
    """One vote per approach: the longest run of at least 0.2 nm; ties to the later box."""
    return runs.where(F.col("run_nm") >= MIN_FINAL_NM).groupBy(*APPROACH).agg(
        F.max_by("runway", F.struct("run_nm", "ordinal", "end_no")).alias("runway"), F.max("run_nm").alias("run_nm"))


def runway_usage(votes: DataFrame) -> DataFrame:
    """Votes per runway as whole percentages of the airport's votes."""
    n = votes.groupBy("icao", "runway").agg(F.count(F.lit(1)).alias("votes"))
    share = 100.0 * F.col("votes") / F.sum("votes").over(Window.partitionBy("icao"))
    return n.withColumn("pct", F.bround(share, 0).cast("bigint")).orderBy("icao", F.desc("pct"))


def wind_favored(winds: DataFrame, runways: DataFrame) -> DataFrame:
    """Runway end with the largest headwind share; the first end wins ties.

    ``winds``: a key, ident, direction; calm or variable winds give no row.
    """
    ends = F.array(*[F.struct(F.lit(i).alias("end_no"), F.col(f"{p}_ident").alias("runway"), F.col(f"{p}_heading").alias("heading"))
                     for i, p in enumerate(("le", "he"))])
    e = runways.select("ident", "ordinal", F.explode(ends).alias("e")).select("ident", "ordinal", "e.*").where(
        F.col("heading").isNotNull() & (F.coalesce("runway", F.lit("")) != ""))
    met = dimension_join(winds.where(F.col("direction").isNotNull()), e, ["ident"])
    off = F.abs(F.col("direction") - F.col("heading"))
    head = F.cos(F.radians(F.when(off > 180, 360 - off).otherwise(off)))
    rest = [c for c in winds.columns]
    return met.groupBy(*rest).agg(
        F.max_by("runway", F.struct(F.round(head, 12), -F.col("ordinal"), -F.col("end_no"))).alias("runway"), F.max(F.round(head, 6)).alias("headwind"))


def longest_runway(runways: DataFrame) -> DataFrame:
    """Longest runway per airport and its lower-numbered end."""
    number = lambda c: F.coalesce(F.regexp_replace(F.col(c), "[^0-9]", "").try_cast("int"), F.lit(99))
    top = runways.groupBy("ident").agg(F.max_by(F.struct("ordinal", "length_ft", "le_ident", "he_ident"), F.struct(
        F.coalesce("length_ft", F.lit(0)), -F.col("ordinal"))).alias("r"))
    out = top.select("ident", "r.*")
    return out.withColumn("lower_end", F.when(number("le_ident") <= number("he_ident"), F.col("le_ident")).otherwise(F.col("he_ident")))
