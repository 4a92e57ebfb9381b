"""Per-aircraft ordered operators: gaps, flights, resampling, trends, trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.times import seconds_of_day
from ..session import stage, tasks_for
from .timeline import HOUR, SLICE, SLICE_S, _join_back, running, sliced, timeline

# Fixed values.
MAX_GAP_S = 300
FLIGHT_GAP_S = 60
EXPIRE_S = 180
MAX_SPEED_KT = 600.0
MAX_SPEED_STEP_KT = 100.0
MIN_ALT_FT = 0
MAX_ALT_FT = 18000
HOLD_S = 5
THIN_S = 10
TRIP_GAP_S = 120
TRIP_MIN_POINTS = 5
TRIP_ALT = (100, 18000)
VISIT_GAP_S = 600
# Rows that a task of gap_marks holds, about.
MARK_ROWS = 1_000_000


def report_gaps(df: DataFrame, key: str = "hex", time: str = "now", order: Sequence[str] = ("seq",), max_gap: float = MAX_GAP_S,
                width: float = SLICE_S) -> DataFrame:
    out = timeline(df, [key], time, order, width=width)
    gap = F.col(time) - F.col(f"prev1.{time}")
    return out.withColumn("gap", gap).where((F.col("gap") > 0) & (F.col("gap") <= max_gap)).drop("prev1")


def flight_numbers(df: DataFrame, key: str = "tail", time: str = "now", order: Sequence[str] = ("seq",), gap: float = FLIGHT_GAP_S,
                   width: float = SLICE_S) -> DataFrame:
    """``flight_no`` and ``flight_id`` (tail_N); a silence above ``gap`` starts a new flight."""
    out = timeline(df, [key], time, order, gap=gap, width=width).withColumnRenamed("session_no", "flight_no")
    return out.withColumn("flight_id", F.concat_ws("_", F.col(key), F.col("flight_no").cast("string"))).drop("prev1")


def life_segments(df: DataFrame, key: str = "tail", time: str = "now", order: Sequence[str] = ("seq",), expire: float = EXPIRE_S,
                  width: float = SLICE_S) -> DataFrame:
    out = timeline(df, [key], time, order, gap=expire, width=width)
    return out.withColumnRenamed("session_no", "life_no").drop("prev1")


def carry_forward(df: DataFrame, columns: Sequence[str] = ("category", "squawk", "emergency"), key: str = "tail", time: str = "now",
                  order: Sequence[str] = ("seq",), width: float = SLICE_S) -> DataFrame:
    """Latest known value of periodically sent attributes within one life.

    Needs ``life_no``.  Whether a report has the key is told by a column
    ``has_<name>``, else by the list ``attrs`` of its keys, so that a present null is
    not replaced; without either, by the value.  ``attrs`` gains the carried keys.
    """
    def present(c: str) -> Column:
        if f"has_{c}" in df.columns:
            return F.col(f"has_{c}")
        return F.coalesce(F.array_contains("attrs", c), F.lit(False)) if "attrs" in df.columns else F.col(c).isNotNull()

    filled = running(
        df, [key, "life_no"], time, order, width=width, lasts={f"_k_{c}": F.when(present(c), F.struct(F.col(c).alias("v"))) for c in columns})
    if "attrs" in df.columns:
        known = F.array_compact(F.array(*[F.when(F.col(f"_k_{c}").isNotNull(), F.lit(c)) for c in columns]))
        filled = filled.withColumn("attrs", F.array_union(F.coalesce("attrs", F.array().cast("array<string>")), known))
    for c in columns:
        filled = filled.withColumn(c, F.col(f"_k_{c}.v")).drop(f"_k_{c}")
    return filled


def prefilter(df: DataFrame, min_alt: int = MIN_ALT_FT, max_alt: int = MAX_ALT_FT) -> DataFrame:
    """Reports the resampler accepts: a tail and an altitude inside the window."""
    return df.where(F.col("tail").isNotNull() & F.col("alt_baro").between(min_alt, max_alt))


def speed_kt(a: Column, b: Column, seconds: Column) -> Column:
    return geo.haversine_nm(a["lat"], a["lon"], b["lat"], b["lon"]) / (seconds / 3600.0)


def flight_steps(df: DataFrame, carry: Sequence[str] = ("category",), key: str = "tail", time: str = "now",
                 order: Sequence[str] = ("seq",), width: float = SLICE_S) -> DataFrame:
    """One row per real report with its predecessor in the same flight.

    ``prev`` is null at a flight's first report.  ``suspicious`` marks an implied
    speed above 600 kt, or a change of more than 100 kt against the step before.
    """
    fields = ["lat", "lon", "alt_baro", "gs", "track", *carry]
    out = timeline(df, [key], time, order, lag=fields, depth=2, gap=FLIGHT_GAP_S, following=True, width=width)
    here = F.struct("lat", "lon")
    gap = F.col(time) - F.col(f"prev1.{time}")
    gap2 = F.col(f"prev1.{time}") - F.col(f"prev2.{time}")
    tested = (gap > 1) & (gap <= FLIGHT_GAP_S)
    speed = F.when(tested, speed_kt(F.col("prev1"), here, gap))
    speed2 = F.when((gap2 > 0) & (gap2 <= FLIGHT_GAP_S), speed_kt(F.col("prev2"), F.col("prev1"), gap2))
    teleport = F.coalesce(speed > MAX_SPEED_KT, F.lit(False))
    jump = ~teleport & F.coalesce(F.abs(speed - speed2) > MAX_SPEED_STEP_KT, F.lit(False))
    return (
        out.withColumn("flight_id", F.concat_ws("_", F.col(key), F.col("session_no").cast("string")))
        .withColumn("teleport", teleport)
        .withColumn("speed_jump", jump)
        .withColumn("suspicious", F.col("teleport") | F.col("speed_jump"))
        .withColumn("prev", F.when(gap <= FLIGHT_GAP_S, F.col("prev1")))
        .withColumnRenamed("session_no", "flight_no")
        .drop("prev1", "prev2")
    )


def staged_steps(steps: DataFrame) -> DataFrame:
    """``flight_steps`` output, what ``resample`` reads of it, written to the shared folder: for what reads the seconds
    more than once."""
    return stage(steps.select("tail", "flight_id", "hex", "seq", "now", "lat", "lon", "alt_baro", "gs", "track", "suspicious", "prev"), "steps")


def second_of(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def interpolated(prev: Column, cur: dict[str, Column], now: Column, at: Column) -> dict[str, Column]:
    """Position at second ``at`` between two reports; altitude truncates to int
    and track follows the shorter arc."""
    f = (at.cast("double") - prev["now"]) / (now - prev["now"])
    out = {c: prev[c] + f * (cur[c] - prev[c]) for c in cur}
    if "alt_baro" in cur:
        out["alt_baro"] = out["alt_baro"].cast("bigint")
    if "track" in cur:
        turn = cur["track"] - prev["track"]
        turn = F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
        out["track"] = F.pmod(prev["track"] + f * turn, F.lit(360.0))
    return out


def resample(steps: DataFrame) -> DataFrame:
    """One row per aircraft and second from ``flight_steps`` output.

    Every real report keeps its row; each whole second strictly between two
    reports of a flight gets an interpolated one.
    """
    last = second_of(F.col("now"))
    first = second_of(F.col("prev.now")) + 1
    fill = (F.col("now") - F.col("prev.now") > 1) & (first < last)
    secs = F.when(fill, F.sequence(first, last)).otherwise(F.array(last))
    # never empty; before a plain explode Spark puts a filter that works the seconds out, too
    rows = steps.withColumn("sec", F.explode_outer(secs))
    real = F.col("sec") == last
    cols = ("lat", "lon", "alt_baro", "gs", "track")
    mid = interpolated(F.col("prev"), {c: F.col(c) for c in cols}, F.col("now"), F.col("sec"))
    rows = rows.withColumn("resampled", ~real)
    return rows.select(
        "sec", "tail", "flight_id", "hex", "seq",
        F.when(real, F.col("now")).otherwise(F.col("sec").cast("double")).alias("now"),
        *[F.when(real, F.col(c)).otherwise(mid[c]).alias(c) for c in cols],
        "resampled", "suspicious",
    )


def altitude_trend(df: DataFrame, key: str = "tail", time: str = "now", order: Sequence[str] = ("seq",), entries: int = 5,
                   expire: float = EXPIRE_S, width: float = SLICE_S) -> DataFrame:
    """+1 climbing, -1 descending, 0 level: altitude against the truncated mean of
    up to five earlier reports of the same life."""
    out = timeline(df, [key], time, order, lag=["alt_baro"], depth=entries, width=width)
    total, count, linked, later = F.lit(0.0), F.lit(0), F.lit(True), F.col(time)
    for i in range(1, entries + 1):
        linked = linked & F.coalesce(later - F.col(f"prev{i}.{time}") <= expire, F.lit(False))
        total = total + F.when(linked, F.col(f"prev{i}.alt_baro")).otherwise(0)
        count = count + F.when(linked, 1).otherwise(0)
        later = F.col(f"prev{i}.{time}")
    mean = F.when(count > 0, (total / count).cast("bigint")).otherwise(F.col("alt_baro").cast("bigint"))
    return out.withColumn("trend", F.signum((F.col("alt_baro") - mean).cast("double")).cast("int")).drop(
        *[f"prev{i}" for i in range(1, entries + 1)])


def trip_points(df: DataFrame, key: str = "hex", time: str = "now", order: Sequence[str] = ("seq",), width: float = SLICE_S) -> DataFrame:
    """First report per 10 s bucket between 100 and 18000 ft, numbered into
    segments at silences above 120 s."""
    kept = df.where(F.col("alt_baro").between(*TRIP_ALT)).withColumn("bucket", F.floor(F.col(time) / THIN_S))
    thin = kept.groupBy(key, "bucket").agg(
        F.min_by(F.struct(F.col(time).alias("now"), "lat", "lon"), F.struct(*(order or [time]))).alias("p"))
    points = thin.select(key, "bucket", F.col("p.now").alias("now"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))
    return timeline(points, [key], "now", ["bucket"], gap=TRIP_GAP_S, width=width).drop("prev1").withColumnRenamed("session_no", "segment")


def trips(points: DataFrame, key: str = "hex", part_s: float = HOUR) -> DataFrame:
    """Paths of segments with at least five points, in parts of bounded length.

    A part covers ``part_s`` seconds, so at most part_s / 10 points are collected
    into one row; the parts of a segment concatenate to its path.
    """
    parts = points.withColumn("part", F.floor(F.col("now") / part_s)).groupBy(key, "segment", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("now", "lon", "lat"))).alias("pts"))
    sizes = parts.groupBy(key, "segment").agg(F.sum("n").alias("points")).where(F.col("points") >= TRIP_MIN_POINTS)
    return parts.join(sizes, [key, "segment"]).select(
        key, "segment", "part", "points",
        F.transform("pts", lambda p: F.array(p["lon"], p["lat"])).alias("path"),
        F.transform("pts", lambda p: seconds_of_day(p["now"])).alias("timestamps"))


def gap_marks(df: DataFrame, keys: Sequence[str], time: str = "sec", order: Sequence[str] = (), threshold: float = 2.0,
              width: float = SLICE_S) -> DataFrame:
    """``in_gap``: member of an interpolated run longer than ``threshold`` seconds,
    or reached by a time step longer than it.

    A run starts at a real report. Rows are counted, then shuffled once, by slice, in tasks of about ``MARK_ROWS``; put
    ``session.stage`` before what makes them if that is expensive. Runs are measured in their slice; a slice's first
    and last run, which may go on in others, are put together from one row a slice.
    """
    part = [*keys, SLICE]
    dealt = sliced(df, time, width).repartition(tasks_for(df, MARK_ROWS), *part)
    made = F.when(F.col("resampled"), F.col(time))
    at = Window.partitionBy(*part).orderBy(time, *order)
    real = F.sum(F.when(F.col("resampled"), 0).otherwise(1)).over(at.rowsBetween(Window.unboundedPreceding, 0))
    local = dealt.withColumns({"_before": F.lag(time).over(at), "_run": real})
    extent = F.struct(F.min(made).alias("lo"), F.max(made).alias("hi"))
    runs = local.groupBy(*part, "_run").agg(extent.alias("_x"), F.max(time).alias("_t1"))
    ends = runs.groupBy(*part).agg(
        F.max("_t1").alias("_t1"), F.max("_run").alias("_runs"), F.max(F.when(F.col("_run") == 0, F.col("_x"))).alias("_first"), F.max_by("_x", "_run").alias("_last"))
    by_key = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_ended": F.lag("_t1").over(by_key), "_no": F.coalesce(F.sum("_runs").over(earlier), F.lit(0))})
    # the runs at both ends by their number within the key
    piece = lambda no, x, first: F.struct(no.alias("no"), F.col(x)["lo"].alias("lo"), F.col(x)["hi"].alias("hi"), F.lit(first).alias("first"))
    pieces = ends.select(*part, "_ended", "_runs", F.explode(F.array(
        piece(F.col("_no"), "_first", True), piece(F.col("_no") + F.col("_runs"), "_last", False))).alias("_p"))
    whole = Window.partitionBy(*keys, "_p.no")
    pieces = pieces.withColumn("_x", F.max("_p.hi").over(whole) - F.min("_p.lo").over(whole))
    carry = pieces.groupBy(*part).agg(
        F.first("_ended").alias("_ended"), F.first("_runs").alias("_runs"),
        F.max(F.when(F.col("_p.first"), F.col("_x"))).alias("_x0"), F.max(F.when(~F.col("_p.first"), F.col("_x"))).alias("_x1"))
    run = Window.partitionBy(*part, "_run")
    out = _join_back(local.withColumn("_x", F.max(made).over(run) - F.min(made).over(run)), carry, part)
    jump = F.coalesce(F.col(time) - F.coalesce("_before", "_ended") > threshold, F.lit(False))
    long_run = F.when(F.col("_run") == 0, F.col("_x0")).when(F.col("_run") == F.col("_runs"), F.col("_x1")).otherwise(F.col("_x")) > threshold
    return out.withColumn("in_gap", jump | (F.col("resampled") & F.coalesce(long_run, F.lit(False)))).select(*df.columns, "in_gap")


def heartbeats(reports: DataFrame, every: int = 20, time: str = "now", width: float = SLICE_S) -> DataFrame:
    """Beats (``sec``) that keep a clock running through silence: every ``every``-th second from the first
    report to the last, where no aircraft reports.

    Distinct seconds are found first; a gap between two of them gives its beats, so what is made
    is the beats and not the seconds.
    """
    secs = reports.select(second_of(F.col(time)).alias("sec")).where("sec is not null").distinct()
    secs = stage(secs, "seconds")
    ahead = running(secs, [], "sec", [], nexts={"_next": F.col("sec")}, inclusive=False, width=width)
    first = secs.agg(F.min("sec")).scalar()
    beat = first + F.ceil((F.col("sec") + 1 - first) / every).cast("bigint") * every
    gaps = ahead.withColumn("_beat", beat).where(F.col("_beat") < F.col("_next"))
    return gaps.select(F.explode(F.sequence("_beat", F.col("_next") - 1, F.lit(every).cast("bigint"))).alias("sec"))
