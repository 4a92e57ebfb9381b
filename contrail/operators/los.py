"""Loss-of-separation events: sessions of proximity hits, features, score, rows."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, labels
from ..functions.times import as_timestamp
from ..session import stage
from . import folds, proximity, sequence
from .proximity import nearest_in_time
from .skew import dimension_join
from .timeline import HOUR, SLICE_S, fitted_width, timeline

# Fixed values of the event score.
LATERAL_NM, VERTICAL_FT = 0.3, 400.0
QUIET_S = 61
CLOSE_S = 61
LONG_S, MODERATE_S = 90, 30
SHORT_TRACK_S, THIN_TRACK_S = 60, 120
VERY_CLOSE_NM, VERY_CLOSE_FT = 0.2, 200
CPA_WINDOW_S, CPA_RADIUS_NM = 10, 0.5
SPARSE_SHARE, SPARSE_MIN_S = 0.10, 5
TELEPORT_KT, TELEPORT_MIN_S = 300.0, 5
FORMATION_NM, FORMATION_SHARE, FORMATION_START_NM = 0.6, 0.5, 1.0
MATCH_S = 5
BEFORE_CPA_S, AFTER_CPA_S = 120, 60
HELICOPTER = "A7"
NEAR_AIRPORT_NM, AIRPORT_AGL_FT, OPEN_FLOOR_FT = 5.0, 200, 50
LOOKUP_S = 60


def sessions(hits: DataFrame, quiet: int = QUIET_S, width: float = SLICE_S) -> DataFrame:
    """Number the hits of each pair into events (``event_no``).

    A new event starts when the check second is more than ``quiet`` after the
    previous hit's newest position time.
    """
    rows = hits.withColumn("last_now", F.greatest("now1", "now2"))
    out = timeline(rows, ["tail1", "tail2"], "sec", (), gap=quiet, end="last_now", width=width)
    return out.withColumnRenamed("session_no", "event_no").drop("prev1")


EVENT_KEYS = ["tail1", "tail2", "event_no"]


def event_rows(numbered: DataFrame, width: float = SLICE_S) -> DataFrame:
    """One row per event: times, closest approach, true minima."""
    adopted = folds.closest_approach(numbered, EVENT_KEYS, "sec", (), "lateral_nm", "alt_sep_ft", width)
    last = adopted.groupBy(*EVENT_KEYS).agg(F.max("sec").alias("sec"))
    fields = ["last_now", "lat1", "lon1", "alt_baro1", "lat2", "lon2", "alt_baro2", "flight_id1", "flight_id2", "lateral_nm", "alt_sep_ft"]
    # one position per event: unique keys on both sides
    cpa = numbered.join(last, [*EVENT_KEYS, "sec"]).select(*EVENT_KEYS, F.struct("sec", *fields).alias("cpa"))
    out = numbered.groupBy(*EVENT_KEYS).agg(
        F.min("last_now").alias("create_time"),
        F.max("last_now").alias("last_time"),
        F.count(F.lit(1)).alias("hits"),
        F.min("lateral_nm").alias("true_min_lateral_nm"),
        F.min("alt_sep_ft").alias("true_min_alt_sep_ft"),
    ).join(cpa, EVENT_KEYS)
    mean = geo.mean_location("cpa.lat1", "cpa.lon1", "cpa.alt_baro1", "cpa.lat2", "cpa.lon2", "cpa.alt_baro2")
    return out.select(
        *EVENT_KEYS, "create_time", "last_time", "hits", "true_min_lateral_nm", "true_min_alt_sep_ft",
        F.col("cpa.last_now").alias("cpa_time"),
        F.col("cpa.lateral_nm").alias("lateral_nm"), F.col("cpa.alt_sep_ft").alias("alt_sep_ft"),
        F.col("cpa.flight_id1").alias("flight_id1"), F.col("cpa.flight_id2").alias("flight_id2"),
        mean["lat"].alias("lat"), mean["lon"].alias("lon"), mean["alt"].alias("alt_ft"),
        (F.col("last_time") - F.col("create_time")).alias("duration_s"),
    )


# --- features ---------------------------------------------------------------

def flight_summary(steps: DataFrame) -> DataFrame:
    """Span, category and first teleport of every flight; partial aggregates only."""
    gap = F.col("now") - F.col("prev.now")
    speed = F.when(gap > TELEPORT_MIN_S, sequence.speed_kt(F.col("prev"), F.struct("lat", "lon"), gap))
    bad = F.when(speed > TELEPORT_KT, F.struct(F.col("now"), speed.alias("kt"), F.col("prev.now").alias("t0")))
    return steps.groupBy("flight_id").agg(
        F.min("now").alias("start"), F.max("now").alias("stop"), F.count(F.lit(1)).alias("reports"),
        F.max_by("category", F.struct("now", "seq")).alias("category"),
        F.min(bad).alias("teleport"),
    )


def _members(events: DataFrame) -> DataFrame:
    """Two rows per event, one for each aircraft."""
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"flight_id{i}").alias("flight_id")) for i in (1, 2)])
    return events.withColumn("_m", F.explode(sides)).select("*", "_m.*").drop("_m")


def window_features(events: DataFrame, steps: DataFrame, spans: DataFrame) -> DataFrame:
    """What an event's reports say, from one look-up of each flight's reports near it.

    ``near1, near2``: real reports near the closest approach; ``during1, during2``: those during the
    event, if it is short; ``initial_sep_nm``: distance at the start of the common track (not before
    cpa - 120 s), null if a flight has no report near it. The windows are bounded, so events and
    reports meet per flight and minute; no flight is read as a whole.
    """
    e = events
    for i in (1, 2):
        e = e.join(spans.select(F.col("flight_id").alias(f"flight_id{i}"), F.col("start").alias(f"start{i}")), f"flight_id{i}", "left")
    cpa, t0 = F.col("cpa_time"), F.col("_t0")
    m = _members(e.withColumn("_t0", F.greatest("start1", "start2", cpa - BEFORE_CPA_S)).withColumn("_short", F.col("duration_s") <= MODERATE_S))
    start = F.least(cpa - CPA_WINDOW_S, F.when(F.col("_short"), F.col("create_time")), t0 - MATCH_S)
    stop = F.greatest(cpa + CPA_WINDOW_S, F.when(F.col("_short"), F.col("last_time")), t0 + MATCH_S)
    m = m.withColumn("_b", F.explode(F.sequence(F.floor(start / LOOKUP_S), F.floor(stop / LOOKUP_S))))
    m = m.select(*EVENT_KEYS, "side", "flight_id", "_b", "create_time", "last_time", "cpa_time", "_t0", "_short", F.col("lat").alias("elat"), F.col("lon").alias("elon"))
    reports = steps.select("flight_id", F.floor(F.col("now") / LOOKUP_S).alias("_b"), "now", "seq", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    now, off = F.col("now"), F.abs(F.col("now") - t0)
    near = (F.abs(now - cpa) <= CPA_WINDOW_S) & (geo.haversine_nm("rlat", "rlon", "elat", "elon") <= CPA_RADIUS_NM)
    during = F.col("_short") & now.between(F.col("create_time"), F.col("last_time"))
    counts = [F.count_if((F.col("side") == i) & test).alias(f"{name}{i}") for name, test in (("near", near), ("during", during)) for i in (1, 2)]
    first = [F.min_by(F.struct("rlat", "rlon"), F.when((F.col("side") == i) & (off <= MATCH_S), F.struct(off, "now", "seq"))).alias(f"_n{i}") for i in (1, 2)]
    per = m.join(reports, ["flight_id", "_b"]).groupBy(*EVENT_KEYS).agg(*counts, *first)
    return per.withColumn("initial_sep_nm", geo.haversine_nm("_n1.rlat", "_n1.rlon", "_n2.rlat", "_n2.rlon")).drop("_n1", "_n2")


def window_counts(events: DataFrame, steps: DataFrame) -> DataFrame:
    return window_features(events, steps, flight_summary(steps)).drop("initial_sep_nm")


def initial_separation(events: DataFrame, steps: DataFrame, spans: DataFrame) -> DataFrame:
    return window_features(events, steps, spans).select(*EVENT_KEYS, "initial_sep_nm")


def proximity_ratio(events: DataFrame, steps: DataFrame, spans: DataFrame, width: float = SLICE_S) -> DataFrame:
    """Share of flight 1's reports, paired in time with one of flight 2, that are
    within 0.6 nm; per pair of flights.

    Only reports inside the common span can be paired, and they are fetched per
    flight and hour.
    """
    one = spans.select(F.col("flight_id").alias("flight_id1"), F.col("start").alias("s1"), F.col("stop").alias("e1"))
    two = spans.select(F.col("flight_id").alias("flight_id2"), F.col("start").alias("s2"), F.col("stop").alias("e2"))
    pairs = events.select("flight_id1", "flight_id2").distinct().join(one, "flight_id1").join(two, "flight_id2")
    pairs = pairs.withColumn("_from", F.greatest("s1", "s2") - MATCH_S).withColumn("_to", F.least("e1", "e2") + MATCH_S)
    pairs = pairs.where(F.col("_from") <= F.col("_to"))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"flight_id{i}").alias("flight_id")) for i in (1, 2)])
    hours = F.sequence(F.floor(F.col("_from") / HOUR), F.floor(F.col("_to") / HOUR))
    asked = pairs.withColumn("_h", F.explode(hours)).withColumn("_m", F.explode(sides)).select(
        "flight_id1", "flight_id2", "_from", "_to", "_h", "_m.*")
    reports = steps.select("flight_id", F.floor(F.col("now") / HOUR).alias("_h"), "now", "seq", "lat", "lon")
    got = asked.join(reports, ["flight_id", "_h"]).where(F.col("now").between(F.col("_from"), F.col("_to")))
    keys = ["flight_id1", "flight_id2"]
    a = got.where(F.col("side") == 1).select(*keys, "now", "seq", "lat", "lon")
    b = got.where(F.col("side") == 2).select(*keys, "now", "seq", "lat", "lon")
    near = nearest_in_time(a, b, keys, "now", ["lat", "lon"], ["seq"], MATCH_S, width).where(F.col("b_now").isNotNull())
    close = geo.haversine_nm("lat", "lon", "b_lat", "b_lon") <= FORMATION_NM
    return near.groupBy(*keys).agg(F.count(F.lit(1)).alias("paired"), (F.count_if(close) / F.count(F.lit(1))).alias("close_ratio"))


def features(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Everything the score reads, one row per event."""
    spans = stage(flight_summary(steps), "spans")  # read six times below
    out = events
    for i in (1, 2):
        one = spans.select(
            F.col("flight_id").alias(f"flight_id{i}"), F.col("start").alias(f"start{i}"), F.col("stop").alias(f"stop{i}"),
            F.col("category").alias(f"category{i}"), F.col("teleport").alias(f"teleport{i}"))
        out = out.join(one, f"flight_id{i}", "left")
    closed = F.col("last_time") + CLOSE_S
    for i in (1, 2):
        out = out.withColumn(f"track_s{i}", F.least(F.col(f"stop{i}"), closed) - F.col(f"start{i}"))
    out = out.join(window_features(events, steps, spans), EVENT_KEYS, "left").fillna(0, ["near1", "near2", "during1", "during2"])
    return out.join(proximity_ratio(events, steps, spans), ["flight_id1", "flight_id2"], "left")


# --- score ------------------------------------------------------------------

def score(feats: DataFrame) -> DataFrame:
    """``quality`` and ``quality_explanation``; later checks overwrite earlier ones."""
    dur = F.col("duration_s")
    track = F.least("track_s1", "track_s2")
    sep0 = F.col("initial_sep_nm")
    formation = sep0.isNull() | (sep0 <= FORMATION_START_NM)
    helicopter = F.coalesce(F.col("category1") == HELICOPTER, F.lit(False)) | F.coalesce(F.col("category2") == HELICOPTER, F.lit(False))
    very_close = (F.col("lateral_nm") < VERY_CLOSE_NM) & (F.abs("alt_sep_ft") < VERY_CLOSE_FT)
    minutes, track_min = dur / 60.0, track / 60.0

    def verdict(quality: str, text: Column) -> Column:
        return F.struct(F.lit(quality).alias("q"), text.alias("why"))

    brief = F.format_string("brief event %.1fmin with good tracks", minutes)
    base = (
        F.when((dur > LONG_S) & formation, verdict("low", F.format_string("long duration %.1fmin - likely formation flight", minutes)))
        .when(dur > LONG_S, verdict("medium", F.format_string("long duration %.1fmin but started separated (%.1f nm)", minutes, sep0)))
        .when(helicopter, verdict("low", F.lit("helicopter involved")))
        .when(track < SHORT_TRACK_S, verdict("low", F.format_string("short track %.1fmin - insufficient data", track_min)))
        .when(dur > MODERATE_S, verdict("medium", F.format_string("moderate duration %.1fmin - may be formation flight", minutes)))
        .when(very_close, verdict("vhigh", F.concat(brief, F.format_string("; very close CPA (%.2fnm, %.0fft)", F.col("lateral_nm"), F.abs("alt_sep_ft")))))
        .otherwise(verdict("high", brief))
    )

    def either(test, quality: str, text) -> Column:
        """The first aircraft failing the test names itself; null if none does."""
        return F.when(test(1), verdict(quality, text(1))).when(test(2), verdict(quality, text(2)))

    no_data = either(
        lambda i: F.col(f"near{i}") == 0, "low",
        lambda i: F.concat(F.lit("no sane data near CPA "), f"flight_id{i}", F.lit(f": 0 real in ±{CPA_WINDOW_S}s within {CPA_RADIUS_NM}nm")))
    sparse = either(
        lambda i: F.col(f"during{i}") / dur < SPARSE_SHARE, "medium",
        lambda i: F.concat(F.lit("sparse data during LOS "), f"flight_id{i}", F.format_string(": %d real during %.0fs event", F.col(f"during{i}"), dur)))
    teleport = either(
        lambda i: F.col(f"teleport{i}").isNotNull(), "low",
        lambda i: F.concat(F.lit("teleportation "), f"flight_id{i}", F.format_string(
            ": %.0fkts between t=%.0f-%.0f", F.col(f"teleport{i}.kt"), F.col(f"teleport{i}.t0"), F.col(f"teleport{i}.now"))))
    sustained = F.when(
        formation & (F.col("close_ratio") >= FORMATION_SHARE),
        verdict("low", F.format_string(
            f"sustained proximity (%.0f%% of %d paired samples within {FORMATION_NM}nm — likely formation flight or coverage gap)",
            F.col("close_ratio") * 100, F.col("paired"))))
    ended = either(
        lambda i: F.col(f"stop{i}") < F.col("create_time"), "low",
        lambda i: F.concat(F.lit("track ended before LOS "), f"flight_id{i}", F.format_string(
            ": last real %.0fs before event", F.col("create_time") - F.col(f"stop{i}"))))

    out = feats.withColumn("_v", base)
    out = out.withColumn("_v", F.coalesce(no_data, "_v"))
    graded = F.col("_v.q").isin("high", "vhigh") & (dur > SPARSE_MIN_S)
    out = out.withColumn("_v", F.when(graded, F.coalesce(sparse, "_v")).otherwise(F.col("_v")))
    for check in (teleport, sustained, ended):
        out = out.withColumn("_v", F.coalesce(check, "_v"))
    suffix = F.when(~F.col("_v.q").isin("low", "vhigh") & (track < THIN_TRACK_S), F.format_string("; track=%.1fmin", track_min)).otherwise("")
    return out.withColumn("quality", F.col("_v.q")).withColumn("quality_explanation", F.concat("_v.why", suffix)).drop("_v")


def steps_near(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps that can touch the track window of an event: of its flights, by minute. Only they need to be resampled."""
    lo, hi = F.floor("cpa_time") - BEFORE_CPA_S, F.floor("cpa_time") + AFTER_CPA_S + sequence.FLIGHT_GAP_S
    asked = _members(events).select("flight_id", F.explode(F.sequence(F.floor(lo / LOOKUP_S), F.floor(hi / LOOKUP_S))).alias("_b")).distinct()
    return steps.withColumn("_b", F.floor(F.col("now") / LOOKUP_S)).join(asked, ["flight_id", "_b"], "left_semi").drop("_b")


def tracks(events: DataFrame, resampled: DataFrame) -> DataFrame:
    """``track1`` and ``track2``: points from 120 s before to 60 s after the closest
    approach, at most one per second each."""
    lo, hi = F.floor("cpa_time") - BEFORE_CPA_S, F.floor("cpa_time") + AFTER_CPA_S
    m = _members(events).withColumn("_b", F.explode(F.sequence(F.floor(lo / LOOKUP_S), F.floor(hi / LOOKUP_S))))
    m = m.select(*EVENT_KEYS, "side", "flight_id", "_b", lo.alias("_lo"), hi.alias("_hi"))
    pts = resampled.select("flight_id", F.floor(F.col("sec") / LOOKUP_S).alias("_b"), "sec", "lat", "lon", "alt_baro", F.col("resampled").cast("int").alias("r"))
    got = m.join(pts, ["flight_id", "_b"]).where(F.col("sec").between(F.col("_lo"), F.col("_hi")))
    point = F.struct(F.col("sec").alias("t"), "lat", "lon", F.col("alt_baro").alias("alt_ft"), F.col("r").alias("resampled"))
    rows = got.groupBy(*EVENT_KEYS).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("side") == i, point))).alias(f"track{i}") for i in (1, 2)])
    return events.join(rows, EVENT_KEYS, "left")


def airborne(events: DataFrame, airports: DataFrame, event_id: list[str] = EVENT_KEYS) -> DataFrame:
    """Drop ground traffic: within 5 nm of an airport the altitude must exceed its
    elevation by 200 ft, elsewhere 50 ft.

    ``airports``: ident, lat, lon, elev, ordinal.  Of several airports in range
    the lowest ordinal decides.
    """
    near = nearest_airports(events, airports, event_id)
    elev = near.groupBy(*event_id).agg(F.min_by("airport_elev", "ordinal").alias("field_elev"))
    out = events.join(elev, event_id, "left")
    return out.where(F.col("alt_ft") > F.coalesce(F.col("field_elev") + AIRPORT_AGL_FT, F.lit(OPEN_FLOOR_FT)))


AIRPORT_CELL_DEG = 0.25


def nearest_airports(points: DataFrame, airports: DataFrame, row_id: list[str], radius_nm: float = NEAR_AIRPORT_NM, merge: bool = True) -> DataFrame:
    """All (row, airport) pairs within ``radius_nm``: airports are copied to the grid
    cells their circle touches, points meet them by cell.  ``row_id`` lists the
    point columns to keep.  Airports at the same place (four decimals) count as one,
    the first, unless ``merge`` is off.  A column ``radius_nm`` of an airport, where
    not null, replaces the radius."""
    own = F.coalesce("radius_nm", F.lit(float(radius_nm))) if "radius_nm" in airports.columns else F.lit(float(radius_nm))
    dim = airports.select("ordinal", "ident", "lat", "lon", "elev", own.alias("reach_nm"))
    if merge:
        dim = dim.groupBy(F.round("lat", 4).alias("_a"), F.round("lon", 4).alias("_o")).agg(F.min(F.struct(*dim.columns)).alias("p")).select("p.*")
    dy = F.col("reach_nm") / geo.NM_PER_DEGREE
    dx = geo.lon_reach(dy, "lat")
    for axis, col, reach in (("cy", "lat", dy), ("cx", "lon", dx)):
        dim = dim.withColumn(axis, F.explode(F.sequence(
            F.floor((F.col(col) - reach) / AIRPORT_CELL_DEG), F.floor((F.col(col) + reach) / AIRPORT_CELL_DEG))))
    dim = dim.select("cy", "cx", F.col("lat").alias("airport_lat"), F.col("lon").alias("airport_lon"), F.col("elev").alias("airport_elev"), "ident", "ordinal", "reach_nm")
    probe = points.select(*dict.fromkeys([*row_id, "lat", "lon"])).withColumn("cy", F.floor(F.col("lat") / AIRPORT_CELL_DEG)).withColumn(
        "cx", F.floor(F.col("lon") / AIRPORT_CELL_DEG))
    met = dimension_join(probe, dim, ["cy", "cx"])
    met = met.withColumn("distance_nm", geo.equirect_nm("airport_lat", "airport_lon", "lat", "lon"))
    return met.where(F.col("distance_nm") <= F.col("reach_nm")).drop("cy", "cx", "reach_nm")


def deduplicate(events: DataFrame) -> DataFrame:
    """First of each (flight1, flight2, timestamp); an aggregate, so it combines map-side."""
    rest = [c for c in events.columns if c not in ("flight1", "flight2", "timestamp")]
    kept = events.groupBy("flight1", "flight2", "timestamp").agg(F.min(F.struct(*rest)).alias("_r"))
    return kept.select("flight1", "flight2", "timestamp", "_r.*").select(*events.columns)


def event_table(scored: DataFrame) -> DataFrame:
    """The 16-column event table."""
    track = lambda i: F.to_json(F.transform(f"track{i}", lambda p: F.array(
        p["t"].cast("double"), p["lat"], p["lon"], p["alt_ft"].cast("double"), p["resampled"].cast("double"))))
    return scored.select(
        F.col("cpa_time").alias("timestamp"), F.date_format(as_timestamp("cpa_time"), "yyyy-MM-dd'T'HH:mm:ss").alias("datetime_utc"),
        "lat", "lon", "alt_ft", labels.altitude_label("alt_ft").alias("alt_band"),
        F.trim("tail1").alias("flight1"), F.trim("tail2").alias("flight2"), "lateral_nm", "alt_sep_ft", "duration_s",
        "quality", "quality_explanation", F.lit("").alias("animation_path"), track(1).alias("track1"), track(2).alias("track2"))


def detect(reports: DataFrame, lateral_nm: float = LATERAL_NM, vertical_ft: float = VERTICAL_FT, hold: int = sequence.HOLD_S,
           isolate_by: tuple[str, ...] = (), width: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports to numbered hits.  Returns (steps, hits), both staged tables.

    ``isolate_by`` names columns that must agree within a pair and that also break
    tracks, for comparison with runs that analysed cells on their own.  Without a
    ``width`` the slices are fitted to the busiest aircraft.
    """
    rows = sequence.prefilter(reports)
    width = fitted_width(rows, ["tail"], "now") if width is None else width
    if isolate_by:
        own = F.concat_ws("|", "tail", *isolate_by)
        rows = rows.withColumn("_tail", F.col("tail")).withColumn("tail", own)
    steps = stage(sequence.flight_steps(rows, carry=["category"], width=width), "steps")
    pieces = proximity.track_pieces(steps, hold=hold, keep=["tail", "flight_id", "seq", *isolate_by])
    hits = proximity.near_pairs(pieces, lateral_nm, vertical_ft)
    for c in isolate_by:
        hits = hits.where(F.col(f"{c}1") == F.col(f"{c}2"))
    # the hits are read several times below; the join that finds them runs once
    return steps, stage(sessions(stage(hits, "pairs"), width=width), "hits")


def los_events(reports: DataFrame, airports: DataFrame | None = None, with_tracks: bool = True, **options) -> DataFrame:
    """Whole chain: reports to the 16-column event table."""
    steps, hits = detect(reports, **options)
    events = stage(event_rows(hits), "events")
    if airports is not None:
        events = airborne(events, airports)
    scored = score(features(events, steps))
    if with_tracks:
        scored = stage(scored, "scored")  # the tracks read it twice
        scored = tracks(scored, sequence.resample(steps_near(scored, steps)))
    else:
        none = F.lit(None).cast("array<struct<t:bigint,lat:double,lon:double,alt_ft:bigint,resampled:int>>")
        scored = scored.withColumn("track1", none).withColumn("track2", none)
    return event_table(scored)
