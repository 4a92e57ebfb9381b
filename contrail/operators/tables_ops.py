"""Sampling, set operations, diffs, profiles and bookkeeping over tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import numbered

# Cells of the areas that runs are extrapolated to, and the seconds of a shard pass if none was measured.
AREAS = {"CONUS": 1560, "Global": 3000}
FALLBACK_SHARD_S = 90.0


def every_nth(df: DataFrame, order: Sequence[str], max_rows: int) -> DataFrame:
    """Every n-th row in ``order`` with n = max(1, rows // max_rows)."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    step = total.select(F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / max_rows)).alias("s")).scalar()
    return numbered(df, order).where(F.col("row_no") % step == 0).drop("row_no")


def evenly_spaced(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The rows numbered int(i * n / k) for i < k; all rows when there are at most k.

    Row r is chosen iff the i that could select it does: no rank table is joined.
    """
    total = df.agg(F.count(F.lit(1)).alias("n"))
    step = total.select(F.greatest(F.col("n") / F.lit(float(k)), F.lit(1.0)).alias("s")).scalar()
    i = F.ceil(F.col("row_no") / step)
    chosen = F.lit(False)
    for d in (-1, 0, 1):
        j = i + d
        chosen = chosen | ((j >= 0) & (j < F.lit(k)) & (F.floor(j * step) == F.col("row_no")))
    every = total.select(F.col("n") <= k).scalar()
    return numbered(df, order).where(every | chosen).drop("row_no")


# --- profiles and counts ------------------------------------------------------

def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: volume, aircraft, callsigns, durations, geography, altitude, nulls.

    Input: now, hex, lat, lon, alt_baro (number or null), on_ground, flight.
    """
    from .skew import exact_rank

    per = df.where(F.col("hex").isNotNull()).groupBy("hex").agg(
        F.count(F.lit(1)).alias("pts"), (F.max("now") - F.min("now")).alias("dur"))
    calls = df.where(F.col("hex").isNotNull() & (F.trim(F.coalesce("flight", F.lit(""))) != "")).select("hex", F.trim("flight").alias("f")).distinct()
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ground = F.coalesce(F.col("on_ground"), F.lit(False))
    alt = F.when(~ground, F.col("alt_baro"))
    main = df.agg(
        F.count(F.lit(1)).alias("points"), F.min("now").alias("first_now"), F.max("now").alias("last_now"),
        F.avg(F.when(both, F.col("lat"))).alias("center_lat"), F.avg(F.when(both, F.col("lon"))).alias("center_lon"),
        F.min(F.when(both, F.col("lat"))).alias("min_lat"), F.max(F.when(both, F.col("lat"))).alias("max_lat"),
        F.min(F.when(both, F.col("lon"))).alias("min_lon"), F.max(F.when(both, F.col("lon"))).alias("max_lon"),
        F.count_if(~both).alias("no_position"), F.count_if(ground).alias("ground_reports"),
        F.count_if(~ground & F.col("alt_baro").isNull()).alias("no_altitude"),
        F.min(alt).alias("min_alt"), F.max(alt).alias("max_alt"), F.avg(alt).alias("mean_alt"))
    aircraft = per.agg(
        F.count(F.lit(1)).alias("aircraft"), F.min("pts").alias("min_pts"), F.max("pts").alias("max_pts"), F.avg("pts").alias("mean_pts"),
        F.min(F.when(F.col("dur") > 0, F.col("dur"))).alias("min_dur"), F.max("dur").alias("max_dur"),
        F.avg(F.when(F.col("dur") > 0, F.col("dur"))).alias("mean_dur"))
    # medians as the mean of the two middle ranks
    middle = {"_lo": F.floor((F.col("_total") - 1) / 2), "_hi": F.floor(F.col("_total") / 2)}
    def median(rows: DataFrame, value: str, name: str, bucket: float) -> DataFrame:
        return exact_rank(rows, [], value, middle, bucket).select(((F.col("_lo") + F.col("_hi")) / 2).alias(name))

    alts = df.withColumn("_alt", alt)
    out = main
    for one in (aircraft, calls.agg(F.count(F.lit(1)).alias("callsigns")), median(per, "pts", "median_pts", 1000.0),
                median(per.where("dur > 0"), "dur", "median_dur", 3600.0), median(alts, "_alt", "median_alt", 500.0)):
        # a one-row subquery each
        out = out.withColumn("_one", one.select(F.struct(*one.columns)).scalar()).select("*", "_one.*").drop("_one")
    mid = (F.col("max_lat") + F.col("min_lat")) / 2
    return out.withColumn("height_nm", (F.col("max_lat") - F.col("min_lat")) * 60).withColumn(
        "width_nm", (F.col("max_lon") - F.col("min_lon")) * 60 * F.cos(F.radians(mid)))


def tail_histogram(df: DataFrame, key: str, date: Column, flight: str, category: str, min_days: int = 2) -> DataFrame:
    """Days seen, reports, first callsign and commonest category per aircraft.

    Counted per (aircraft, day, callsign, category) first, so a busy aircraft is
    a few rows before it is brought together.
    """
    small = df.groupBy(key, date.alias("day"), F.trim(flight).alias("f"), F.col(category).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    cats = small.where(F.col("c").isNotNull()).groupBy(key, "c").agg(F.sum("n").alias("n")).groupBy(key).agg(
        F.min_by("c", F.struct(-F.col("n"), "c")).alias("category"))
    out = small.groupBy(key).agg(
        F.countDistinct("day").alias("days"), F.sum("n").alias("points"), F.min(F.when(F.col("f") != "", F.col("f"))).alias("callsign"))
    return out.where(F.col("days") >= min_days).join(cats, key, "left").orderBy(F.desc("days"), F.desc("points"))


def counts_by(df: DataFrame, **keys: Column) -> DataFrame:
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias("n"))


def event_stats(events: DataFrame, radius_nm: float = 5.0) -> DataFrame:
    """Per airport: events, medium or high ones within 5 nm, and those per day.

    Input: icao, date, distance_nm, quality.  A quality of vhigh is not counted.
    """
    near = F.col("quality").isin("medium", "high") & (F.col("distance_nm") <= radius_nm)
    out = events.groupBy("icao").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(near).alias("near_medhigh"), F.countDistinct("date").alias("days"))
    return out.withColumn("events_per_day", F.round(F.col("near_medhigh") / F.col("days"), 2))


def eligible_events(lines: DataFrame, exclude: Sequence[str] = (), radius_nm: float | None = None, default_radius: float = 10.0) -> DataFrame:
    """Drop lines with an excluded substring; apply a radius only below the default."""
    out = lines
    for part in exclude:
        out = out.where(~F.col("line").contains(part))
    if radius_nm is not None and radius_nm < default_radius:
        out = out.where(F.col("distance_nm").isNull() | (F.col("distance_nm") <= radius_nm))
    return out


def under_covered(events: DataFrame, airports: DataFrame, minimum: int = 100) -> DataFrame:
    n = events.groupBy("icao").agg(F.count(F.lit(1)).alias("n"))
    return airports.select("icao").join(n, "icao", "left").select("icao", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")).where(F.col("n") < minimum)


def contiguous_run(dates: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Longest run of consecutive days (ties to the later run), and days outside it."""
    days = dates.select(*groups, "date").distinct()
    w = Window.partitionBy(*groups).orderBy("date")
    runs = days.withColumn("_g", F.date_sub("date", F.row_number().over(w))).groupBy(*groups, "_g").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("start"), F.max("date").alias("stop"))
    out = runs.groupBy(*groups).agg(F.max(F.struct("n", "start", "stop")).alias("r"), F.sum("n").alias("total"))
    out = out.select(*groups, F.col("r.n").alias("days"), F.col("r.start").alias("start"), F.col("r.stop").alias("stop"),
                     (F.col("total") - F.col("r.n")).alias("other_days"))
    day = lambda c: F.date_format(c, "M/d/yy")
    other = F.when(F.col("other_days") == 0, "").otherwise(F.concat(
        F.lit(" + "), F.col("other_days").cast("string"), F.lit(" other date"), F.when(F.col("other_days") > 1, "s").otherwise("")))
    single = (F.col("days") == 1) & (F.col("other_days") == 0)
    return out.withColumn("label", F.when(single, day("start")).otherwise(F.concat(day("start"), F.lit(" - "), day("stop"), other)))


def completeness(dates: DataFrame, status: DataFrame, box: tuple[int, int, int, int], exclusions: DataFrame | None = None) -> DataFrame:
    """Expected cells per date against the recorded ones.

    ``box`` is (lat_min, lat_max, lon_min, lon_max), upper ends exclusive;
    ``status``: date, cell_lat, cell_lon, state in ('ok', 'empty', other).  The
    expected cells are generated per date, without a join.
    """
    la0, la1, lo0, lo1 = box
    cells = dates.select("date").distinct().withColumn("cell_lat", F.explode(F.sequence(F.lit(la0), F.lit(la1 - 1)))).withColumn(
        "cell_lon", F.explode(F.sequence(F.lit(lo0), F.lit(lo1 - 1)))).select(
        "date", F.col("cell_lat").cast("bigint").alias("cell_lat"), F.col("cell_lon").cast("bigint").alias("cell_lon"))
    keys = ["date", "cell_lat", "cell_lon"]
    best = status.groupBy(*keys).agg(F.max(F.when(F.col("state") == "ok", 2).when(F.col("state") == "empty", 1).otherwise(0)).alias("_s"))
    rows = cells.join(best, keys, "left")
    excluded = F.lit(False)
    if exclusions is not None:
        rows = with_exclusions(rows, exclusions)
        excluded = F.col("excluded")
    ok, empty = ~excluded & (F.col("_s") == 2), ~excluded & (F.col("_s") == 1)
    return rows.groupBy("date").agg(
        F.count_if(~excluded).alias("expected"), F.count_if(ok).alias("present"), F.count_if(empty).alias("empty"),
        F.count_if(excluded).alias("excluded"), F.count_if(~excluded & (F.coalesce("_s", F.lit(0)) == 0)).alias("missing"))


def with_exclusions(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Flag (cell, date) inside an exclusion window; several windows per cell may overlap."""
    from .skew import dimension_join

    windows = exclusions.withColumn("date", F.explode(F.sequence("start", "stop"))).select("cell_lat", "cell_lon", "date").distinct()
    out = dimension_join(rows, windows.withColumn("_ex", F.lit(True)), ["cell_lat", "cell_lon", "date"], "left")
    return out.withColumn("excluded", F.coalesce("_ex", F.lit(False))).drop("_ex")


def provenance_mix(manifest: DataFrame) -> DataFrame:
    """Per date: cells, versions present, dirty cells; more than one version is mixed."""
    return manifest.groupBy("date").agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct("git_sha").alias("versions"), F.count_if("git_dirty").alias("dirty"),
        (F.countDistinct("git_sha") > 1).alias("mixed"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def region_summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (
            ("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))])


def run_statistics(per_day: DataFrame) -> DataFrame:
    """Totals per date and overall (date null), with the mean per day."""
    return per_day.rollup("date").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("records").alias("records"), F.sum("seconds").alias("seconds"),
        F.round(F.avg("records"), 4).alias("mean_records"))


def pipeline_totals(per_day: DataFrame, cells: int, fallback_shard_s: float = FALLBACK_SHARD_S) -> DataFrame:
    """One row over the days of a run: totals, means per day, and rates per cell and day.

    ``per_day``: date, shard_kb, shard_s, analyze_s, events, errors. A day without shard time and
    errors was skipped; the mean shard time is that of the others, or the fallback if there are none.
    """
    skipped = F.count_if((F.col("shard_s") == 0) & (F.col("errors") == 0))
    sums = {c: F.sum(c) for c in ("shard_kb", "shard_s", "analyze_s", "events", "errors")}
    out = per_day.agg(F.count(F.lit(1)).alias("days"), skipped.alias("skipped"), *[F.coalesce(v, F.lit(0)).alias(f"total_{c}") for c, v in sums.items()])
    mean = lambda c: F.when(F.col("days") > 0, F.col(f"total_{c}") / F.col("days")).otherwise(0.0)
    out = out.withColumns({f"avg_{c}": mean(c) for c in ("shard_kb", "analyze_s", "events")})
    return out.withColumns({
        "measured_shard_s": F.when(F.col("skipped") < F.col("days"), F.col("total_shard_s") / (F.col("days") - F.col("skipped"))).otherwise(F.lit(float(fallback_shard_s))),
        **{f"{c}_per_cell": F.col(f"avg_{c}") / max(cells, 1) for c in ("shard_kb", "analyze_s", "events")}})


def extrapolated(totals: DataFrame, areas: dict[str, int] = AREAS, cores: Sequence[int] = (8, 32)) -> DataFrame:
    """What the measured rates come to for larger areas: one row per area with its number of cells."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("area"), F.lit(c).alias("cells")) for n, c in areas.items()]))
    out = totals.select("*", rows.alias("_a")).select("*", "_a.*")
    serial = F.col("analyze_s_per_cell") * F.col("cells") / 60
    return out.select(
        "area", "cells", (F.col("measured_shard_s") / 60).alias("shard_min_day"), serial.alias("analyze_min_day"), *[(serial / n).alias(f"analyze_min_{n}_cores") for n in cores],
        (F.col("shard_kb_per_cell") * F.col("cells") / 1024 * 30 / 1024).alias("shard_gb_30_days"))


# --- joins ----------------------------------------------------------------------

def lookup_or_insert(ops: DataFrame, aircraft: DataFrame, key: str = "tail") -> tuple[DataFrame, DataFrame]:
    """(ops with aircraft_id, aircraft rows to insert).  New ids are keyed by the tail."""
    from .skew import salted_join

    missing = ops.select(key).distinct().join(aircraft.select(key), key, "left_anti").withColumn("aircraft_id", F.concat(F.lit("new-"), key))
    known = aircraft.select(key, "aircraft_id").unionByName(missing)
    return salted_join(ops, known, [key], "left"), missing


# The pieces of a registration note.
NOTE = {"none": "* No Reg ", "arrivals": "Arrivals=", "ban": "*BANNED ", "many": "* >2 arrivals ", "notes": "*Notes ", "bxa": "BxA"}


def registration(found: Column, of: Callable[[str], Column]) -> tuple[Column, Column]:
    """Note and warning of a flight; ``of`` names a column of its aircraft, ``found`` says whether there is one."""
    yes = lambda c: F.coalesce(of(c), F.lit(False))
    piece = lambda test, text: F.when(test, F.lit(NOTE[text])).otherwise("")
    unregistered = ~yes("registered") & ~yes("is_bxa") & ~yes("medevac")
    note = F.concat(
        F.when(of("arrivals").isNotNull(), F.concat(F.lit(NOTE["arrivals"]), of("arrivals").cast("string"), F.lit(" "))).otherwise(""),
        piece(yes("ban"), "ban"), piece(~yes("is_bxa") & F.coalesce(of("arrivals") > 2, F.lit(False)), "many"),
        piece(unregistered, "none"), piece(yes("notes"), "notes"), piece(yes("is_bxa"), "bxa"))
    return F.when(found, note).otherwise(NOTE["none"]), ~found | yes("ban") | unregistered


def registration_notes(flights: DataFrame, aircraft: DataFrame, pilots: DataFrame, key: str = "tail",
                       logic: Callable[[Column, Callable[[str], Column]], tuple[Column, Column]] = registration) -> DataFrame:
    """Note string, warning, pilot label (7 characters) and code per flight.

    ``logic`` makes note and warning of the aircraft's columns; the default is ``registration``, which
    needs arrivals, ban, registered, is_bxa, medevac, notes. ``aircraft`` has tail and lead_pilot besides;
    ``pilots``: pilot_id, alias, name, code.
    """
    from .skew import salted_join

    a = aircraft.select(key, F.col("lead_pilot").alias("pilot_id"), F.struct(*aircraft.columns).alias("_aircraft"))
    rows = salted_join(salted_join(flights, a, [key], "left"), pilots, ["pilot_id"], "left")
    note, warning = logic(F.col("_aircraft").isNotNull(), lambda c: F.col(f"_aircraft.{c}"))
    who = F.when(F.coalesce("alias", F.lit("")) != "", F.col("alias")).otherwise(F.col("name"))
    return rows.select(*flights.columns, note.alias("note"), warning.alias("warning"), F.substring(who, 1, 7).alias("pilot_label"), F.col("code").alias("code_label"))


COMPARED = ["quality", "lateral_nm", "alt_sep_ft", "duration_s"]


def event_diff(new: DataFrame, old: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """ADDED, REMOVED, CHANGED or SAME per event, matched on pair and minute."""
    def keyed(df: DataFrame, sfx: str) -> DataFrame:
        pair = F.array_join(F.array_sort(F.array("flight1", "flight2")), "|")
        minute = F.date_format(F.timestamp_seconds(F.col("timestamp")), "yyyy-MM-dd'T'HH:mm")
        rows = df.withColumn("event_key", F.concat(pair, F.lit("@"), minute))
        # the earliest of several events with one key represents them
        first = rows.groupBy("event_key").agg(F.min_by(F.struct(*COMPARED), F.struct("timestamp", *COMPARED[1:], "quality")).alias("v"))
        return first.select("event_key", F.col("v").alias(f"v{sfx}"))

    both = keyed(new, "_new").join(keyed(old, "_old"), "event_key", "full")
    differs = []
    for c in COMPARED:
        a, b = F.col(f"v_old.{c}"), F.col(f"v_new.{c}")
        matched = F.col("v_old").isNotNull() & F.col("v_new").isNotNull()
        differs.append(matched & ~a.eqNullSafe(b) if c == "quality" else F.coalesce(F.abs(a - b) > tolerance, F.lit(False)))
    changed = F.array_compact(F.array(*[F.when(d, F.lit(c)) for c, d in zip(COMPARED, differs)]))
    status = F.when(F.col("v_old").isNull(), "ADDED").when(F.col("v_new").isNull(), "REMOVED").when(F.size("changed") > 0, "CHANGED").otherwise("SAME")
    return both.withColumn("changed", changed).select("event_key", status.alias("status"), F.array_join("changed", ",").alias("changed"))


def new_requests(requests: DataFrame, processed: DataFrame, order: str = "seq") -> DataFrame:
    """Requested airports not processed yet, in order of first request."""
    from ..functions.idents import faa_to_icao

    code = F.upper(F.trim("airport"))
    rows = requests.where(F.coalesce(code, F.lit("")) != "").withColumn("icao", faa_to_icao("airport"))
    first = rows.groupBy("icao").agg(F.min(order).alias("first_seq"))
    return first.join(processed.select("icao").distinct(), "icao", "left_anti").orderBy("first_seq")


def slot_board(prepared: DataFrame, slots: int, now: float | None = None, fresh_s: float = 180) -> DataFrame:
    """Latest report of every active flight, by its first-layer region."""
    latest = prepared.groupBy("tail").agg(F.max_by(F.struct("now", F.col("inside")[0].alias("region"), "alt_baro", "gs"), F.struct("now", "seq")).alias("s"))
    out = latest.select("tail", "s.*").where(F.col("region").isNotNull())
    if now is not None:
        out = out.where(F.col("now") >= now - fresh_s)
    return out


# --- sets -------------------------------------------------------------------------

def identifiers(df: DataFrame, column: str | None = None) -> DataFrame:
    """Upper-cased identifiers from the named or the first recognised column."""
    wanted = [column, "ARPT_ID", "IDENT", "ID", "LOCATION_ID"]
    names = {c.upper(): c for c in df.columns}
    pick = next((names[w.upper()] for w in wanted if w and w.upper() in names), df.columns[0])
    rest = [c for c in df.columns if c == "seq" and pick != "seq"]
    return df.select(F.upper(F.trim(F.col(pick))).alias("ident"), *rest)


def ordered_difference(left: DataFrame, right: DataFrame, key: str = "ident") -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; keeps duplicates and the order column."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(order).alias(order))
