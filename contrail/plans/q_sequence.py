"""Ordered operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, sequence
from ..operators.timeline import numbered, running, timeline
from . import tables as t
from .registry import query

P = t.POSITIONS_SQL


@query("W1_report_gaps", f"""WITH {P} SELECT hex, seq, gap FROM (
  SELECT hex, seq, now - lag(now) OVER (PARTITION BY hex ORDER BY now, seq) AS gap FROM positions) WHERE gap > 0 AND gap <= 300""")
def report_gaps(spark, sf):
    return sequence.report_gaps(t.positions(spark, sf)).select("hex", "seq", "gap")


@query("W1_gaps_by_user", """SELECT user_id, event_id, round(gap, 6) AS gap FROM (
  SELECT user_id, event_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
  WHERE gap > 0 AND gap <= 86400""")
def gaps_by_user(spark, sf):
    e = t.table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    out = sequence.report_gaps(e, "user_id", "t", ["event_id"], max_gap=86400, width=3600.0)
    return out.select("user_id", "event_id", F.round("gap", 6).alias("gap"))


@query("W2_flight_numbers", f"""WITH {P} SELECT seq, tail, flight_no, tail || '_' || flight_no AS flight_id FROM (
  SELECT *, CAST(1 + sum(CASE WHEN gap > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY tail ORDER BY now, seq) AS BIGINT) AS flight_no FROM (
    SELECT *, now - lag(now) OVER (PARTITION BY tail ORDER BY now, seq) AS gap FROM positions))""")
def flight_numbers(spark, sf):
    out = sequence.flight_numbers(sequence.prefilter(t.positions(spark, sf)))
    return out.select("seq", "tail", "flight_no", "flight_id")


@query("W3_life_segments", f"""WITH {P} SELECT tail, life_no, min(now) AS first_now, max(now) AS last_now, count(*) AS n FROM (
  SELECT *, CAST(1 + sum(CASE WHEN gap > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY tail ORDER BY now, seq) AS BIGINT) AS life_no FROM (
    SELECT *, now - lag(now) OVER (PARTITION BY tail ORDER BY now, seq) AS gap FROM positions)) GROUP BY 1, 2""")
def life_segments(spark, sf):
    out = sequence.life_segments(t.positions(spark, sf))
    return out.groupBy("tail", "life_no").agg(
        F.min("now").alias("first_now"), F.max("now").alias("last_now"), F.count(F.lit(1)).alias("n"))


@query("W5_resample", f"""WITH {t.RESAMPLED_SQL} SELECT sec, tail, flight_id, resampled, round(lat, 6) AS lat, round(lon, 6) AS lon, alt_baro,
  round(gs, 4) AS gs, round(track, 4) AS track FROM resampled""")
def resample(spark, sf):
    rows = sequence.resample(sequence.flight_steps(sequence.prefilter(t.positions(spark, sf))))
    return rows.select("sec", "tail", "flight_id", "resampled", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
                       "alt_baro", F.round("gs", 4).alias("gs"), F.round("track", 4).alias("track"))


PERTURBED = t.STEPS_SQL.replace("positions AS (", "positions0 AS (", 1).replace(
    ", lagged AS (", ", positions AS (SELECT * REPLACE (lat + CASE WHEN seq % 997 = 0 THEN 1.0 ELSE 0.0 END AS lat) FROM positions0), lagged AS (", 1)


def perturbed_steps(spark, sf):
    shifted = F.col("lat") + F.when(F.col("seq") % 997 == 0, 1.0).otherwise(0.0)
    return sequence.flight_steps(t.positions(spark, sf).withColumn("lat", shifted))


@query("W6_teleport_flag", f"WITH {PERTURBED} SELECT seq, flight_id, round(v1, 3) AS speed_kt FROM steps WHERE teleport")
def teleport_flag(spark, sf):
    rows = perturbed_steps(spark, sf).where("teleport")
    speed = sequence.speed_kt(F.col("prev"), F.struct("lat", "lon"), F.col("now") - F.col("prev.now"))
    return rows.select("seq", "flight_id", F.round(speed, 3).alias("speed_kt"))


@query("W7_speed_jump_flag", f"WITH {PERTURBED} SELECT seq, flight_id, speed_jump, teleport OR speed_jump AS suspicious FROM steps")
def speed_jump(spark, sf):
    return perturbed_steps(spark, sf).select("seq", "flight_id", "speed_jump", "suspicious")


@query("W8_altitude_trend", f"""WITH {P}, g AS (SELECT *, lag(now) OVER w AS pn FROM positions WINDOW w AS (PARTITION BY tail ORDER BY now, seq)),
  l AS (SELECT *, sum(CASE WHEN now - pn > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY tail ORDER BY now, seq) AS life FROM g),
  m AS (SELECT *, avg(alt_baro) OVER (PARTITION BY tail, life ORDER BY now, seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean FROM l)
  SELECT seq, tail, CAST(sign(alt_baro - coalesce(trunc(mean), alt_baro)) AS INTEGER) AS trend FROM m""")
def altitude_trend(spark, sf):
    return sequence.altitude_trend(t.positions(spark, sf)).select("seq", "tail", "trend")


TRIPS = f"""WITH {P}, thin AS (
  SELECT hex, CAST(floor(now / 10) AS BIGINT) AS bucket, arg_min(now, seq) AS now, arg_min(lat, seq) AS lat, arg_min(lon, seq) AS lon
  FROM positions WHERE alt_baro BETWEEN 100 AND 18000 GROUP BY 1, 2),
g AS (SELECT *, now - lag(now) OVER (PARTITION BY hex ORDER BY now) AS gap FROM thin),
s AS (SELECT *, CAST(1 + sum(CASE WHEN gap > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY hex ORDER BY now) AS BIGINT) AS segment FROM g)"""


@query("W9_trip_points", TRIPS + " SELECT hex, segment, bucket, now, round(lat, 6) AS lat, round(lon, 6) AS lon FROM s")
def trip_points(spark, sf):
    return sequence.trip_points(t.positions(spark, sf)).select(
        "hex", "segment", "bucket", "now", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("W9_trips", TRIPS + """ SELECT hex, segment, count(*) AS points, min(now) AS first_now, max(now) AS last_now,
  CAST(sum(now % 86400) AS BIGINT) AS tod_sum FROM s GROUP BY 1, 2 HAVING count(*) >= 5""")
def trips(spark, sf):
    parts = sequence.trips(sequence.trip_points(t.positions(spark, sf)))
    day = t.EPOCH0 // 86400 * 86400
    tod = F.aggregate("timestamps", F.lit(0.0), lambda a, x: a + x)
    del day
    whole = parts.select("hex", "segment", "points", F.size("path").alias("m"), tod.alias("tod"), "part", "timestamps")
    return whole.groupBy("hex", "segment", "points").agg(
        F.min(F.get("timestamps", F.lit(0)) + F.floor(F.col("part") * 3600 / 86400) * 86400).alias("first_now"),
        F.max(F.element_at("timestamps", -1) + F.floor(F.col("part") * 3600 / 86400) * 86400).alias("last_now"),
        F.sum("tod").cast("bigint").alias("tod_sum"))


DECIMATED = f"""WITH RECURSIVE {t.RESAMPLED_SQL}, r AS (
  SELECT flight_id, sec, round(track, 6) AS track, row_number() OVER (PARTITION BY flight_id ORDER BY sec) AS i, count(*) OVER (PARTITION BY flight_id) AS n FROM resampled),
walk AS (
  SELECT flight_id, sec, i, n, track AS kept_track, true AS kept FROM r WHERE i = 1
  UNION ALL
  SELECT r.flight_id, r.sec, r.i, r.n, CASE WHEN d >= 10 THEN r.track ELSE kept_track END, d >= 10
  FROM (SELECT r.*, w.kept_track, least(abs(r.track - w.kept_track), 360 - abs(r.track - w.kept_track)) AS d
        FROM walk w JOIN r ON r.flight_id = w.flight_id AND r.i = w.i + 1) r)"""


@query("W10_heading_decimation", DECIMATED + " SELECT flight_id, sec FROM walk WHERE kept OR i = n")
def heading_decimation(spark, sf):
    rows = sequence.resample(sequence.staged_steps(sequence.flight_steps(sequence.prefilter(t.positions(spark, sf)))))
    return folds.decimate(rows.select("flight_id", "sec", F.round("track", 6).alias("track")), ["flight_id"], width=600).select("flight_id", "sec")


@query("W25_gap_marks", f"""WITH {t.RESAMPLED_SQL}, runs AS (
  SELECT *, sec - lag(sec) OVER (PARTITION BY tail ORDER BY sec) > 2 AS jump,
    sum(CASE WHEN resampled THEN 0 ELSE 1 END) OVER (PARTITION BY tail ORDER BY sec) AS run FROM resampled)
SELECT tail, sec, coalesce(jump, false) OR (resampled AND
  max(CASE WHEN resampled THEN sec END) OVER (PARTITION BY tail, run) - min(CASE WHEN resampled THEN sec END) OVER (PARTITION BY tail, run) > 2) AS in_gap
FROM runs""")
def gap_marks(spark, sf):
    rows = sequence.resample(sequence.staged_steps(sequence.flight_steps(sequence.prefilter(t.positions(spark, sf)))))
    return sequence.gap_marks(rows, ["tail"], "sec").select("tail", "sec", "in_gap")


@query("T6_gap_heartbeats", f"""WITH {P}, g AS (SELECT tail, now, lead(now) OVER (PARTITION BY tail ORDER BY now, seq) AS nx FROM positions)
  SELECT tail, unnest(range(CAST(now AS BIGINT) + 20, CAST(nx AS BIGINT), 20)) AS beat FROM g WHERE nx - now > 20""")
def heartbeats(spark, sf):
    g = timeline(t.positions(spark, sf).select("tail", "now", "seq"), ["tail"], "now", ["seq"], following=True)
    start, stop = F.col("now").cast("bigint") + 20, F.col("next_time").cast("bigint") - 1
    return g.where(start <= stop).select("tail", F.explode(F.sequence(start, stop, F.lit(20).cast("bigint"))).alias("beat"))


@query("T6_clock_beats", f"""WITH {P}, s AS (SELECT DISTINCT CAST(floor(now) AS BIGINT) AS sec FROM positions WHERE seq % 300 < 37 OR seq % 7 = 0 AND seq % 300 < 60),
  r AS (SELECT min(sec) AS lo, max(sec) AS hi FROM s), k AS (SELECT lo + 20 * i AS sec, hi FROM (SELECT lo, hi, unnest(range(0, (hi - lo) // 20 + 1)) AS i FROM r))
  SELECT k.sec FROM k WHERE k.sec < hi AND k.sec NOT IN (SELECT sec FROM s)""")
def clock_beats(spark, sf):
    """Beats through the seconds in which no aircraft reports."""
    p = t.positions(spark, sf).where("seq % 300 < 37 OR seq % 7 = 0 AND seq % 300 < 60")
    return sequence.heartbeats(p)


@query("O2_every_nth", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
  WHERE i % greatest(1, n // 700) = 0""")
def every_nth(spark, sf):
    from ..operators.tables_ops import every_nth as op

    return op(t.table(spark, sf, "events"), ["ts", "event_id"], 700).select("event_id")


@query("O3_evenly_spaced", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
  WHERE i IN (SELECT CAST(floor(k * (n * 1.0 / 500)) AS BIGINT) FROM range(500) r(k))""")
def evenly_spaced(spark, sf):
    from ..operators.tables_ops import evenly_spaced as op

    return op(t.table(spark, sf, "events"), ["ts", "event_id"], 500).select("event_id")


@query("O2_running_total", f"WITH {P} SELECT seq, CAST(sum(alt_baro) OVER (ORDER BY now, seq) AS BIGINT) AS running_alt FROM positions")
def running_total(spark, sf):
    out = running(t.positions(spark, sf).select("seq", "now", "alt_baro"), [], "now", ["seq"], sums={"running_alt": F.col("alt_baro")})
    return out.select("seq", "running_alt")


@query("O1_global_sort", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_no FROM events")
def global_sort(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", "ts")
    return numbered(e, ["ts", "event_id"]).select("event_id", F.col("row_no")).orderBy("row_no")
