"""Streaming versions, run over the whole events file until it is consumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import los, proximity, regions, sequence
from ..session import scratch_path
from ..streaming import sources, stateful
from . import tables as t
from .registry import query

DELAY = "10 seconds"


def _timed(events):
    return stateful.with_event_time(t.positions_from(events), "now", DELAY)


def _stream(spark, sf):
    return _timed(sources.table_stream(spark, sf, "events.parquet"))


def _tracked(spark, sf, name):
    rows = regions.assign_inline(_stream(spark, sf), t.REGION_LAYERS)
    return stateful.run_available(stateful.track(rows), name)


@query("S3_report_stream", f"WITH {t.POSITIONS_SQL} SELECT seq, tail, now, alt_baro FROM positions")
def report_stream(spark, sf):
    return stateful.run_available(_stream(spark, sf).select("seq", "tail", "now", "alt_baro"), "reports")


@query("S3_json_stream", f"WITH {t.POSITIONS_SQL} SELECT seq, now, hex, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN seq % 7 = 0 THEN 0 ELSE alt_baro END AS alt_baro, gs, squawk, seq % 7 = 0 AS on_ground FROM positions WHERE seq % 50 <> 49")
def json_stream(spark, sf):
    """Newline JSON, some lines cut off, as a stream of text files."""
    from .q_sources import _json_lines

    path = scratch_path(spark, "json-lines")
    _json_lines(spark, sf).select("value").write.text(path)
    out = stateful.run_available(sources.report_stream(spark, "text", path=path).drop("attrs"), "json-reports")
    return out.withColumn("seq", (F.col("now") - t.EPOCH0).cast("bigint")).select(
        "seq", "now", "hex", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt_baro", "gs", "squawk", "on_ground")


# Reports that come out of order: some seconds, or most of a minute, after they were sent.
DELAYED = f"""{t.POSITIONS_SQL}, sent AS (SELECT tail, seq, now - CASE WHEN seq % 17 = 0 THEN 45.0 WHEN seq % 5 = 0 THEN 6.0 ELSE 0.0 END AS sent_at FROM positions),
judged AS (SELECT *, coalesce(sent_at < max(sent_at) OVER (PARTITION BY tail ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 10, false) AS late, max(sent_at) OVER (PARTITION BY tail) AS high FROM sent)"""


def _reordered(spark, sf, name):
    p = t.positions_from(sources.table_stream(spark, sf, "events.parquet"))
    behind = F.when(F.col("seq") % 17 == 0, 45.0).when(F.col("seq") % 5 == 0, 6.0).otherwise(0.0)
    return stateful.run_available(stateful.reorder(p.withColumn("now", F.col("now") - behind)), name)


@query("T7_late_reports", f"WITH {DELAYED} SELECT tail, seq, sent_at FROM judged WHERE late")
def late_reports(spark, sf):
    return _reordered(spark, sf, "late").where("kind = 'late'").select("tail", "seq", F.col("now").alias("sent_at"))


@query("T7_reports_on_time", f"""WITH {DELAYED} SELECT tail, count(*) AS n, count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE NOT late AND sent_at <= high - 10) AS on_time,
  CAST(sum(CASE WHEN NOT late AND sent_at <= high - 10 THEN seq ELSE 0 END) AS BIGINT) AS seq_sum FROM judged GROUP BY 1""")
def reports_on_time(spark, sf):
    """All rows of an aircraft are late, on time, or held at the end; ``n`` counts the given ones."""
    kinds = _reordered(spark, sf, "on-time").groupBy("tail").agg(
        F.count_if(F.col("kind") == "late").alias("late"), F.count_if(F.col("kind") == "on_time").alias("on_time"), F.sum(F.when(F.col("kind") == "on_time", F.col("seq")).otherwise(0)).alias("seq_sum"))
    return t.positions(spark, sf).groupBy("tail").agg(F.count(F.lit(1)).alias("n")).join(kinds, "tail").select("tail", "n", "late", "on_time", "seq_sum")


@query("T1_tracker_state", f"WITH {t.REGIONS_SQL}, l AS (SELECT *, min(now) OVER (PARTITION BY tail, life_no) AS life_start FROM prepared) SELECT seq, tail, life_start, was0, was1, in0, in1 FROM l")
def tracker_state(spark, sf):
    rows = _tracked(spark, sf, "track").where("kind = 'report'")
    return rows.select("seq", "tail", "life_start", *[F.col("was_inside")[i].alias(f"was{i}") for i in (0, 1)], *[F.col("inside")[i].alias(f"in{i}") for i in (0, 1)])


@query("T2_idle_expiry", f"""WITH {t.REGIONS_SQL}, l AS (SELECT tail, life_no, min(now) AS life_start, max(now) AS last_now, arg_max(seq, now) AS seq FROM prepared GROUP BY 1, 2)
  SELECT tail, life_start, last_now, seq FROM l WHERE last_now + 180 < (SELECT max(now) FROM positions) - 10
    OR EXISTS (SELECT 1 FROM l AS n WHERE n.tail = l.tail AND n.life_no > l.life_no)""")
def idle_expiry(spark, sf):
    rows = _tracked(spark, sf, "expiry").where("kind = 'expired'")
    return rows.select("tail", "life_start", F.col("now").alias("last_now"), "seq")


@query("T4_stream_windows", f"""WITH {t.POSITIONS_SQL} SELECT CAST(now AS BIGINT) // 5 * 5 AS window_start, count(*) AS reports FROM positions GROUP BY 1 HAVING window_start + 5 <= (SELECT max(now) FROM positions) - 10""")
def stream_windows(spark, sf):
    rows = stateful.run_available(stateful.checkpoint_windows(_stream(spark, sf)), "windows")
    return rows.select(F.unix_timestamp("w.start").alias("window_start"), "reports")


COOL = f"""WITH RECURSIVE {t.POSITIONS_SQL}, m AS (SELECT tail, seq, now, row_number() OVER (PARTITION BY tail ORDER BY now, seq) AS i FROM positions WHERE alt_baro >= 1200),
walk AS (SELECT tail, seq, now, i, true AS fired, now AS last FROM m WHERE i = 1
  UNION ALL SELECT m.tail, m.seq, m.now, m.i, m.now - w.last >= 150, CASE WHEN m.now - w.last >= 150 THEN m.now ELSE w.last END FROM walk w JOIN m ON m.tail = w.tail AND m.i = w.i + 1)
SELECT 'high' AS rule, tail, seq FROM walk WHERE fired"""


@query("T5_stream_cooldown", COOL)
def stream_cooldown(spark, sf):
    rows = _stream(spark, sf).where("alt_baro >= 1200").withColumn("rule", F.lit("high"))
    return stateful.run_available(stateful.cooldown(rows, ["rule", "tail"], 150.0), "cooldown").select("rule", "tail", "seq")


@query("T3_event_lifecycle", f"""WITH {t.SESSIONS_SQL}, e AS (SELECT tail1, tail2, event_no, CAST(min(sec) AS DOUBLE) AS create_time, CAST(max(sec) AS DOUBLE) AS last_time, count(*) AS hits FROM event_hits GROUP BY 1, 2, 3)
  SELECT 'open' AS kind, tail1, tail2, create_time, create_time AS last_time, CAST(1 AS BIGINT) AS hits FROM e
  UNION ALL SELECT 'close', tail1, tail2, create_time, last_time, hits FROM e WHERE last_time + 61 < (SELECT max(sec) FROM event_hits) - 10 OR EXISTS (SELECT 1 FROM e n WHERE n.tail1 = e.tail1 AND n.tail2 = e.tail2 AND n.event_no > e.event_no)""")
def event_lifecycle(spark, sf):
    path = scratch_path(spark, "hit-table")
    steps = sequence.flight_steps(sequence.prefilter(t.positions(spark, sf)))
    hits = proximity.near_pairs(proximity.track_pieces(steps), los.LATERAL_NM, los.VERTICAL_FT)
    hits.withColumn("last_now", F.greatest("now1", "now2")).write.parquet(path)
    stream = stateful.with_event_time(sources.table_stream(spark, path), "last_now", DELAY)
    rows = stateful.run_available(stateful.lifecycle(stream), "lifecycle")
    return rows.select("kind", "tail1", "tail2", "create_time", "last_time", "hits")


@query("T8_stream_fresh_pairs", f"""WITH {t.POSITIONS_SQL} SELECT a.tail AS tail1, a.seq AS seq1, b.tail AS tail2, b.seq AS seq2 FROM positions a JOIN positions b
  ON b.seq BETWEEN a.seq - 5 AND a.seq + 5 AND a.tail < b.tail AND abs(a.alt_baro - b.alt_baro) < 400 WHERE {t.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 1.5""")
def stream_pairs(spark, sf):
    folder, files = sources.in_order(t.table(spark, sf, "events"), "event_id")
    a, b = (_timed(sources.table_stream(spark, folder, files_per_trigger=files)) for _ in range(2))
    return stateful.run_available(stateful.fresh_pairs(a, b, 1.5, 400.0), "pairs", sources.BATCH_TASKS)


@query("T10_run_counters", f"WITH {t.POSITIONS_SQL} SELECT count(*) AS reports, count(*) FILTER (WHERE on_ground) AS ground, CAST(sum(CASE WHEN alt_baro >= 1600 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM positions")
def run_counters(spark, sf):
    rows, seen = sources.counted(t.positions(spark, sf), "run", reports=F.count(F.lit(1)), ground=F.count_if("on_ground"), high=F.count_if(F.col("alt_baro") >= 1600))
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["reports"], got["ground"], got["high"])], "reports bigint, ground bigint, high bigint")
