"""Streams over several micro-batches equal the batch operators."""

import time

import pytest
from pyspark.sql import functions as F

from contrail.operators import folds, regions, sequence
from contrail.plans import rules as R
from contrail.plans import tables as t
from contrail.session import scratch_path
from contrail.streaming import sources, stateful


@pytest.fixture(scope="module")
def batches(spark, sf):
    """The events in four files of rising time."""
    path = scratch_path(spark, "events-in-order")
    e = t.table(spark, sf, "events")
    for i in range(4):
        e.where((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250)).coalesce(1).write.mode("append").parquet(path)
    return path


def positions(spark, path):
    return stateful.with_event_time(t.positions_from(sources.table_stream(spark, path, files_per_trigger=1)))


def test_tracker_matches_batch(spark, sf, batches):
    rows = stateful.run_available(stateful.track(regions.assign_inline(positions(spark, batches), t.REGION_LAYERS)), "t")
    got = {(r["seq"], tuple(r["was_inside"]), tuple(r["inside"])) for r in rows.where("kind = 'report'").collect()}
    e = R.Rules({"rules": {}}, t.REGION_LAYERS, t.REGION_FILES)
    exp = {(r["seq"], tuple(r["was_inside"]), tuple(r["inside"])) for r in e.prepare(t.positions(spark, sf)).collect()}
    assert got == exp


def test_cooldown_matches_batch(spark, sf, batches):
    rows = positions(spark, batches).withColumn("rule", F.lit("r"))
    got = {r["seq"] for r in stateful.run_available(stateful.cooldown(rows, ["rule", "tail"], 100.0), "c").collect()}
    p = t.positions(spark, sf).withColumn("cooldown_s", F.lit(100.0))
    assert got == {r["seq"] for r in folds.cooldown(p, ["tail"], "now", ["seq"], "cooldown_s").collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "late")
    cols = "tail string, now double"
    spark.createDataFrame([("a", 100.0), ("a", 101.0), ("a", 300.0)], cols).coalesce(1).write.mode("append").parquet(src)
    # a batch filters by the watermark that the batch before it started with
    spark.createDataFrame([("a", 301.0)], cols).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("a", 102.0)], cols).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("a", 900.0)], cols).coalesce(1).write.mode("append").parquet(src)
    s = stateful.with_event_time(sources.table_stream(spark, src, files_per_trigger=1), "now", "10 seconds")
    out = {start_second(r): r["reports"] for r in stateful.run_available(stateful.checkpoint_windows(s), "w").collect()}
    assert out == {100: 2, 300: 2}


def start_second(r):
    import calendar

    return calendar.timegm(r["w"]["start"].timetuple())


def test_lifecycle_across_batches(spark, tmp_path):
    src = str(tmp_path / "hits")
    cols = "tail1 string, tail2 string, sec long, last_now double, lateral_nm double, alt_sep_ft double"
    for part in ([("a", "b", 100, 100.0, 0.2, 300.0), ("a", "b", 101, 101.0, 0.3, 200.0)], [("a", "b", 150, 150.0, 0.1, 400.0)], [("c", "d", 900, 900.0, 0.1, 100.0)]):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(src)
    s = stateful.with_event_time(sources.table_stream(spark, src, files_per_trigger=1), "last_now")
    rows = stateful.run_available(stateful.lifecycle(s), "l").collect()
    assert {(r["kind"], r["tail1"], r["create_time"], r["last_time"], r["cpa_time"], r["hits"]) for r in rows} == {
        ("open", "a", 100.0, 100.0, 100.0, 1), ("close", "a", 100.0, 150.0, 150.0, 3), ("open", "c", 900.0, 900.0, 900.0, 1)}


def test_report_files_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text('{"now":1,"hex":"a061d9","alt_baro":1200,"lat":1.5,"lon":2.5}\nnot json\n')
    out = stateful.run_available(sources.report_stream(spark, "text", path=str(folder)).select("hex", "alt_baro"), "r")
    assert [tuple(r) for r in out.collect()] == [("a061d9", 1200)]


def test_counters(spark):
    rows, seen = sources.counted(spark.range(10), "c", n=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 10, "even": 5}


def test_resampled_invariants(spark, sf):
    steps = sequence.flight_steps(t.positions(spark, sf))
    rows = sequence.resample(steps)
    assert rows.count() == rows.select("sec", "tail").distinct().count()
    assert rows.where("not resampled").count() == steps.count()


def test_reorder_over_many_batches(spark, tmp_path):
    """Rows late + on time + held = all rows, whatever the batches; on-time rows leave in order."""
    import random

    rnd, rows, t = random.Random(3), [], {}
    for seq in range(900):
        tail = rnd.choice(["N1", "N1", "N2"])
        t[tail] = t.get(tail, 100.0) + rnd.choice([0, 1, 2])
        rows.append((tail, t[tail] - rnd.choice([0, 0, 0, 3, 8, 40]), seq))
    for i in range(3):
        spark.createDataFrame(rows[300 * i:300 * i + 300], "tail string, now double, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i < 2:
            time.sleep(1.1)  # files are taken in the order of their times
    stream = sources.table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    out = stateful.run_available(stateful.reorder(stream, 10.0), "reordered").collect()
    high, late, final = {}, set(), {}
    for tail, now, seq in rows:
        if now < high.get(tail, -1e9) - 10:
            late.add(seq)
        high[tail] = max(high.get(tail, -1e9), now)
    on_time = {seq for tail, now, seq in rows if seq not in late and now <= high[tail] - 10}
    assert late and {r.seq for r in out if r.kind == "late"} == late
    assert sorted(r.seq for r in out if r.kind == "on_time") == sorted(on_time)
