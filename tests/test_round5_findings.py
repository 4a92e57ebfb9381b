"""One small test for each finding of round 5's list (FINDINGS_r04) that was right."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from contrail.plans import catalog
from contrail.plans import tables as t
from contrail.session import scratch_path
from contrail.streaming import sources, stateful


def held(spark, state, batch):
    """Reports in a join's state after a batch."""
    rows = spark.read.format("statestore").option("batchId", batch).load(state).select("value.*").collect()
    return sum(len(r["groupState"]["held"]) for r in rows) // stateful.HELD.itemsize


def test_pairs_of_a_table_hold_two_batches(spark, sf, monkeypatch):
    """the table is played back in batches of few rows, in the order of time, and rows leave the state behind the watermark."""
    paths = {}
    monkeypatch.setattr(stateful, "scratch_path", lambda s, name: paths.setdefault(name, scratch_path(s, name)))
    monkeypatch.setattr(sources, "BATCH_ROWS", 100)
    monkeypatch.setattr(sources, "BATCH_TASKS", 3)
    got = [tuple(r) for r in catalog.QUERIES["T8_stream_fresh_pairs"](spark, sf).collect()]
    p = sorted(t.positions(spark, sf).select("tail", "seq", "lat", "lon", "alt_baro").collect(), key=lambda r: r["seq"])
    exp = {(a["tail"], a["seq"], b["tail"], b["seq"]) for i, x in enumerate(p) for y in p[i + 1:i + 6] for a, b in ((x, y), (y, x))
           if a["tail"] < b["tail"] and abs(a["alt_baro"] - b["alt_baro"]) < 400 and nm(a, b) < 1.5}
    assert len(got) == len(exp) and set(got) == exp
    state = paths["pairs-state"].removeprefix("file://")
    commits = [c for c in os.listdir(f"{state}/commits") if c.isdigit()]
    assert len(commits) >= 10
    sizes = [held(spark, paths["pairs-state"], i) for i in range(len(commits))]
    assert 0 < max(sizes) < 1000
    assert len([d for d in os.listdir(f"{state}/state/0") if d.isdigit()]) == 3 and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def nm(a, b):
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 3443.92 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_played_back_rows_are_whole_and_in_order(spark, monkeypatch):
    """files are of consecutive times, whatever the order of the table; a store without file times gives one batch."""
    monkeypatch.setattr(sources, "BATCH_ROWS", 100)
    times = [i // 3 * 10 for i in range(1000)]
    random.Random(1).shuffle(times)
    df = spark.createDataFrame([(x, i) for i, x in enumerate(times)], "at long, i long")
    folder, files = sources.in_order(df, "at")
    parts = sorted((os.stat(e.path).st_mtime, e.path) for e in os.scandir(folder) if e.name.startswith("part-"))
    ranges = [spark.read.parquet(f).agg(F.min("at"), F.max("at"), F.count("*")).first() for _, f in parts]
    assert files == 1 and len(parts) >= 10 and len({m for m, _ in parts}) == len(parts)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and max(r[2] for r in ranges) < 300
    assert sorted(map(tuple, spark.read.parquet(folder).collect())) == sorted(map(tuple, df.collect()))
    folder, files = sources.in_order(df.where("false"), "at")
    assert files == 100 and spark.read.parquet(folder).count() == 0


@pytest.mark.parametrize("at_once", [7, 200_000])
def test_fresh_pairs_over_batches(spark, monkeypatch, at_once):
    """pairs within a batch and across batches, at any latitude, against all pairs; nulls, equal times and copies, too."""
    rng = random.Random(at_once)
    rows, place = [], [(36.5, -121.8), (0.0, 0.0), (71.3, 25.0), (-80.0, 179.0), (89.95, 10.0), (2e4, 0.0)]
    for i in range(600):
        lat, lon = rng.choice(place)
        far = math.cos(math.radians(min(lat, 89.0)))
        rows.append((f"N{rng.randrange(9)}", i, 1_700_000_000 + i // 4 + rng.choice([0.0, 0.0, 0.25, -3.0]), lat + rng.uniform(-0.04, 0.04), lon + rng.uniform(-0.04, 0.04) / far, rng.choice([1000, 1399, 1400, 1800])))
    rows += [rows[5], (None, 600, rows[-1][2], 0.0, 0.0, 1000), ("N1", 601, rows[-1][2], None, 0.0, 1000), ("N1", 602, rows[-1][2], 0.0, math.nan, 1000),
             ("N2", 603, rows[-1][2], 0.0, 0.0, None), ("N1", None, rows[-1][2], 0.0, 0.0, 1000), ("N2", 604, rows[-1][2], 0.0, 0.0, 1000)]
    rows.sort(key=lambda r: r[2])
    df = spark.createDataFrame(rows, "tail string, seq long, now double, lat double, lon double, alt_baro long")
    monkeypatch.setattr(sources, "BATCH_ROWS", 60)
    monkeypatch.setattr(stateful, "MEET_AT_ONCE", at_once)
    folder, files = sources.in_order(df, "now")
    a, b = (stateful.with_event_time(sources.table_stream(spark, folder, files_per_trigger=files)) for _ in range(2))
    got = [tuple(r) for r in stateful.run_available(stateful.fresh_pairs(a, b, 1.5, 400.0), "pairs").collect()]
    names = ["tail", "seq", "now", "lat", "lon", "alt_baro"]
    whole = [dict(zip(names, r)) for r in rows if None not in (r[0], r[3], r[4], r[5])]
    exp = [(p["tail"], p["seq"], q["tail"], q["seq"]) for p in whole for q in whole
           if p["tail"] < q["tail"] and abs(p["now"] - q["now"]) <= 5 and abs(p["alt_baro"] - q["alt_baro"]) < 400 and nm(p, q) < 1.5]
    assert len(exp) > 150 and any(None in e for e in exp)
    assert sorted(got, key=repr) == sorted(exp, key=repr)


def test_late_reports_meet_no_others(spark, tmp_path):
    """a report behind the watermark is dropped, one within it meets those of earlier batches."""
    cols = "tail string, seq long, now double, lat double, lon double, alt_baro long"
    for i, now in enumerate((1000.0, 1020.0, 1013.0, 1004.0, 2000.0)):  # the watermark follows a batch behind: 990, 1010, 1010
        spark.createDataFrame([(f"N{i}", i, now, 36.5, -121.8, 1000)], cols).coalesce(1).write.mode("append").parquet(str(tmp_path))
    files = sorted((f for f in os.listdir(tmp_path) if f.endswith(".parquet")), key=lambda f: os.stat(tmp_path / f).st_mtime)
    for i, f in enumerate(files):
        os.utime(tmp_path / f, (1_700_000_000 + i, 1_700_000_000 + i))
    side = lambda: stateful.with_event_time(sources.table_stream(spark, str(tmp_path), files_per_trigger=1))
    got = stateful.run_available(stateful.fresh_pairs(side(), side(), 1.5, 400.0, max_age_s=8), "pairs")
    assert [(r["seq1"], r["seq2"]) for r in got.collect()] == [(1, 2)]
