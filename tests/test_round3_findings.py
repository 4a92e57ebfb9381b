"""One small test for each finding of round 3 that was right."""

import inspect

from pyspark.sql import functions as F

from contrail.operators import density
from contrail.session import scratch_path
from contrail.streaming import sources, stateful


def test_fresh_pairs_meet_by_time(spark):
    """reports of one place meet those of their time only; ages up to the limit count, across stretches of time, too."""
    path = scratch_path(spark, "one-place")
    n = 6000  # 18 million pairs of one cell, of which few are of one time
    rows = spark.range(n).select(F.concat(F.lit("N"), (F.col("id") % 2).cast("string")).alias("tail"), F.col("id").alias("seq"),
                                 (F.col("id") * 1.25 + 1_700_000_000).alias("now"), F.lit(36.5).alias("lat"), F.lit(-121.8).alias("lon"), F.lit(1000).alias("alt_baro"))
    rows.coalesce(1).write.parquet(path)
    side = lambda: stateful.with_event_time(sources.table_stream(spark, path))
    pairs = stateful.fresh_pairs(side(), side(), 1.5, 400.0)
    plan = pairs._jdf.queryExecution().analyzed().toString()
    assert "ct1" in plan and "ct2" in plan
    got = [(r["seq1"], r["seq2"]) for r in stateful.run_available(pairs, "pairs").collect()]
    exp = {(a, b) for a in range(0, n, 2) for b in range(max(0, a - 5), min(n, a + 6)) if b % 2 and abs(a - b) * 1.25 <= 5}
    assert len(got) == len(exp) and set(got) == exp


def test_tiles_are_drawn_in_shares_of_steps(spark, monkeypatch):
    """Few long segments are much to draw, too; shares don't change a count."""
    rows = [(f"h{i % 7}", i % 3, i, i, 37 * i % 900, 11 * i % 700, 53 * i % 900, 29 * i % 700, 0) for i in range(60)]
    segments = spark.createDataFrame(rows, "hex string, flight_no long, now long, seq long, x0 long, y0 long, x1 long, y1 long, alt long")
    found = lambda: sorted(map(tuple, density.traffic_density(segments, 10).collect()))
    whole = found()
    for name, least in (("DRAW_STEPS", 200), ("DRAW_AT_ONCE", 50), ("MARKS_HELD", 100)):
        monkeypatch.setattr(density, name, least)
    assert found() == whole and len(whole) > 1000


def test_pyramid_holds_a_million_pixels_a_task():
    """a task's pixels are those of 4 ** fold tiles."""
    assert 4 ** inspect.signature(density.pyramid).parameters["fold"].default * 256**2 <= 1 << 20
