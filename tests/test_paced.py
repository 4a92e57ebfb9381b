"""Coupled pauses against a plain walk; many slices, so states travel through rounds."""

import math
import random

from contrail.operators import folds


def walk(rows, wait, wait_all):
    last, out = {}, []
    for at, i, one, two in sorted(rows):
        names = [n for n in (one, two) if n is not None]
        if all(at - last.get(n, -math.inf) >= wait and at - last.get("", -math.inf) >= wait_all for n in names):
            out.append(i)
            last[one] = last[""] = at
    return out


def test_paced_equals_a_plain_walk(spark):
    rng = random.Random(5)
    rows = [(float(rng.randrange(900)), i, f"N{rng.randrange(6)}", rng.choice([None, "N1", "N7"])) for i in range(600)]
    rows = [(at, i, one, two if two != one else None) for at, i, one, two in rows]
    for wait, wait_all in ((70.0, 9.0), (70.0, -math.inf), (0.0, 30.0)):
        df = spark.createDataFrame([("r", *r, wait, wait_all) for r in rows], "rule string, at double, i long, one string, two string, p double, q double")
        out = folds.paced(df, ["rule"], "at", ["i"], [("one", "at"), ("two", "at")], "p", "q", width=50.0)
        assert [r["i"] for r in out.orderBy("at", "i").collect()] == walk(rows, wait, wait_all)


def test_paced_on_an_empty_table(spark):
    df = spark.createDataFrame([], "rule string, at double, i long, one string, p double, q double")
    assert folds.paced(df, ["rule"], "at", ["i"], [("one", "at")], "p", "q").count() == 0


def test_checkpoints_follow_the_data(spark):
    times = [0.4, 3.0, 5.0, 6.0, 9.9, 10.0, 11.0, 40.0, 41.0, 45.5, 46.0]
    df = spark.createDataFrame([(x,) for x in times], "now double")
    assert sorted(r["sec"] for r in folds.checkpoints(df).collect()) == [5, 10, 40, 45]


def test_looking_ahead_is_linear(spark):
    """200,000 rows of one key in one slice: the next marked row of each."""
    from pyspark.sql import functions as F

    from contrail.operators.timeline import running

    df = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") / 1000).alias("now"), F.col("id").alias("seq"))
    mark = F.when(F.col("seq") % 1000 == 0, F.col("seq"))
    out = running(df, ["k"], "now", ["seq"], nexts={"ahead": mark}, inclusive=False, width=600.0)
    wrong = out.where(~F.col("ahead").eqNullSafe(F.when(F.col("seq") < 199_000, (F.floor(F.col("seq") / 1000) + 1) * 1000)))
    assert wrong.count() == 0
