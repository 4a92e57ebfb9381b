"""Two-level sequences equal plain windows, whatever the slice width or key share."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from contrail.operators.skew import exact_rank, salted_join
from contrail.operators.timeline import fitted_width, numbered, prefixed, ranged, running, timeline


@pytest.fixture(scope="module")
def rows(spark):
    """One key owns most rows; times repeat and have long silences."""
    rnd = random.Random(7)
    data, t = [], 0.0
    for i in range(1500):
        t += rnd.choice([0, 0.5, 1, 1, 7, 30, 61, 200])
        key = "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}"
        data.append((i, key, t, rnd.choice([None, "a", "b"]), rnd.randrange(10)))
    return spark.createDataFrame(data, "seq long, key string, now double, mark string, v int").cache()


def as_set(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("width", [3.0, 100.0, 1e7])
def test_lags_sessions_and_next(rows, width):
    out = timeline(rows, ["key"], "now", ["seq"], lag=["v"], depth=3, gap=60, following=True, width=width)
    got = out.select("seq", "session_no", "next_time", *[F.col(f"prev{i}.v").alias(f"p{i}") for i in (1, 2, 3)])
    w = Window.partitionBy("key").orderBy("now", "seq")
    exp = rows.withColumn("b", F.when(F.col("now") - F.lag("now").over(w) > 60, 1).otherwise(0))
    exp = exp.select("seq", (F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).alias("session_no"),
                     F.lead("now").over(w).alias("next_time"), *[F.lag("v", i).over(w).alias(f"p{i}") for i in (1, 2, 3)])
    assert as_set(got) == as_set(exp)


@pytest.mark.parametrize("width", [3.0, 100.0, 1e7])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running(rows, width, inclusive):
    got = running(rows, ["key"], "now", ["seq"], sums={"s": F.col("v")}, lasts={"l": F.col("mark")}, nexts={"n": F.col("mark")}, inclusive=inclusive, width=width)
    w = Window.partitionBy("key").orderBy("now", "seq")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1), w.rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
    exp = rows.select("seq", F.coalesce(F.sum("v").over(back), F.lit(0)).alias("s"), F.last("mark", True).over(back).alias("l"), F.first("mark", True).over(ahead).alias("n"))
    assert as_set(got.select("seq", "s", "l", "n")) == as_set(exp)


def test_numbered_prefixed_and_width(rows):
    exp = rows.select("seq", (F.row_number().over(Window.orderBy("now", "seq")) - 1).cast("bigint").alias("row_no"))
    assert as_set(numbered(rows, ["now", "seq"]).select("seq", "row_no")) == as_set(exp)
    sums = rows.select("seq", F.sum("v").over(Window.orderBy("now", "seq").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert as_set(prefixed(rows, ["now", "seq"], {"s": F.col("v")}).select("seq", "s")) == as_set(sums)
    assert numbered(rows.where("false"), ["now"]).count() == prefixed(rows.where("false"), ["now"], {"s": F.col("v")}).count() == 0
    assert fitted_width(rows, ["key"], "now", 1e6, rows=100) < 1e6


def test_a_stray_time_and_equal_times_leave_ranges_even(spark):
    """One row at time 0, the others within a minute decades later, half of them at one instant."""
    df = spark.range(20_000).select(F.col("id").alias("seq"), F.when(F.col("id") == 0, 0.0).when(F.col("id") % 2 == 0, 1.7e9).otherwise(1.7e9 + F.col("id") / 400).alias("now"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a table is one range
    try:
        sizes = {r["_range"]: r["count"] for r in ranged(df, ["now"]).groupBy("_range").count().collect()}
        firsts = ranged(df, ["now"]).groupBy("_range").agg(F.min("now").alias("lo"), F.max("now").alias("hi")).orderBy("_range").collect()
        got = numbered(df, ["now", "seq"]).orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(sizes.values()) < 2 * 20_000 / 4
    assert all(a.hi <= b.lo for a, b in zip(firsts, firsts[1:]))
    assert [r.row_no for r in got] == list(range(20_000)) and [(r.now, r.seq) for r in got] == sorted((r.now, r.seq) for r in got)


def test_salted_join_equals_join(rows, spark):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("other", 3)], "key string, d int")
    for how in ("inner", "left"):
        got = salted_join(rows, dim, ["key"], how, salts=7, share=0.2).select("seq", "key", "d")
        assert as_set(got) == as_set(rows.join(dim, "key", how).select("seq", "key", "d"))


def test_exact_rank(rows):
    got = exact_rank(rows, ["key"], "now", {"m": F.floor(F.col("_total") / 2), "p": F.floor(F.col("_total") * 0.9)}, 50.0)
    for r in got.collect():
        vals = sorted(x["now"] for x in rows.where(F.col("key") == r["key"]).collect())
        assert (r["n"], r["m"], r["p"]) == (len(vals), vals[len(vals) // 2], vals[int(len(vals) * 0.9)])
