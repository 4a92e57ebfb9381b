"""Sliced greedy folds equal a plain walk, for many slice widths."""

import random

import pytest
from pyspark.sql import functions as F

from contrail.operators import folds


def circular(a, b):
    d = abs(a - b)
    return 360 - d if d > 180 else d


@pytest.mark.parametrize("width", [5.0, 60.0, 1e9])
@pytest.mark.parametrize("cd", [0.0, 7.0, 90.0])
def test_cooldown(spark, width, cd):
    rnd = random.Random(int(width + cd))
    rows = [("hot" if rnd.random() < 0.8 else "x", float(rnd.randrange(0, 1500)) + rnd.choice([0, 0.5]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "key string, now double, seq long").withColumn("cooldown_s", F.lit(cd))
    got = {r["seq"] for r in folds.cooldown(df, ["key"], "now", ["seq"], "cooldown_s", width).collect()}
    last, exp = {}, set()
    for k, t, s in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= cd:
            last[k] = t
            exp.add(s)
    assert got == exp


def test_cooldown_of_one_long_path_takes_logarithmic_rounds(spark, monkeypatch):
    """A rule's matches at every second of three days, pause one hour, slices of ten minutes."""
    rounds, written = [], folds.stage
    monkeypatch.setattr(folds, "stage", lambda df, name: rounds.append(name) or written(df, name))
    df = spark.range(259_200).select(F.lit("rule").alias("key"), F.col("id").cast("double").alias("now"), F.col("id").alias("seq"), F.lit(3600.0).alias("cooldown_s"))
    got = sorted(r["seq"] for r in folds.cooldown(df, ["key"], "now", ["seq"], "cooldown_s", 600.0).collect())
    assert got == list(range(0, 259_200, 3600))  # 72 firings
    assert rounds.count("jumps") <= 9


def test_cooldown_keys_of_several_pauses(spark):
    rows = [(k, float(t), t, cd) for k, cd in (("none", 0.0), ("short", 3.0), ("long", 50.0)) for t in range(100)] + [("short", 99.0, 100, 3.0)]
    df = spark.createDataFrame(rows, "key string, now double, seq long, cooldown_s double")
    got = {}
    for r in folds.cooldown(df, ["key"], width=10.0).collect():
        got.setdefault(r.key, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {"none": list(range(100)), "short": list(range(0, 100, 3)), "long": [0, 50]}
    assert folds.cooldown(df.where("false"), ["key"]).count() == 0


@pytest.mark.parametrize("width", [4.0, 37.0, 1e9])
@pytest.mark.parametrize("step", [1, 6, 40])
def test_decimate(spark, width, step):
    rnd = random.Random(step * 31 + int(width))
    rows = []
    for k in ("a", "b"):
        h = 350.0
        for s in range(300):
            h = (h + rnd.choice([-1, 0, 1]) * rnd.randrange(0, step + 1)) % 360
            rows.append((k, s, h))
    df = spark.createDataFrame(rows, "k string, sec long, track double")
    got = {(r["k"], r["sec"]) for r in folds.decimate(df, ["k"], "sec", width=width).collect()}
    exp = set()
    for k in ("a", "b"):
        pts = [r for r in rows if r[0] == k]
        kept = pts[0][2]
        exp |= {(k, pts[0][1]), (k, pts[-1][1])}
        for _, s, h in pts[1:-1]:
            if circular(h, kept) >= 10:
                kept = h
                exp.add((k, s))
    assert got == exp


@pytest.mark.parametrize("width", [3.0, 20.0, 1e9])
def test_closest_approach(spark, width):
    rnd = random.Random(int(width))
    rows = [(k, s, rnd.randrange(0, 12) / 10, float(rnd.randrange(0, 12))) for k in ("p", "q", "r") for s in range(120)]
    df = spark.createDataFrame(rows, "k string, sec long, lateral_nm double, alt_sep_ft double")
    got = {(r["k"], r["sec"]) for r in folds.closest_approach(df, ["k"], "sec", width=width).collect()}
    exp = set()
    for k in ("p", "q", "r"):
        cur = None
        for _, s, la, al in (r for r in rows if r[0] == k):
            if cur is None or la < cur[0] or al < cur[1]:
                cur = (la, al)
                exp.add((k, s))
    assert got == exp
