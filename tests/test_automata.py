"""Visits, pieces and runs against a plain walk over each key's rows, whatever the slices."""

import random

import pytest
from pyspark.sql import functions as F

from contrail.operators.automata import longest_runs, visits_and_pieces


def _walk(rows, gap):
    """(key, seq) -> visit, piece, seq of the row before in the piece."""
    out, last = {}, {}
    for key, now, seq, d in sorted(rows):
        s = last.get(key)
        if s is None or now - s["now"] > gap:
            s = {"visit": s["visit"] + 1 if s else 1, "piece": 0, "mark": None, "seq": None}
        out[key, seq] = (s["visit"], s["piece"], s["seq"])
        mark = None if d is None else "near" if d < 0.4 else "far" if d > 1.0 else None
        cut = mark == "far" and s["mark"] == "near"
        last[key] = {"now": now, "visit": s["visit"], "piece": s["piece"] + cut, "mark": mark or s["mark"], "seq": None if cut else seq}
    return out


def _rows(seed, n=700):
    r = random.Random(seed)
    rows, now = [], {}
    for seq in range(n):
        key = r.choice("aaab")
        now[key] = now.get(key, 0.0) + r.choice([0, 1, 2, 5, 9, 25])
        rows.append((key, float(now[key]), seq, r.choice([0.1, 0.7, 0.7, 2.0, 2.0, None])))
    return rows


@pytest.mark.parametrize("width", [1.0, 7.0, 40.0, 1e6])
def test_visits_and_pieces_equal_a_walk(spark, width):
    rows = _rows(int(width))
    df = spark.createDataFrame(rows, "key string, now double, seq long, d double")
    got = visits_and_pieces(df, ["key"], "now", ["seq"], F.col("d") < 0.4, F.col("d") > 1.0, 20.0, ["seq"], width)
    got = {(r["key"], r["seq"]): (r["visit"], r["piece"], r["before"]["seq"] if r["before"] else None) for r in got.collect()}
    assert got == _walk(rows, 20.0)
    assert len({v[:2] for v in got.values()}) > 20


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, now double, seq long, d double")
    assert visits_and_pieces(df, ["key"], "now", ["seq"], F.col("d") < 0.4, F.col("d") > 1.0, 20.0).collect() == []


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_longest_runs_equal_a_walk(spark, width):
    r = random.Random(width)
    rows = [(r.choice("aab"), float(i), i, i // width, r.random() < 0.8, float(r.randint(0, 9))) for i in range(400)]
    rows += [("never", float(i), i, i // width, False, 1.0) for i in range(5)] + [("always", float(i), i, i // width, True, 1.0) for i in range(50)]
    best, now = {}, {}
    for key, _, _, _, ok, length in sorted(rows):
        now[key] = now.get(key, 0.0) + length if ok else 0.0
        best[key] = max(best.get(key, 0.0), now[key])
    df = spark.createDataFrame(rows, "key string, now double, seq long, _slice long, ok boolean, length double")
    got = {x["key"]: x["run"] for x in longest_runs(df, ["key"], "now", ["seq"], "ok", "length").collect()}
    assert got == best


def test_the_reports_are_shuffled_twice_at_most(spark):
    """Once for the rows, once for the slices' maps; what follows on the rows keeps their partitioning."""
    df = spark.createDataFrame(_rows(3), "key string, now double, seq long, d double")
    out = visits_and_pieces(df, ["key"], "now", ["seq"], F.col("d") < 0.4, F.col("d") > 1.0, 20.0)
    runs = longest_runs(out.withColumns({"ok": F.col("d") > 0.5, "one": F.lit(1.0)}), ["key", "visit", "piece"], "now", ["seq"], "ok", "one")
    plan = runs._jdf.queryExecution().executedPlan().toString().splitlines()
    sliced = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line and "_slice" in line]
    # the third one moves the maps, one row a slice, back to the rows
    assert len(sliced) == 3 and sum("_mark" in plan[i + 1] for i in sliced) == 2
