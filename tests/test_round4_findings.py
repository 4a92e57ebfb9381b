"""One small test for each finding of round 4's list (FINDINGS_r03) that was right."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from contrail.llm import pieces
from contrail.operators import airport, folds, proximity, sequence
from contrail.plans import rules
from contrail.streaming import stateful
from test_paced import walk


def test_coupled_pauses_take_few_rounds(spark, monkeypatch):
    """stretches of slices are walked, so rounds don't follow the number of slices; short stretches give the same."""
    rng = random.Random(7)
    rows = [(float(i), i, f"N{rng.randrange(40)}", None) for i in range(6000) if rng.random() < 0.8]
    df = spark.createDataFrame([("r", *r, 150.0, 45.0) for r in rows], "rule string, at double, i long, one string, two string, p double, q double")
    calls, stage = [], folds.stage
    monkeypatch.setattr(folds, "stage", lambda *a: calls.append(a[1]) or stage(*a))
    run = lambda: [r["i"] for r in folds.paced(df, ["rule"], "at", ["i"], [("one", "at"), ("two", "at")], "p", "q", width=100.0).orderBy("i").collect()]
    assert run() == walk(rows, 150.0, 45.0)
    assert len(calls) < 10
    monkeypatch.setattr(folds, "STRETCH_SLICES", 3)
    assert run() == walk(rows, 150.0, 45.0)


def test_coverage_is_counted_in_one_shuffle_of_reports(spark, monkeypatch):
    """what is written are counts; gaps and changes between slices, tracks of two points and equal times are right."""
    rng = random.Random(3)
    rows = [("KAXX", 1, f"h{h}", float(rng.randrange(0, 4000, 7)), i, 36.5 + rng.choice([0.0, 0.2]), -121.8, 500.0) for i, h in enumerate([0] * 90 + [1] * 60 + [2, 2, 3])]
    df = spark.createDataFrame(rows, "icao string, date long, hex string, now double, seq long, lat double, lon double, alt_baro double")
    df = df.withColumns({"elev": F.lit(0.0), "ap_lat": F.lit(36.5), "ap_lon": F.lit(-121.8)})
    written, stage = [], airport.stage
    monkeypatch.setattr(airport, "stage", lambda *a: written.append(stage(*a)) or written[-1])
    tracks, gaps = {}, Counter()
    for h in range(4):
        mine = sorted((r[3], r[4], r[5] == 36.5) for r in rows if r[2] == f"h{h}")
        steps = list(zip(mine, mine[1:]))
        tracks[f"h{h}"] = (len(mine), sum(a[2] != b[2] for a, b in steps))
        if len(mine) >= 3:
            gaps.update(b[0] - a[0] for a, b in steps if 0 < b[0] - a[0] <= 300)
    assert {r["hex"]: (r["points"], r["transitions"]) for r in airport.coverage_tracks(df, 100.0).collect()} == tracks
    assert {r["gap"]: r["times"] for r in airport.coverage_gaps(df, 100.0).collect()} == dict(gaps)
    assert len(written) == 2 and all("times" in w.columns for w in written)


def test_exploded_seconds_are_worked_out_once(spark):
    """No filter works out the seconds of a pair, or of a step, before they are exploded."""
    rows = [(f"N{i % 3}", float(i), i, 36.5 + i % 7 * 0.001, -121.8, 1000 + i % 5, 80.0, 10.0 * (i % 36), f"h{i % 3}", "A1") for i in range(0, 90, 2)]
    df = spark.createDataFrame(rows, "tail string, now double, seq long, lat double, lon double, alt_baro long, gs double, track double, hex string, category string")
    steps = sequence.flight_steps(df)
    pairs = proximity.near_pairs(proximity.track_pieces(steps), 0.3, 400.0)
    for out in (pairs, sequence.resample(steps)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() and "size(" not in plan
    assert {tuple(r) for r in pairs.select("tail1", "tail2").distinct().collect()} == {("N0", "N1"), ("N0", "N2"), ("N1", "N2")}


def test_seconds_are_counted_in_tasks_of_bounded_rows(spark, monkeypatch):
    """tasks that count the aircraft of a second grow in number with the points."""
    monkeypatch.setattr(rules, "SECOND_ROWS", 100)
    points = spark.range(1000).select((F.col("id") % 50).alias("sec"), F.concat(F.lit("N"), (F.col("id") % 7).cast("string")).alias("tail"))
    got, plans = {}, []
    engine = rules.Engine(rules.Rules({"rules": {}}, [], []))
    engine.on_seconds(lambda df: (plans.append(df.rdd.getNumPartitions()), got.update({r["sec"]: (r["points"], r["aircraft"]) for r in df.collect()})))
    engine.dispatch_resampled(points)
    assert got == {s: (20, len({i % 7 for i in range(s, 1000, 50)})) for s in range(50)}
    assert plans[0] >= 10


def test_tracker_holds_numbers(spark):
    """a key's reports in a batch are held in some 20 bytes each, whatever the number of them."""
    held = {}

    class Frame:
        select = groupBy = lambda self, *a: self

        def applyInPandasWithState(self, step, *rest):
            held["step"] = step

    class State:
        hasTimedOut, exists = False, False
        update = setTimeoutTimestamp = lambda self, *a: None

        def getCurrentWatermarkMs(self):
            return 0

    n, size = 200_000, 10_000
    batches = (pd.DataFrame({"tail": "N1", "seq": np.arange(lo, lo + size), "now": np.arange(lo, lo + size) * 1.0, "inside": [np.array(["ground", None], object)] * size})
               for lo in range(n - size, -1, -size))
    stateful.track(Frame())
    tracemalloc.start()
    rows = sum(int((out["kind"] == "report").sum()) for out in held["step"](("N1",), batches, State()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 40e6


def test_decimated_rows_are_shuffled_once(spark, monkeypatch):
    """Rows ride in their slice's array, in tasks of bounded rows; Python runs once a step; maps pass, too."""
    rows = [(f"f{i % 3}", i, float(i * 7 % 40), i * 2.0, {"i": i}) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, sec long, track double, lat double, m map<string,int>")
    exp = set()
    for k in ("f0", "f1", "f2"):
        mine, kept = [r for r in rows if r[0] == k], None
        for r in mine:
            if kept is None or abs(r[2] - kept) >= 10:
                kept = r[2]
                exp.add((k, r[1], r[3]))
        exp.add((k, mine[-1][1], mine[-1][3]))
    monkeypatch.setattr(folds, "TRACK_ROWS", 50)
    for out in (folds.decimate(df.drop("m"), ["k"], width=100.0), folds.decimate(df, ["k"], width=100.0)):
        assert {(r["k"], r["sec"], r["lat"]) for r in out.collect()} == exp
    plan = folds.decimate(df.drop("m"), ["k"], width=100.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("finish(") == 1 and "LeftSemi" not in plan
    assert "RepartitionByExpression [k" in plan and ", 12" in plan
    assert folds.decimate(df.where("false"), ["k"]).count() == 0


def test_gap_marks_take_tasks_of_bounded_rows(spark, monkeypatch):
    """one shuffle of rows, in tasks that grow in number with them; runs across slices, and without a report at all, are whole."""
    rng = random.Random(5)
    rows, exp = [], {}
    for k in ("a", "b", "c"):
        sec, mine = 0, []
        for i in range(300):
            sec += rng.choice([1, 1, 1, 2, 5])
            mine.append((k, sec, k == "c" or rng.random() < 0.7))
        runs, no = {}, 0
        for r in mine:
            no += not r[2]
            if r[2]:
                runs.setdefault(no, []).append(r[1])
        before, no = None, 0
        for r in mine:
            no += not r[2]
            exp[r[:2]] = before is not None and r[1] - before > 2 or r[2] and runs[no][-1] - runs[no][0] > 2
            before = r[1]
        rows += mine
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, sec long, resampled boolean")
    monkeypatch.setattr(sequence, "MARK_ROWS", 50)
    for width in (1.0, 4.0, 30.0, 1e9):
        out = sequence.gap_marks(df, ["k"], width=width)
        assert out.columns == ["k", "sec", "resampled", "in_gap"]
        assert {(r["k"], r["sec"]): r["in_gap"] for r in out.collect()} == exp
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [k" in plan and ", 18" in plan


def test_pieces_are_found_without_walking_the_trie(monkeypatch):
    """op5: shorter pieces are known from longer ones; a string is remembered as its numbers; merges in full give the same."""
    def wire(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    words = ["a", "b", "c", "\u2581", "ab", "bc", "\u2581a", "abc", "cab", "\u2581ab", "bcab", "ca", "\u2581abca"]
    made = [("<unk>", 2), ("<s>", 3), *[(f"<0x{i:02X}>", 6) for i in range(256)], *[(w, 1) for w in words]]
    model = b"".join(wire(1, wire(1, w.encode()) + b"\x15" + np.float32(-i).tobytes() + bytes([24, kind])) for i, (w, kind) in enumerate(made))
    machine = pieces.Transducer(model + wire(2, bytes([24, 2, 0x98, 2, 1])))
    monkeypatch.setattr(machine, "along", None)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aabbcc d\n") for _ in range(rng.randrange(1, 30)))
        whole = machine.merged(machine.normalise(text))
        expected = [i for w in whole for i in ([machine.ids[w]] if w in machine.ids else [machine.bytes[x] for x in w.encode()])]
        numbers, spelled = machine.both(text)
        assert np.frombuffer(numbers, np.int32).tolist() == expected and machine.said(spelled) == re.sub(" +", " ", text.strip(" "))
    assert {type(x) for x in machine.parts.values()} == {bytes}
