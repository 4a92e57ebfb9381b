import math
import random

import pytest
from pyspark.sql import functions as F

from contrail.functions import geo
from contrail.operators import los, proximity, sequence

SCHEMA = "tail string, hex string, seq long, now double, lat double, lon double, alt_baro long, gs double, track double, category string"


def hav(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 3443.92 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def fly(rnd, fractional):
    rows, seq = [], 0
    for a in range(6):
        t, la, lo = 1000.0, 40.0 + rnd.random() * 0.05, -119.0 + rnd.random() * 0.05
        for _ in range(60):
            t += rnd.choice([1, 2, 5, 20, 70]) + (rnd.choice([0, 0.25, -0.5]) if fractional else 0)
            la, lo = la + rnd.uniform(-0.01, 0.01), lo + rnd.uniform(-0.01, 0.01)
            rows.append((f"T{a}", f"h{a}", seq, t, la, lo, 3000 + rnd.randrange(0, 10) * 100, 100.0, 90.0, "A1"))
            seq += 1
    return rows


def brute(rows, lateral, vertical, hold):
    """Position of every aircraft at every second from consecutive reports."""
    at = {}
    for tail in {r[0] for r in rows}:
        pts = sorted((r for r in rows if r[0] == tail), key=lambda r: (r[3], r[2]))
        for i, r in enumerate(pts):
            prev = pts[i - 1] if i else None
            if prev and 1 < r[3] - prev[3] <= 60:
                for s in range(int(prev[3]) + 1, int(r[3])):
                    f = (s - prev[3]) / (r[3] - prev[3])
                    at[s, tail] = (prev[4] + f * (r[4] - prev[4]), prev[5] + f * (r[5] - prev[5]), int(prev[6] + f * (r[6] - prev[6])))
            at[int(r[3]), tail] = (r[4], r[5], r[6])
            nxt = pts[i + 1] if i + 1 < len(pts) else None
            if hold and (nxt is None or nxt[3] - r[3] > 60):
                for s in range(int(r[3]) + 1, int(r[3]) + hold + 1):
                    if nxt is None or s < int(nxt[3]):
                        at[s, tail] = (r[4], r[5], r[6])
    secs = {}
    for (s, tail), p in at.items():
        secs.setdefault(s, []).append((tail, p))
    out = set()
    for s, lst in secs.items():
        for i, (t1, p1) in enumerate(lst):
            for t2, p2 in lst[i + 1:]:
                if abs(p1[2] - p2[2]) < vertical and hav(p1[:2], p2[:2]) < lateral:
                    out.add((s, *sorted((t1, t2))))
    return out


@pytest.mark.parametrize("fractional", [False, True])
@pytest.mark.parametrize("hold", [0, 5])
def test_near_pairs_equal_brute_force(spark, fractional, hold):
    rows = fly(random.Random(3), fractional)
    steps = sequence.flight_steps(spark.createDataFrame(rows, SCHEMA))
    got = proximity.near_pairs(proximity.track_pieces(steps, hold=hold), 1.0, 500.0)
    assert {(r["sec"], r["tail1"], r["tail2"]) for r in got.collect()} == brute(rows, 1.0, 500.0, hold)


def jumps(rnd):
    """Aircraft that now and then report from degrees away, and come back."""
    rows = []
    for i, r in enumerate(fly(rnd, True)):
        far = rnd.random() < 0.15
        rows.append((*r[:4], r[4] + (rnd.uniform(-30, 30) if far else 0), r[5] + (rnd.uniform(-60, 60) if far else 0), r[6] + (20_000 if far else 0), *r[7:]))
    return rows


@pytest.mark.parametrize("hold", [0, 5])
def test_near_pairs_of_jumping_tracks(spark, hold):
    rows = jumps(random.Random(11)) + [(f"J{i}", "j", 1000 + 100 * i + k, 1000.0 + 20 * k, 40.0 + 2.0 * k, -119.0 + 3.0 * k + i * 1e-3, 3000, 100.0, 90.0, "A1") for i in range(2) for k in range(20)]
    steps = sequence.flight_steps(spark.createDataFrame(rows, SCHEMA))
    got = proximity.near_pairs(proximity.track_pieces(steps, hold=hold), 1.0, 500.0)
    expected = brute(rows, 1.0, 500.0, hold)
    assert {(r["sec"], r["tail1"], r["tail2"]) for r in got.collect()} == expected and any(t1 == "J0" for _, t1, _ in expected)


def test_a_jump_is_copied_along_its_line_only(spark):
    rows = [("N1", "h", 0, 1000.0, -20.0, -150.0, 0, 100.0, 90.0, "A1"), ("N1", "h", 1, 1060.0, 40.0, -30.0, 40_000, 100.0, 90.0, "A1"),
            ("N2", "i", 2, 1000.0, 40.0, -119.0, 3000, 100.0, 90.0, "A1"), ("N2", "i", 3, 1059.0, 40.13, -119.07, 3900, 100.0, 90.0, "A1")]
    cut = proximity._cut(proximity.track_pieces(sequence.flight_steps(spark.createDataFrame(rows, SCHEMA))))
    none = F.lit(0.0)
    copies = {r["tail"]: r["count"] for r in proximity._spread(cut, none, none, none).groupBy("tail").count().collect()}
    assert copies["N1"] <= 62  # one place a second, where the box would have 1,200 x 2,400 x 40 cells
    assert copies["N2"] <= 10  # the cells of a slow line: 3 of latitude, 2 of longitude, 2 minutes
    seconds = sorted(s for r in cut.collect() if r.tail == "N1" for s in range(r.s0, r.s1 + 1))
    assert seconds == list(range(1000, 1061))
    grown = proximity._spread(cut, F.lit(0.02), F.lit(0.03), F.lit(1000.0)).where("tail = 'N1'").count()
    assert grown <= 62 * 2 * 2 * 3


def test_interpolation_fills_every_second(spark):
    rows = [("N1", "h", i, float(t), 40.0 + t * 1e-4, -119.0, 3000, 100.0, 90.0, "A1") for i, t in enumerate((1000, 1005, 1040))]
    out = sequence.resample(sequence.flight_steps(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted(r["sec"] for r in out) == list(range(1000, 1041))
    assert sum(r["resampled"] for r in out) == 38


def test_teleport_and_speed_jump(spark):
    def flags(points):
        rows = [("N1", "h", i, 1000.0 + t, 40.0 + d, -119.0, 3000, 100.0, 90.0, "A1") for i, (t, d) in enumerate(points)]
        return [(r["suspicious"], r["teleport"]) for r in sequence.flight_steps(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()]

    assert flags([(0, 0), (5, 1.0)]) == [(False, False), (True, True)]
    assert [s for s, _ in flags([(0, 0), (10, 0.004), (20, 0.018)])] == [False, False, True]
    assert [s for s, _ in flags([(0, 0), (10, 0.004), (20, 0.008)])] == [False, False, False]


def test_nearest_in_time_prefers_later_on_ties(spark):
    a = spark.createDataFrame([("k", 10.0, 1)], "k string, t double, s int")
    b = spark.createDataFrame([("k", 7.0, 1, "before"), ("k", 13.0, 2, "after"), ("z", 10.0, 3, "other")], "k string, t double, s int, name string")
    got = proximity.nearest_in_time(a, b, ["k"], "t", ["name"], ["s"], 5.0, width=2.0).first()
    assert got["b_name"] == "after"
    assert proximity.nearest_in_time(a, b, ["k"], "t", ["name"], ["s"], 2.0, width=2.0).first()["b_name"] is None


# --- event score ----------------------------------------------------------------

BASE = dict(
    duration_s=10.0, track_s1=300.0, track_s2=300.0, initial_sep_nm=5.0, category1="A1", category2="A1", lateral_nm=0.25, alt_sep_ft=300.0, near1=5, near2=5,
    during1=8, during2=8, flight_id1="N1_1", flight_id2="N2_1", close_ratio=0.1, paired=20, stop1=5000.0, stop2=5000.0, create_time=1000.0)
TYPES = ("duration_s double, track_s1 double, track_s2 double, initial_sep_nm double, category1 string, category2 string, lateral_nm double, alt_sep_ft double, near1 int, near2 int,"
         "during1 int, during2 int, flight_id1 string, flight_id2 string, close_ratio double, paired long, stop1 double, stop2 double, create_time double")


@pytest.mark.parametrize("change,quality,why", [
    ({}, "high", "brief event 0.2min with good tracks"),
    ({"lateral_nm": 0.1, "alt_sep_ft": 100.0}, "vhigh", "very close CPA (0.10nm, 100ft)"),
    ({"duration_s": 91.0, "initial_sep_nm": 0.5}, "low", "likely formation flight"),
    ({"duration_s": 91.0, "initial_sep_nm": None}, "low", "likely formation flight"),
    ({"duration_s": 91.0}, "medium", "started separated (5.0 nm)"),
    ({"category2": "A7"}, "low", "helicopter involved"),
    ({"track_s1": 59.0}, "low", "short track 1.0min"),
    ({"duration_s": 31.0}, "medium", "moderate duration 0.5min"),
    ({"near2": 0}, "low", "no sane data near CPA N2_1"),
    ({"during1": 0}, "medium", "sparse data during LOS N1_1: 0 real during 10s event"),
    ({"duration_s": 5.0, "during1": 0}, "high", "brief"),
    ({"close_ratio": 0.5, "initial_sep_nm": 0.9}, "low", "sustained proximity (50% of 20 paired"),
    ({"close_ratio": 0.5}, "high", "brief"),
    ({"stop2": 990.0}, "low", "track ended before LOS N2_1: last real 10s before event"),
    ({"track_s2": 90.0}, "high", "; track=1.5min"),
    ({"lateral_nm": 0.1, "alt_sep_ft": 100.0, "track_s2": 90.0}, "vhigh", "very close"),
])
def test_score(spark, change, quality, why):
    row = {**BASE, **change}
    df = spark.createDataFrame([tuple(row.values())], TYPES)
    none = F.lit(None).cast("struct<now:double,kt:double,t0:double>")
    r = los.score(df.withColumn("teleport1", none).withColumn("teleport2", none)).first()
    assert r["quality"] == quality
    assert why in r["quality_explanation"]


def test_score_teleport(spark):
    df = spark.createDataFrame([tuple(BASE.values())], TYPES)
    bad = F.struct(F.lit(100.0).alias("now"), F.lit(350.0).alias("kt"), F.lit(90.0).alias("t0"))
    r = los.score(df.withColumn("teleport1", bad).withColumn("teleport2", F.lit(None).cast("struct<now:double,kt:double,t0:double>"))).first()
    assert (r["quality"], r["quality_explanation"]) == ("low", "teleportation N1_1: 350kts between t=90-100")


def test_whole_chain(spark):
    rows = []
    for i, t in enumerate(range(0, 200, 2)):
        rows.append(("N1", "h1", 2 * i, 1000.0 + t, 40.0 + (t - 100) * 0.0008, -119.0, 3000, 150.0, 0.0, "A1"))
        rows.append(("N2", "h2", 2 * i + 1, 1000.0 + t, 40.0, -119.0 + (t - 100) * 0.0008, 3100, 150.0, 90.0, "A1"))
    ev = los.los_events(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(ev) == 1
    e = ev[0]
    assert (e["flight1"], e["flight2"], e["alt_band"], e["timestamp"]) == ("N1", "N2", "3k-6k", 1100.0)
    assert e["quality"] == "vhigh" and e["alt_sep_ft"] == 100.0
    assert len(e.asDict()) == 16 and e["track1"].startswith("[[1000.0")
    cells = spark.createDataFrame([r + (i % 2,) for i, r in enumerate(rows)], SCHEMA + ", cell int")
    assert los.los_events(cells, isolate_by=("cell",), with_tracks=False).count() == 0
