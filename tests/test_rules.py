"""Rule cases: transitions, changes, cooldowns, lists, attributes, notes."""

import json

import pytest
from pyspark.sql import functions as F

from contrail.operators import regions, sequence
from contrail.plans import rules as R
from contrail.sources.lines import parse_reports, tracked

BOX = lambda la, lo, d: [(lo - d, la - d), (lo + d, la - d), (lo + d, la + d), (lo - d, la + d)]
REGION = lambda name, low, high, ring: {"name": name, "min_alt": low, "max_alt": high, "hdg0": 0, "hdg1": 360, "ring": ring}
LAYERS = [[
    REGION("Generic Gate Ground", 0, 4100, BOX(40.763537, -119.2122323, 0.01)),
    REGION("Generic Gate Air", 0, 5000, BOX(40.748708, -119.2489313, 0.01)),
]]
GROUND, AIR, DISTANT = (40.763537, -119.2122323, 4000), (40.748708, -119.2489313, 4500), (41.763537, -119.2122323, 4000)


def reports(spark, points, **extra):
    """points: (now, (lat, lon, alt)[, hex])"""
    lines = []
    for i, p in enumerate(points):
        now, (lat, lon, alt), hex_id = p[0], p[1], (p[2] if len(p) > 2 else "a061d9")
        lines.append((i, json.dumps({"now": now, "alt_baro": alt, "gscp": 128, "lat": lat, "lon": lon, "track": 203.4, "hex": hex_id, **extra})))
    df = spark.createDataFrame(lines, "seq long, value string")
    return tracked(parse_reports(df))


def engine(conditions, actions=None, lists=None):
    return R.Rules({"aircraft_lists": lists or {}, "rules": {"r": {"conditions": conditions, "actions": actions or {"print": True}}}}, LAYERS, ["gate.kml"])


def fired(spark, conditions, points, lists=None, **extra):
    e = engine(conditions, lists=lists)
    return [r["seq"] for r in e.firings(e.prepare(reports(spark, points, **extra))).orderBy("seq").collect()]


def at(*spots, step=10):
    return [(1661692178.0 + i * step, s) for i, s in enumerate(spots)]


def test_transitions(spark):
    path = at(DISTANT, GROUND, AIR, GROUND, AIR, DISTANT)
    assert fired(spark, {"transition_regions": ["Generic Gate Ground", "Generic Gate Air"]}, path) == [2, 4]
    assert fired(spark, {"transition_regions": ["Generic Gate Air", "Generic Gate Ground"]}, path) == [3]
    assert fired(spark, {"transition_regions": ["~", "Generic Gate Ground"]}, path) == [1]
    assert fired(spark, {"transition_regions": ["Generic Gate Air", "~gate.kml"]}, path) == [5]
    assert fired(spark, {"transition_regions": ["~", "generic gate GROUND"]}, at(GROUND)) == [0]


def test_joined_and_departed(spark):
    path = at(DISTANT, GROUND, GROUND, AIR, GROUND, DISTANT)
    assert fired(spark, {"joined_region": "Generic Gate Ground"}, path) == [1, 4]
    assert fired(spark, {"departed_region": "Generic Gate Ground"}, path) == [3, 5]


def test_changed_regions(spark):
    assert fired(spark, {"changed_regions": "any"}, at(DISTANT, DISTANT, GROUND, GROUND, AIR, DISTANT)) == [2, 4, 5]
    assert fired(spark, {"changed_regions": True}, at(DISTANT, GROUND)) == [1]
    assert fired(spark, {"changed_regions": "strict"}, at(DISTANT, DISTANT, GROUND, GROUND, AIR, GROUND, DISTANT)) == [4, 5]


def test_regions_reset_with_a_new_life(spark):
    path = [(0.0, GROUND), (500.0, AIR)]
    assert fired(spark, {"transition_regions": ["Generic Gate Ground", "Generic Gate Air"]}, path) == []
    assert fired(spark, {"changed_regions": "any"}, path) == [0, 1]


def test_cooldown(spark):
    t = 1661692178.0
    assert fired(spark, {"cooldown": 3}, [(t, GROUND), (t + 100, GROUND), (t + 20000, GROUND)]) == [0, 2]
    assert len(fired(spark, {"cooldown": 0.5}, [(t + x, GROUND) for x in (0, 32, 64, 96, 111)])) == 4
    two = [(t, GROUND, "a061d9"), (t + 10, GROUND, "a00002"), (t + 70, GROUND, "a00002")]
    assert fired(spark, {"cooldown": 1}, two) == [0, 1, 2]
    assert fired(spark, {"rule_cooldown": 1}, two) == [0, 2]
    assert fired(spark, {"rule_cooldown": 1, "cooldown": 0.5}, two) == [0, 2]
    assert fired(spark, {"rule_cooldown": 1, "cooldown": 5}, two) == [0, 2]
    more = [(t, GROUND, "a061d9"), (t + 70, GROUND, "a061d9"), (t + 80, GROUND, "a00002"), (t + 320, GROUND, "a061d9"), (t + 400, GROUND, "a00002")]
    assert fired(spark, {"rule_cooldown": 1, "cooldown": 5}, more) == [0, 2, 3, 4]


@pytest.mark.parametrize("conditions,extra,hit", [
    ({"squawk": 7700}, {"squawk": "7700"}, True), ({"squawk": ["1200", 7700]}, {"squawk": "7500"}, False), ({"squawk": "7700"}, {}, False),
    ({"emergency": "any"}, {"emergency": "none"}, False), ({"emergency": "any"}, {"emergency": "general"}, True), ({"emergency": "any"}, {}, False),
    ({"emergency": ["lifeguard", "general"]}, {"emergency": "general"}, True),
    ({"category": "A1"}, {"category": "A1"}, True), ({"category": ["A2"]}, {"category": "A1"}, False), ({"category": "A1"}, {}, False),
    ({"exclude_category": "A7"}, {}, True), ({"exclude_category": "A7"}, {"category": "A7"}, False),
    ({"min_gs": 100}, {"gs": 100.5}, True), ({"max_gs": 100}, {"gs": 100.5}, False),
    ({"min_vertical_rate": 500}, {"baro_rate": 500}, True), ({"min_vertical_rate": 500}, {}, False), ({"max_vertical_rate": -500}, {"baro_rate": -600}, True),
    ({"callsign_prefix": ["N1", "N7"]}, {}, True), ({"callsign_prefix": "UAL"}, {"flight": "UAL12"}, False),
    ({"military": True}, {"dbFlags": 1}, True), ({"military": True}, {"dbFlags": 3}, False), ({"military": False}, {}, True),
    ({"has_attr": "gpsOkBefore"}, {"gpsOkBefore": None}, True), ({"has_attr": "gpsOkBefore"}, {}, False),
    ({"on_ground": False}, {}, True), ({"on_ground": True}, {}, False),
    ({"enabled": False}, {}, False), ({"enabled": True}, {}, True),
    ({"aircraft_list": "mine"}, {}, True), ({"aircraft_list": "unknown"}, {}, False), ({"exclude_aircraft_list": "mine"}, {}, False),
    ({"exclude_aircraft_list": "unknown"}, {}, False), ({"exclude_aircraft_substrs": ["N12"]}, {}, False), ({"exclude_aircraft_substrs": ["XY"]}, {}, True),
    ({"min_time": 1300, "max_time": 1309}, {}, True), ({"min_time": 1310}, {}, False), ({"time_ranges": [[2300, 100], [1309, 1310]]}, {}, True),
    ({"time_ranges": [[1200, 1309]]}, {}, False), ({"latlongring": [1, 40.763537, -119.2122323]}, {}, True), ({"latlongring": [1, 40.80, -119.21]}, {}, False),
    ({"regions": ["Generic Gate Ground"]}, {}, True), ({"regions": []}, {}, False), ({"regions": None}, {}, False),
])
def test_conditions(spark, conditions, extra, hit):
    tail = tracked(parse_reports(spark.createDataFrame([('{"hex":"a061d9","alt_baro":1}',)], "value string"))).first()["tail"]
    e = engine(conditions, lists={"mine": [tail]})
    rows = regions.assign_inline(reports(spark, [(1661692178.0, GROUND)], **extra), LAYERS)  # 13:09:38 UTC
    assert bool(e.rules and rows.where(e.predicate("r")).count()) == hit


def test_unknown_names_are_rejected():
    with pytest.raises(ValueError):
        engine({"no_such": 1})
    with pytest.raises(ValueError):
        engine({}, {"no_such": 1})


def test_notes_and_report(spark):
    doc = {"rules": {
        "gate": {"conditions": {"joined_region": "Generic Gate Ground"}, "actions": {"note": "local", "track": True}},
        "air": {"conditions": {"joined_region": "Generic Gate Air"}, "actions": {"track": True}}}}
    e = R.Rules(doc, LAYERS, ["gate.kml"])
    noted = e.with_notes(e.firings(e.prepare(reports(spark, at(AIR, GROUND, AIR)))))
    assert {(r["rule"], r["seq"], r["note"]) for r in noted.collect()} == {("air", 0, None), ("gate", 1, None), ("air", 2, "local")}
    assert {(r["rule"], r["note"], r["n"]) for r in e.report(noted).collect()} == {("air", None, 2), ("gate", None, 1), ("air", "local", 1)}


def test_engine_dispatch(spark):
    e = engine({"regions": ["Generic Gate Ground"]}, {"callback": "seen", "webhook": ["slack", "tower"], "expire_callback": "gone"})
    got = {}
    run = R.Engine(e).on("seen", lambda d: got.update(n=d.count())).channel("slack", lambda d: got.update(text=d.first()["message"]))
    run.on_expire("gone", lambda d: got.update(gone=d.count()))
    prepared = e.prepare(reports(spark, at(GROUND, GROUND)))
    run.dispatch(e.firings(prepared))
    run.dispatch_expired(prepared.where("seq = 1"))
    assert got["n"] == 2 and got["gone"] == 1
    assert got["text"].startswith("Rule r matched for: ") and "LIVE LINK: https" in got["text"]


def test_proximity_directions_and_lists(spark):
    near = [("N1", 40.7635, -119.2122, 4000), ("N2", 40.7640, -119.2122, 4300), ("N3", 40.7900, -119.2122, 4000), ("N4", 40.7635, -119.2121, 4800)]
    rows = [(t, t, i, 1000.0 + i, la, lo, al, 100.0, 90.0) for i, (t, la, lo, al) in enumerate(near)]
    df = spark.createDataFrame(rows, "tail string, hex string, seq long, now double, lat double, lon double, alt_baro long, gs double, track double")
    steps = sequence.flight_steps(df, carry=[])

    def pairs(**conditions):
        e = engine({"proximity": [400, 0.3], **conditions}, lists={"in": ["N1"], "both": ["N1", "N2"], "none": []})
        out = e.proximity_firings(steps, "r", interpolate=False, hold=5).select("tail1", "tail2").distinct().collect()
        return {tuple(r) for r in out}

    assert pairs() == {("N1", "N2"), ("N2", "N1")}
    assert pairs(one_in_aircraft_list="in") == {("N1", "N2"), ("N2", "N1")}
    assert pairs(one_in_aircraft_list="both") == set()
    assert pairs(one_in_aircraft_list="none") == set()
    assert pairs(min_alt=4200) == set()


def test_carried_attributes(spark):
    lines = [(0, '{"now":1,"alt_baro":1,"hex":"a061d9","category":"A1"}'), (1, '{"now":2,"alt_baro":1,"hex":"a061d9"}'),
             (2, '{"now":3,"alt_baro":1,"hex":"a061d9","category":null}'), (3, '{"now":900,"alt_baro":1,"hex":"a061d9"}')]
    df = tracked(parse_reports(spark.createDataFrame(lines, "seq long, value string")))
    out = sequence.carry_forward(sequence.life_segments(df)).orderBy("seq").collect()
    assert [r["category"] for r in out] == ["A1", "A1", None, None]
