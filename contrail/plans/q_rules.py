"""Rule conditions, region membership, cooldowns, notes and rule outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, regions, sequence
from ..session import stage
from . import rules as R
from . import tables as t
from .registry import query

P = t.POSITIONS_SQL
LISTS = {"fleet": ["N101", "N105", "N117", "N133"], "empty": []}


def _reports(spark, sf):
    """Reports with the keys present in the raw record."""
    keys = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("squawk", "emergency", "category", "baro_rate", "db_flags")]))
    return t.positions(spark, sf).withColumn("attrs", keys)


def _engine(conditions: dict, **actions) -> R.Rules:
    return R.Rules({"aircraft_lists": LISTS, "rules": {"rule": {"conditions": conditions, "actions": actions or {"print": True}}}}, t.REGION_LAYERS, t.REGION_FILES)


HHMM = "(CAST(now % 86400 AS BIGINT) // 3600 * 100 + CAST(now % 86400 AS BIGINT) % 3600 // 60)"
RING = t.haversine_sql("lat", "lon", "CAST(36.6 AS DOUBLE)", "CAST(-121.7 AS DOUBLE)")
CASES = {
    "F2_latlongring": ({"latlongring": [4.0, 36.6, -121.7]}, f"{RING} <= 4.0"),
    "F3_aircraft_list": ({"aircraft_list": "fleet"}, "tail IN ('N101', 'N105', 'N117', 'N133')"),
    "F4_exclude_aircraft_list": ({"exclude_aircraft_list": "fleet"}, "tail NOT IN ('N101', 'N105', 'N117', 'N133')"),
    "F6_exclude_substrs": ({"exclude_aircraft_substrs": ["10", "33"]}, "NOT contains(tail, '10') AND NOT contains(tail, '33')"),
    "F7_altitude_limits": ({"min_alt": 1150, "max_alt": 1500}, "alt_baro BETWEEN 1150 AND 1500"),
    "F13_squawk": ({"squawk": [7700, "4512"]}, "squawk IN ('7700', '4512')"),
    "F14_emergency_any": ({"emergency": "any"}, "emergency IS NOT NULL AND emergency <> 'none'"),
    "F14_emergency_listed": ({"emergency": ["none", "general"]}, "emergency IN ('none', 'general')"),
    "F15_category": ({"category": ["A1", "A7"]}, "category IN ('A1', 'A7')"),
    "F15_exclude_category": ({"exclude_category": "A3"}, "category <> 'A3'"),
    "F16_speed_and_rate": ({"min_gs": 90, "max_gs": 120, "min_vertical_rate": -640, "max_vertical_rate": 500}, "gs BETWEEN 90 AND 120 AND baro_rate BETWEEN -640 AND 500"),
    "F17_callsign_prefix": ({"callsign_prefix": ["N11", "N12"]}, "tail LIKE 'N11%' OR tail LIKE 'N12%'"),
    "F18_on_ground": ({"on_ground": True}, "on_ground"),
    "F19_military": ({"military": True}, "coalesce(db_flags = 1, false)"),
    "F19_not_military": ({"military": False}, "NOT coalesce(db_flags = 1, false)"),
    "F12_has_attr": ({"has_attr": "baro_rate"}, "baro_rate IS NOT NULL"),
    "F20_min_max_time": ({"min_time": 10, "max_time": 45}, f"{HHMM} BETWEEN 10 AND 45"),
    "F21_time_ranges": ({"time_ranges": [[2350, 15], [100, 130]]}, f"({HHMM} >= 2350 OR {HHMM} < 15) OR ({HHMM} >= 100 AND {HHMM} < 130)"),
}
NOWHERE = "in0 IS NULL AND in1 IS NULL"
REGION_CASES = {
    "F8_regions": ({"regions": ["Ground", "north FLOW"]}, "coalesce(in0 = 'ground', false) OR coalesce(in1 = 'north flow', false)"),
    "F8_regions_none": ({"regions": []}, NOWHERE),
    "F8_regions_not_in_file": ({"regions": ["~sectors.kml"]}, "in1 IS NULL"),
    "F9_transition_regions": ({"transition_regions": ["Ground", "Pattern"]}, "coalesce(was0 = 'ground', false) AND coalesce(in0 = 'pattern', false)"),
    "F9_transition_from_nowhere": ({"transition_regions": ["~", "Vicinity"]}, "was0 IS NULL AND was1 IS NULL AND coalesce(in0 = 'vicinity', false)"),
    "F10_joined_region": ({"joined_region": "Vicinity"}, "coalesce(in0 = 'vicinity', false) AND NOT coalesce(was0 = 'vicinity', false)"),
    "F10_departed_region": ({"departed_region": "North flow"}, "coalesce(was1 = 'north flow', false) AND NOT coalesce(in1 = 'north flow', false)"),
    "F11_changed_regions": ({"changed_regions": "any"}, "in0 IS DISTINCT FROM was0 OR in1 IS DISTINCT FROM was1"),
    "F11_changed_strict": ({"changed_regions": "strict"}, "(in0 IS DISTINCT FROM was0 OR in1 IS DISTINCT FROM was1) AND coalesce(in0, in1) IS NOT NULL AND coalesce(was0, was1) IS NOT NULL"),
}


def _register(name: str, conditions: dict, where: str, located: bool):
    base = t.REGIONS_SQL if located else P
    source = "prepared" if located else "positions"

    @query(name, f"WITH {base} SELECT seq, tail FROM {source} WHERE {where}")
    def run(spark, sf):
        engine = _engine(conditions)
        rows = engine.prepare(_reports(spark, sf)) if located else _reports(spark, sf)
        return rows.where(engine.predicate("rule")).select("seq", "tail")


for _n, (_c, _w) in CASES.items():
    _register(_n, _c, _w, False)
for _n, (_c, _w) in REGION_CASES.items():
    _register(_n, _c, _w, True)


@query("F1_disabled_rule", f"WITH {P} SELECT 'on' AS rule, count(*) AS n FROM positions WHERE alt_baro >= 1200")
def disabled_rule(spark, sf):
    body = lambda on: {"conditions": {"enabled": on, "min_alt": 1200}, "actions": {"track": True}}
    engine = R.Rules({"rules": {"off": body(False), "on": body(True)}}, t.REGION_LAYERS, t.REGION_FILES)
    return engine.firings(engine.prepare(_reports(spark, sf))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


LOCATED = t.REGIONS_SQL.split(",\npaired AS")[0]


@query("F22_region_membership", f"WITH {LOCATED} SELECT seq, in0 AS layer0, in1 AS layer1 FROM located")
def region_membership(spark, sf):
    out = regions.assign_inline(t.positions(spark, sf), t.REGION_LAYERS)
    return out.select("seq", F.col("inside")[0].alias("layer0"), F.col("inside")[1].alias("layer1"))


@query("J3_point_in_region_join", f"WITH {LOCATED} SELECT seq, in0 AS layer0, in1 AS layer1 FROM located")
def region_join(spark, sf):
    out = regions.assign_join(t.positions(spark, sf), regions.region_table(spark, t.REGION_LAYERS, t.REGION_FILES))
    return out.select("seq", F.col("inside")[0].alias("layer0"), F.col("inside")[1].alias("layer1"))


ANY = " OR ".join(t._crossings(r["ring"]) for layer in t.REGION_LAYERS for r in layer)


@query("F23_any_region_filter", f"WITH {P} SELECT seq FROM positions WHERE {ANY} OR {RING} <= 3.0")
def any_region(spark, sf):
    return t.positions(spark, sf).where(regions.in_any_region(t.REGION_LAYERS, [[3.0, 36.6, -121.7]])).select("seq")


@query("F24_box_filter", f"WITH {P} SELECT seq FROM positions WHERE lat BETWEEN 36.55 AND 36.7 AND lon BETWEEN -121.75 AND -121.68")
def box_filter(spark, sf):
    return t.positions(spark, sf).where(F.col("lat").between(36.55, 36.7) & F.col("lon").between(-121.75, -121.68)).select("seq")


@query("F29_resample_prefilter", f"WITH {P} SELECT seq FROM positions WHERE alt_baro BETWEEN 1150 AND 1500")
def resample_prefilter(spark, sf):
    engine = _engine({"min_alt": 1150, "max_alt": 1500, "proximity": [400, 0.3]})
    return sequence.prefilter(t.positions(spark, sf), *engine.altitude_window()).select("seq")


@query("W4_region_transitions", f"WITH {t.REGIONS_SQL} SELECT tail, coalesce(was0, '-') AS was, coalesce(in0, '-') AS now_in, count(*) AS n FROM prepared WHERE in0 IS DISTINCT FROM was0 GROUP BY 1, 2, 3")
def transitions(spark, sf):
    rows = _engine({}).prepare(_reports(spark, sf))
    was, now = F.coalesce(F.col("was_inside")[0], F.lit("-")), F.coalesce(F.col("inside")[0], F.lit("-"))
    return rows.where(~was.eqNullSafe(now)).groupBy("tail", was.alias("was"), now.alias("now_in")).agg(F.count(F.lit(1)).alias("n"))


CARRY = f"""WITH {P}, g AS (SELECT *, now - lag(now) OVER (PARTITION BY tail ORDER BY now, seq) AS gap FROM positions),
  l AS (SELECT *, sum(CASE WHEN gap > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY tail ORDER BY now, seq) AS life FROM g)
  SELECT seq, tail, last_value(emergency IGNORE NULLS) OVER (PARTITION BY tail, life ORDER BY now, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS emergency FROM l"""


@query("D1_carry_forward", CARRY)
def carry_forward(spark, sf):
    out = sequence.carry_forward(sequence.life_segments(t.positions(spark, sf)), ["emergency"])
    return out.select("seq", "tail", "emergency")


SPARSE = {"category": "seq % 7 < 2", "squawk": "seq % 5 = 0", "emergency": "seq % 3 = 0"}
CARRIED = f"""WITH {P}, sparse AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {w} THEN {c} END AS {c}' for c, w in SPARSE.items())}) FROM positions),
  g AS (SELECT *, now - lag(now) OVER (PARTITION BY tail ORDER BY now, seq) AS gap FROM sparse),
  l AS (SELECT *, sum(CASE WHEN gap > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY tail ORDER BY now, seq) AS life FROM g),
  carried AS (SELECT seq, tail, {', '.join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY tail, life ORDER BY now, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}' for c in SPARSE)} FROM l)
  SELECT seq, tail FROM carried WHERE """


def _register_carried(name: str, conditions: dict, where: str):
    @query(name, CARRIED + where)
    def run(spark, sf):
        """Reports that leave periodic keys out: the rule sees the last ones sent."""
        rows = t.positions(spark, sf).withColumns({c: F.when(F.expr(w), F.col(c)) for c, w in SPARSE.items()})
        keys = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in SPARSE]))
        engine = _engine(conditions)
        return engine.firings(engine.prepare(rows.withColumn("attrs", keys))).select("seq", "tail")


for _n, _c, _w in (
    ("F12_carried_attr", {"has_attr": "category"}, "category IS NOT NULL"),
    ("F13_carried_squawk", {"squawk": [7700, "4512"]}, "squawk IN ('7700', '4512')"),
    ("F14_carried_emergency", {"emergency": "any"}, "emergency <> 'none'"),
    ("F15_carried_category", {"category": ["A1", "A7"]}, "category IN ('A1', 'A7')"),
    ("F15_carried_exclude", {"exclude_category": "A3"}, "coalesce(category <> 'A3', true)"),
):
    _register_carried(_n, _c, _w)


@query("F3_long_list", f"WITH {P} SELECT seq, tail FROM positions WHERE CAST(substr(tail, 2) AS INTEGER) % 2 = 0")
def long_list(spark, sf):
    engine = R.Rules({"aircraft_lists": {"even": [f"N{i}" for i in range(0, 100_000, 2)]},
                      "rules": {"rule": {"conditions": {"aircraft_list": "even"}, "actions": {"print": True}}}})
    return engine.firings(engine.prepare(_reports(spark, sf))).select("seq", "tail")


GRID = 32
GRID_LAT, GRID_LON, GRID_STEP = 36.43317, -121.87713, 0.015625


def _grid_layer() -> list[dict]:
    def ring(i: int, j: int):
        la, lo = GRID_LAT + i * GRID_STEP, GRID_LON + j * GRID_STEP
        return [(lo, la), (lo + GRID_STEP, la), (lo + GRID_STEP, la + GRID_STEP), (lo, la + GRID_STEP)]

    return [{"name": f"Cell {i} {j}", "min_alt": 0, "max_alt": 1300 + 200 * (j % 2), "hdg0": 0, "hdg1": 360, "ring": ring(i, j)} for i in range(GRID) for j in range(GRID)]


@query("F8_thousand_regions", f"""WITH {P}, c AS (SELECT seq, alt_baro, CAST(floor((lat - CAST({GRID_LAT} AS DOUBLE)) / CAST({GRID_STEP} AS DOUBLE)) AS INTEGER) AS i,
    CAST(floor((lon - CAST({GRID_LON} AS DOUBLE)) / CAST({GRID_STEP} AS DOUBLE)) AS INTEGER) AS j FROM positions)
  SELECT seq, 'cell ' || i || ' ' || j AS region FROM c WHERE i BETWEEN 0 AND {GRID - 1} AND j BETWEEN 0 AND {GRID - 1} AND alt_baro <= 1300 + 200 * (j % 2) AND (i + j) % 3 = 0""")
def thousand_regions(spark, sf):
    layer = _grid_layer()
    wanted = [f"cell {i} {j}" for i in range(GRID) for j in range(GRID) if (i + j) % 3 == 0]
    engine = R.Rules({"rules": {"rule": {"conditions": {"regions": wanted}, "actions": {"print": True}}}}, [layer], ["grid.kml"])
    return engine.firings(engine.prepare(_reports(spark, sf))).select("seq", F.col("inside")[0].alias("region"))


# --- cooldown, notes, reports -------------------------------------------------------

COOL = f"""WITH RECURSIVE {P}, m AS (SELECT {{key}} AS key, seq, now, row_number() OVER (PARTITION BY {{key}} ORDER BY now, seq) AS i FROM positions WHERE alt_baro >= 1200),
walk AS (SELECT key, seq, now, i, true AS fired, now AS last FROM m WHERE i = 1
  UNION ALL SELECT m.key, m.seq, m.now, m.i, m.now - w.last >= {{s}}, CASE WHEN m.now - w.last >= {{s}} THEN m.now ELSE w.last END FROM walk w JOIN m ON m.key = w.key AND m.i = w.i + 1)
SELECT {{out}} FROM walk WHERE fired"""


def _cool(conditions):
    def run(spark, sf):
        engine = _engine({"min_alt": 1200, **conditions})
        return engine.firings(engine.prepare(_reports(spark, sf)), width=900.0)

    return run


@query("T5_cooldown_per_aircraft", COOL.format(key="tail", s=150, out="key AS tail, seq"))
def cooldown(spark, sf):
    return _cool({"cooldown": 2.5})(spark, sf).select("tail", "seq")


@query("T5_cooldown_per_rule", COOL.format(key="1", s=45, out="seq"))
def rule_cooldown(spark, sf):
    return _cool({"rule_cooldown": 0.75})(spark, sf).select("seq")


# Last firing of each of the 40 aircraft, as a list by aircraft number.
NEVER = "list_transform(range(40), lambda x: CAST(-1e18 AS DOUBLE))"
BOTH = f"""WITH RECURSIVE {P}, m AS (SELECT tail, a, seq, now, row_number() OVER (ORDER BY now, seq) AS i FROM positions WHERE alt_baro >= 1200),
walk(i, fired, fires, quiet) AS (SELECT CAST(0 AS BIGINT), false, {NEVER}, CAST(-1e18 AS DOUBLE)
  UNION ALL SELECT i, f, CASE WHEN f THEN list_concat(fires[1:a], [now], fires[a + 2:]) ELSE fires END, CASE WHEN f THEN now ELSE quiet END
  FROM (SELECT m.i, m.a, m.now, w.fires, w.quiet, m.now - w.quiet >= 45 AND m.now - w.fires[m.a + 1] >= 150 AS f FROM walk w JOIN m ON m.i = w.i + 1))
SELECT tail, seq FROM walk JOIN m USING (i) WHERE fired"""


@query("T5_both_pauses", BOTH)
def both_pauses(spark, sf):
    return _cool({"cooldown": 2.5, "rule_cooldown": 0.75})(spark, sf).select("tail", "seq")


DOC = {
    "aircraft_lists": LISTS,
    "rules": {
        "takeoff": {"conditions": {"transition_regions": ["Ground", "Pattern"]}, "actions": {"note": "flew", "track": True, "print": True}},
        "high": {"conditions": {"min_alt": 1600}, "actions": {"note": "high", "track": True, "print_csv": True, "emit_jsonl": "high.gz"}},
        "entry": {"conditions": {"joined_region": "Vicinity"}, "actions": {"track": True, "webhook": ["slack", "tower"], "emit_jsonl": "entry.gz", "expire_callback": "gone"}},
        "fleet": {"conditions": {"aircraft_list": "fleet", "regions": ["Ground", "Pattern"]}, "actions": {"track": True, "webhook": ["page", "desk"], "callback": "seen"}},
    },
}
FIRED = t.REGIONS_SQL + """, fired AS (
  SELECT p.*, rule, rule_no FROM prepared p, LATERAL (SELECT * FROM (VALUES
    ('takeoff', 0, coalesce(was0 = 'ground', false) AND coalesce(in0 = 'pattern', false)), ('high', 1, alt_baro >= 1600),
    ('entry', 2, coalesce(in0 = 'vicinity', false) AND NOT coalesce(was0 = 'vicinity', false)),
    ('fleet', 3, tail IN ('N101', 'N105', 'N117', 'N133') AND (coalesce(in0 IN ('ground', 'pattern'), false) OR coalesce(in1 IN ('ground', 'pattern'), false)))) v(rule, rule_no, hit) WHERE hit) x),
noted AS (SELECT *, last_value(CASE rule WHEN 'takeoff' THEN 'flew' WHEN 'high' THEN 'high' END IGNORE NULLS) OVER (PARTITION BY tail, life_no ORDER BY now, seq, rule_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS note FROM fired)"""


def _doc():
    return R.Rules(DOC, t.REGION_LAYERS, t.REGION_FILES)


def _fired(spark, sf):
    d = _doc()
    return d, d.firings(d.prepare(_reports(spark, sf)))


@query("D9_rule_firings", f"WITH {FIRED} SELECT rule, tail, seq FROM fired")
def firings(spark, sf):
    return _fired(spark, sf)[1].select("rule", "tail", "seq")


@query("W23_sticky_note", f"WITH {FIRED} SELECT rule, tail, seq, note FROM noted")
def sticky_note(spark, sf):
    d, f = _fired(spark, sf)
    return d.with_notes(f).select("rule", "tail", "seq", "note")


@query("K5_track_report", f"WITH {FIRED} SELECT rule, NULL AS note, count(*) AS n FROM noted GROUP BY 1 UNION ALL SELECT rule, note, count(*) FROM noted WHERE note IS NOT NULL GROUP BY 1, 2")
def track_report(spark, sf):
    d, f = _fired(spark, sf)
    return d.report(d.with_notes(f))


TEXT = "tail || ' ' || strftime(make_timestamp(CAST(now AS BIGINT) * 1000000), '%m/%d/%y %H:%M:%S') || ' ' || printf('%.4f, %.4f', lat, lon) || ' ' || alt_baro || 'ft'"
NOW_IN = "'[' || coalesce(in0, '-') || ', ' || coalesce(in1, '-') || ']'"


@query("K3_print_lines", f"WITH {FIRED} SELECT rule, tail, now, rule || ': ' || strftime(make_timestamp(CAST(now AS BIGINT) * 1000000), '%m/%d/%y %H:%M:%S') || ' ' || {TEXT} || ' [' || coalesce(was0, '-') || ', ' || coalesce(was1, '-') || ']->' || {NOW_IN} || ' ' || coalesce(note, '') AS line FROM noted")
def print_lines(spark, sf):
    d, f = _fired(spark, sf)
    return R.printed(d.with_notes(f))


@query("K4_webhook_alerts", f"WITH {FIRED} SELECT rule, tail, now, 'page' AS channel, 'desk' AS recipient, 'Rule fleet: ' || {TEXT} || ' ' || {NOW_IN} AS message FROM fired WHERE rule = 'fleet'")
def webhook_alerts(spark, sf):
    d, f = _fired(spark, sf)
    return R.alerts(d, f).where("channel = 'page'")


@query("K2_csv_lines", f"WITH {FIRED} SELECT rule, tail, now, strftime(make_timestamp(CAST(now AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS at, alt_baro, 'high' AS kind FROM fired WHERE rule = 'high'")
def csv_lines(spark, sf):
    from ..sources.lines import event_lines

    d, f = _fired(spark, sf)
    lines = R.csv_lines(d, f)
    parsed = event_lines(lines.select("rule", "tail", "now", "line"))
    return parsed.select("rule", "tail", "now", F.col("fields")[1].alias("at"), F.col("altitude").cast("bigint").alias("alt_baro"), F.col("fields")[12].alias("kind"))


@query("K1_emit_matching", f"WITH {FIRED} SELECT rule, seq, hex FROM fired WHERE rule IN ('high', 'entry')")
def emit_matching(spark, sf):
    from ..session import scratch_path
    from ..sinks.rule_outputs import emit_jsonl

    d, f = _fired(spark, sf)
    path = scratch_path(spark, "emit")
    emit_jsonl(d, f.withColumn("raw", F.to_json(F.struct("seq", "hex", "now", "lat", "lon", "alt_baro"))), path)
    back = spark.read.text(path)
    rec = F.from_json("value", "seq bigint, hex string")
    return back.select("rule", rec.alias("r")).select("rule", "r.seq", "r.hex")


OPS = f"""{FIRED}, ops AS (SELECT tail, now, 'Takeoff' AS operation, false AS is_local FROM noted WHERE rule = 'takeoff'
  UNION ALL SELECT tail, now, 'Landing', note IS NOT NULL FROM noted WHERE rule = 'entry'),
known AS (SELECT 'N' || (100 + c_custkey) AS tail, 'id-' || c_custkey AS aircraft_id FROM customer WHERE c_custkey % 3 <> 0)"""


def _ops_tables(spark, sf):
    """Operations in three batches, the second delivered twice, through the aircraft table."""
    from ..sinks.commit_log import OpsSink, scratch_keyed
    from ..sinks.rule_outputs import operations as op

    d, f = _fired(spark, sf)
    rows = stage(op(d.with_notes(f), takeoffs=["takeoff"], landings=["entry"]), "all-operations")
    aircraft, ops = scratch_keyed(spark, "aircraft", ["tail"], 8), scratch_keyed(spark, "ops", ["tail", "now", "operation"], 16)
    key = F.col("c_custkey")
    aircraft.merge(t.table(spark, sf, "customer").where(key % 3 != 0).select(F.concat(F.lit("N"), (100 + key).cast("string")).alias("tail"), F.concat(F.lit("id-"), key.cast("string")).alias("aircraft_id")))
    sink = OpsSink(ops, aircraft)
    for epoch in (0, 1, 1, 2):
        sink.add(rows.where(F.pmod(F.floor("now"), F.lit(3)) == epoch), "ops", epoch)
    return ops, aircraft


@query("K6_ops_table", f"WITH {OPS} SELECT DISTINCT coalesce(aircraft_id, 'new-' || tail) AS aircraft_id, tail, now, operation, is_local FROM ops LEFT JOIN known USING (tail)")
def ops_table(spark, sf):
    return _ops_tables(spark, sf)[0].read().select("aircraft_id", "tail", "now", "operation", "is_local")


@query("K6_aircraft_table", f"WITH {OPS} SELECT tail, aircraft_id FROM known UNION ALL SELECT DISTINCT tail, 'new-' || tail FROM ops WHERE tail NOT IN (SELECT tail FROM known)")
def aircraft_table(spark, sf):
    return _ops_tables(spark, sf)[1].read().select("tail", "aircraft_id")


@query("K6_operations", f"""WITH {FIRED} SELECT tail, now, 'Takeoff' AS operation, false AS is_local FROM noted WHERE rule = 'takeoff'
  UNION ALL SELECT tail, now, 'Landing', note IS NOT NULL FROM noted WHERE rule = 'entry'""")
def operations(spark, sf):
    from ..sinks.rule_outputs import operations as op

    d, f = _fired(spark, sf)
    return op(d.with_notes(f), takeoffs=["takeoff"], landings=["entry"]).select("tail", "now", "operation", "is_local")


@query("J16_slot_board", f"WITH {LOCATED}, l AS (SELECT tail, max(now) AS now, arg_max(coalesce(in0, '-'), now) AS region, arg_max(alt_baro, now) AS alt_baro, arg_max(gs, now) AS gs FROM located GROUP BY 1) SELECT * FROM l WHERE region <> '-'")
def slot_board(spark, sf):
    from ..operators.tables_ops import slot_board as op

    return op(_engine({}).prepare(_reports(spark, sf)), 1)


HELD = f"""WITH {P}, nexted AS (SELECT *, lead(now) OVER (PARTITION BY tail ORDER BY now, seq) AS nx FROM positions),
held AS (SELECT unnest(range(CAST(now AS BIGINT), CAST(least(now + 5, coalesce(nx - 1, now + 5)) AS BIGINT) + 1)) AS sec, * FROM nexted),
near AS (SELECT * FROM (SELECT a.sec, a.tail AS tail1, b.tail AS tail2, {t.haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM held a JOIN held b ON a.sec = b.sec AND a.tail <> b.tail AND abs(a.alt_baro - b.alt_baro) < 600) WHERE d < 1.5)"""


@query("F5_one_in_list", HELD + " SELECT sec, tail1, tail2 FROM near WHERE (tail1 IN ('N101', 'N105', 'N117', 'N133')) <> (tail2 IN ('N101', 'N105', 'N117', 'N133'))")
def one_in_list(spark, sf):
    engine = _engine({"proximity": [600, 1.5], "one_in_aircraft_list": "fleet"})
    steps = sequence.flight_steps(_reports(spark, sf))
    return engine.proximity_firings(steps, "rule", interpolate=False).select("sec", "tail1", "tail2")


@query("T4_checkpoints", f"WITH {P} SELECT CAST(now AS BIGINT) // 5 * 5 AS window_start, count(*) AS reports, count(DISTINCT tail) AS aircraft FROM positions GROUP BY 1")
def checkpoints(spark, sf):
    p = t.positions(spark, sf).withColumn("at", F.timestamp_seconds("now"))
    out = p.groupBy(F.window("at", "5 seconds").alias("w")).agg(F.count(F.lit(1)).alias("reports"), F.countDistinct("tail").alias("aircraft"))
    return out.select(F.unix_timestamp("w.start").alias("window_start"), "reports", "aircraft")


CHECKS = """secs AS (SELECT sec, row_number() OVER (ORDER BY sec) AS k FROM (SELECT DISTINCT CAST(floor(now) AS BIGINT) AS sec FROM positions)),
ticks AS (SELECT sec, k, sec AS last FROM secs WHERE k = 1
  UNION ALL SELECT s.sec, s.k, CASE WHEN s.sec - c.last >= 5 THEN s.sec ELSE c.last END FROM ticks c JOIN secs s ON s.k = c.k + 1),
checks AS (SELECT sec FROM ticks WHERE last = sec AND k > 1)"""


@query("T4_data_checkpoints", f"WITH RECURSIVE {P}, {CHECKS} SELECT sec FROM checks")
def data_checkpoints(spark, sf):
    return folds.checkpoints(t.positions(spark, sf))


PAIR_RULE = {"conditions": {"proximity": [600, 1.5], "regions": ["Ground", "Pattern"], "min_gs": 85, "squawk": [1200, 7600], "cooldown": 1},
             "actions": {"print_csv": "close", "track": True, "callback": "pair"}}
PAIRED = f"""WITH RECURSIVE {t.REGIONS_SQL}, {CHECKS}, nx AS (SELECT *, lead(now) OVER (PARTITION BY tail ORDER BY now, seq) AS nx FROM prepared),
good AS (SELECT * FROM nx WHERE (coalesce(in0 IN ('ground', 'pattern'), false) OR coalesce(in1 IN ('ground', 'pattern'), false)) AND gs >= 85 AND squawk IN ('1200', '7600')),
held AS (SELECT unnest(range(CAST(now AS BIGINT), CAST(least(now + 5, coalesce(nx - 1, now + 5)) AS BIGINT) + 1)) AS sec, * FROM good),
met AS (SELECT sec, x.tail, y.tail AS tail2, x.a, y.a AS a2, x.now, y.now AS now2, x.seq, y.seq AS seq2, x.alt_baro, row_number() OVER (ORDER BY sec, x.tail, y.tail) AS i
  FROM held x JOIN held y USING (sec) JOIN checks USING (sec)
  WHERE x.tail <> y.tail AND abs(x.alt_baro - y.alt_baro) < 600 AND {t.haversine_sql('x.lat', 'x.lon', 'y.lat', 'y.lon')} < 1.5),
walk(i, fired, fires) AS (SELECT CAST(0 AS BIGINT), false, {NEVER}
  UNION ALL SELECT i, f, CASE WHEN f THEN list_concat(fires[1:a], [now], fires[a + 2:]) ELSE fires END
  FROM (SELECT m.i, m.a, m.now, w.fires, m.now - w.fires[m.a + 1] >= 60 AND m.now2 - w.fires[m.a2 + 1] >= 60 AS f FROM walk w JOIN met m ON m.i = w.i + 1)),
pair_fired AS (SELECT met.* FROM walk JOIN met USING (i) WHERE fired)"""


def _paired(spark, sf):
    d = R.Rules({"rules": {"near": PAIR_RULE}}, t.REGION_LAYERS, t.REGION_FILES)
    reports = _reports(spark, sf)
    return d, d.all_firings(d.prepare(reports), folds.checkpoints(reports))


@query("J1_pair_rule", PAIRED + " SELECT 'near' AS rule, sec AS at, tail, tail2, seq, seq2 FROM pair_fired")
def pair_rule(spark, sf):
    return _paired(spark, sf)[1].select("rule", "at", "tail", "tail2", "seq", F.col("other.seq").alias("seq2"))


@query("K2_pair_csv_lines", PAIRED + " SELECT tail, tail2, now, alt_baro, 'close' AS kind FROM pair_fired")
def pair_csv_lines(spark, sf):
    from ..sources.lines import event_lines

    d, f = _paired(spark, sf)
    parsed = event_lines(R.csv_lines(d, f))
    return parsed.select("tail", F.col("fields")[7].alias("tail2"), "now", F.col("altitude").cast("bigint").alias("alt_baro"), F.col("fields")[12].alias("kind"))


# --- handlers ----------------------------------------------------------------

class _Kept:
    """What handlers were given, written below one folder each."""

    def __init__(self, spark):
        from ..session import scratch_path

        self.spark, self.path = spark, scratch_path(spark, "handled")

    def as_(self, name: str, *columns):
        return lambda df: df.select(*columns).write.mode("append").parquet(f"{self.path}/handler={name}")

    def read(self):
        return self.spark.read.option("basePath", self.path).parquet(self.path)


@query("D1u_callbacks", f"""WITH {FIRED} SELECT 'by_rule' AS handler, rule, tail, seq FROM fired WHERE rule = 'takeoff'
  UNION ALL SELECT 'by_callback', rule, tail, seq FROM fired WHERE rule = 'fleet' UNION ALL SELECT 'second', rule, tail, seq FROM fired WHERE rule = 'takeoff'""")
def callbacks(spark, sf):
    """Handlers bound to a rule, to a callback's name, and two to one rule."""
    d, f = _fired(spark, sf)
    kept = _Kept(spark)
    row = ("rule", "tail", "seq")
    R.Engine(d).on("takeoff", kept.as_("by_rule", *row)).on("seen", kept.as_("by_callback", *row)).on("takeoff", kept.as_("second", *row)).dispatch(stage(f, "fired"))
    return kept.read().select("handler", *row)


@query("D2u_expire_callback", f"""WITH {t.REGIONS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY tail, life_no ORDER BY now DESC, seq DESC) AS back FROM prepared)
  SELECT tail, seq, now FROM l WHERE back = 1 AND alt_baro >= 1200 AND now + 180 < (SELECT max(now) FROM positions)""")
def expire_callback(spark, sf):
    """The last report of each life that has ended, where it meets the rule."""
    rules = R.Rules({"rules": {"left_high": {"conditions": {"min_alt": 1200}, "actions": {"expire_callback": "gone"}}}}, t.REGION_LAYERS, t.REGION_FILES)
    prepared = rules.prepare(_reports(spark, sf))
    last = prepared.groupBy("tail", "life_no").agg(F.max_by(F.struct(*[c for c in prepared.columns if c not in ("tail", "life_no")]), F.struct("now", "seq")).alias("r"))
    end = t.positions(spark, sf).agg(F.max("now").alias("end"))
    kept = _Kept(spark)
    R.Engine(rules).on_expire("gone", kept.as_("gone", "tail", "seq", "now")).dispatch_expired(
        last.select("tail", "life_no", "r.*").where(F.col("now") + rules.expire_s < end.scalar()))
    return kept.read().select("tail", "seq", "now")


@query("D3u_webhook_handlers", f"""WITH {FIRED} SELECT 'page' AS channel, 'desk' AS recipient, rule, tail, now, 'Rule fleet: ' || {TEXT} || ' ' || {NOW_IN} AS first_line FROM fired WHERE rule = 'fleet'
  UNION ALL SELECT 'slack', 'tower', rule, tail, now, 'Rule entry matched for: ' || {TEXT} || ' [' || coalesce(was0, '-') || ', ' || coalesce(was1, '-') || ']->' || {NOW_IN} FROM fired WHERE rule = 'entry'""")
def webhook_handlers(spark, sf):
    """Every channel's alerts, as its handler gets them; the links of the lines below are X20's."""
    d, f = _fired(spark, sf)
    kept = _Kept(spark)
    row = ("channel", "recipient", "rule", "tail", "now", F.substring_index("message", "\n", 1).alias("first_line"))
    R.Engine(d).channel("slack", kept.as_("slack", *row)).channel("page", kept.as_("page", *row)).dispatch(stage(f, "fired"))
    return kept.read().drop("handler")


@query("D4u_second_handler", f"WITH {t.RESAMPLED_SQL} SELECT sec, count(*) AS points, count(DISTINCT tail) AS aircraft FROM resampled GROUP BY 1")
def second_handler(spark, sf):
    kept = _Kept(spark)
    points = sequence.resample(sequence.flight_steps(sequence.prefilter(t.positions(spark, sf))))
    R.Engine(_doc()).on_seconds(kept.as_("seconds", "sec", "points", "aircraft")).dispatch_resampled(points)
    return kept.read().drop("handler")


@query("D5u_point_handler", f"WITH {t.RESAMPLED_SQL} SELECT sec, tail, flight_id, resampled, round(lat, 6) AS lat, round(lon, 6) AS lon, alt_baro FROM resampled")
def point_handler(spark, sf):
    kept = _Kept(spark)
    points = sequence.resample(sequence.flight_steps(sequence.prefilter(t.positions(spark, sf))))
    R.Engine(_doc()).on_points(kept.as_(
        "points", "sec", "tail", "flight_id", "resampled", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt_baro")).dispatch_resampled(points)
    return kept.read().drop("handler")
