"""Rule documents: validation, compilation to Columns, firing, notes, reports.

A document is a mapping ``{config: {kmls}, aircraft_lists: {name: [tail]},
rules: {name: {conditions, actions}}}``.  All rules are evaluated in one pass: a
row carries an array of the rules it matches, which is then exploded.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, labels
from ..functions.times import as_timestamp, hhmm_utc, in_time_ranges
from ..operators import folds, proximity, regions, sequence
from ..operators.skew import dimension_join
from ..operators.timeline import SLICE_S, running, timeline
from ..session import stage, task_count

CONDITIONS = {
    "proximity", "aircraft_list", "exclude_aircraft_list", "one_in_aircraft_list", "exclude_aircraft_substrs", "min_alt", "max_alt",
    "transition_regions", "joined_region", "departed_region", "changed_regions", "regions", "latlongring", "cooldown", "rule_cooldown",
    "has_attr", "squawk", "emergency", "category", "exclude_category", "min_gs", "max_gs", "min_vertical_rate", "max_vertical_rate",
    "callsign_prefix", "on_ground", "military", "min_time", "max_time", "time_ranges", "enabled",
}
ACTIONS = {"webhook", "print", "callback", "note", "track", "expire_callback", "print_csv", "emit_jsonl"}
# Cheapest and most selective first; Spark evaluates AND left to right.
ORDER = [
    "latlongring", "min_alt", "max_alt", "on_ground", "min_gs", "max_gs", "min_vertical_rate", "max_vertical_rate", "squawk",
    "emergency", "category", "exclude_category", "military", "has_attr", "aircraft_list", "exclude_aircraft_list",
    "exclude_aircraft_substrs", "callsign_prefix", "min_time", "max_time", "time_ranges", "regions", "transition_regions",
    "joined_region", "departed_region", "changed_regions",
]
# Keys sent only now and then; the last known value holds within a life.
PERIODIC = ("category", "squawk", "emergency")
# An aircraft list up to this length becomes an IN expression, a longer one a join.
INLINE_LIST = 1_000
# Report columns that conditions on the members of a pair, notes and outputs may read.
MEMBER = ("tail", "flight_id", "seq", "hex", "life_no", "inside", "was_inside", "attrs", "lists", *PERIODIC, "db_flags", "on_ground",
          "baro_rate", "gs", "track")
# A check for close pairs runs this often and looks at reports up to this old.
CHECK_S, FRESH_S = 5.0, 5
# Points that one task counts the aircraft of, about.
SECOND_ROWS = 2_000_000
EVENT_MARKER = "CSV OUTPUT FOR POSTPROCESSING: "


def _many(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def validate(doc: dict) -> dict:
    for name, body in (doc.get("rules") or {}).items():
        if "conditions" not in body or "actions" not in body:
            raise ValueError(f"rule {name!r} needs conditions and actions")
        for kind, known in (("conditions", CONDITIONS), ("actions", ACTIONS)):
            unknown = set(body[kind] or {}) - known
            if unknown:
                raise ValueError(f"rule {name!r} has unknown {kind}: {sorted(unknown)}")
    return doc


class Rules:
    """A validated document with the region layers it refers to.

    ``layers`` are lists of regions or a table with ``schema.REGION``; an aircraft list
    is a list of tails or a DataFrame with a column ``tail``.  Neither has a limit:
    what is too long for an expression is joined by ``prepare``, with the same result.
    """

    def __init__(self, doc: dict, layers: Sequence[Sequence[dict]] | DataFrame = (), files: Sequence[str] = (), expire_s: float = 180):
        self.doc = validate(doc)
        self.layers, self.files, self.expire_s = layers, list(files), expire_s
        self.lists = doc.get("aircraft_lists") or {}
        self.joined = {n for n, v in self.lists.items() if isinstance(v, DataFrame) or len(v) > INLINE_LIST}
        self.rules = {n: b for n, b in (doc.get("rules") or {}).items() if (b["conditions"] or {}).get("enabled", True)}

    # -- conditions --------------------------------------------------------
    def _listed(self, name: str, sfx: str = "") -> Column:
        if name in self.joined:
            return F.coalesce(F.array_contains("lists" + sfx, name), F.lit(False))
        tails = self.lists[name]
        return F.col("tail" + sfx).isin(list(tails)) if tails else F.lit(False)

    def with_lists(self, df: DataFrame) -> DataFrame:
        """``lists``: the long aircraft lists a row's tail is on."""
        if not self.joined:
            return df
        members = None
        for name in sorted(self.joined):
            tails = self.lists[name]
            if not isinstance(tails, DataFrame):
                tails = df.sparkSession.createDataFrame([(x,) for x in tails], "tail string")
            part = tails.select(F.col("tail").cast("string").alias("tail"), F.lit(name).alias("_list"))
            members = part if members is None else members.unionByName(part)
        return dimension_join(df, members.groupBy("tail").agg(F.collect_set("_list").alias("lists")), ["tail"], "left")

    def condition(self, key: str, value, sfx: str = "") -> Column:
        """One condition as a predicate over report columns (suffixed for pairs)."""
        def c(name: str) -> Column:
            return F.col(name + sfx)

        none = F.lit(False)
        if key == "latlongring":
            return geo.within_ring("lat" + sfx, "lon" + sfx, float(value[0]), float(value[1]), float(value[2]))
        if key == "min_alt":
            return c("alt_baro") >= int(value)
        if key == "max_alt":
            return c("alt_baro") <= int(value)
        if key == "aircraft_list":
            return self._listed(value, sfx) if value in self.lists else none
        if key == "exclude_aircraft_list":
            return ~self._listed(value, sfx) if value in self.lists else none
        if key == "exclude_aircraft_substrs":
            out = F.lit(True)
            for part in value:
                out = out & ~c("tail").contains(part)
            return out
        if key == "regions":
            return regions.matches_any(c("inside"), value, self.files)
        if key in ("transition_regions", "joined_region", "departed_region"):
            first, second = value if key == "transition_regions" else (value, value)
            was = regions.matches_any(c("was_inside"), [first], self.files)
            now = regions.matches_any(c("inside"), [second], self.files)
            return {"transition_regions": was & now, "joined_region": now & ~was, "departed_region": was & ~now}[key]
        if key == "changed_regions":
            moved = ~c("was_inside").eqNullSafe(c("inside"))
            if str(value).lower() == "strict":
                some = lambda a: F.exists(a, lambda s: s.isNotNull())
                return some(c("was_inside")) & some(c("inside")) & moved
            return moved
        if key == "has_attr":
            return F.coalesce(F.array_contains(c("attrs"), value), none)
        if key == "squawk":
            return F.coalesce(c("squawk").isin([str(v) for v in _many(value)]), none)
        if key == "emergency":
            known = c("emergency").isNotNull()
            return known & ((c("emergency") != "none") if value == "any" else c("emergency").isin(_many(value)))
        if key == "category":
            return F.coalesce(c("category").isin(_many(value)), none)
        if key == "exclude_category":
            return F.coalesce(~c("category").isin(_many(value)), F.lit(True))
        if key in ("min_gs", "max_gs"):
            return F.coalesce(c("gs") >= float(value) if key == "min_gs" else c("gs") <= float(value), none)
        if key in ("min_vertical_rate", "max_vertical_rate"):
            rate = c("baro_rate")
            return F.coalesce(rate >= int(value) if key == "min_vertical_rate" else rate <= int(value), none)
        if key == "callsign_prefix":
            # tested on the tail, not on the callsign
            out = none
            for prefix in _many(value):
                out = out | c("tail").startswith(prefix)
            return F.coalesce(out, none)
        if key == "on_ground":
            return c("on_ground") == F.lit(bool(value))
        if key == "military":
            return F.coalesce(c("db_flags") == 1, none) == F.lit(bool(value))
        if key == "min_time":
            return hhmm_utc(c("now")) >= int(value)
        if key == "max_time":
            return hhmm_utc(c("now")) <= int(value)
        if key == "time_ranges":
            return in_time_ranges(c("now"), value)
        raise ValueError(f"unknown condition {key!r}")

    def predicate(self, name: str, sfx: str = "") -> Column:
        conditions = self.rules[name]["conditions"] or {}
        out = F.lit(True)
        for key in ORDER:
            if key in conditions:
                out = out & self.condition(key, conditions[key], sfx)
        return out

    def pair_condition(self, name: str) -> Column:
        """Exactly one member of the pair is in the list."""
        value = (self.rules[name]["conditions"] or {}).get("one_in_aircraft_list")
        if value is None:
            return F.lit(True)
        if value not in self.lists:
            return F.lit(False)
        return self._listed(value, "1") != self._listed(value, "2")

    # -- evaluation --------------------------------------------------------
    def _located(self, reports: DataFrame) -> DataFrame:
        if isinstance(self.layers, DataFrame):
            return regions.assign_join(reports, self.layers, layers=len(self.files) or None)
        if not self.layers:
            return reports.withColumn("inside", F.array(F.lit(None).cast("string")))
        if sum(len(layer) for layer in self.layers) <= regions.INLINE_REGIONS:
            return regions.assign_inline(reports, self.layers)
        table = regions.region_table(reports.sparkSession, self.layers, self.files)
        return regions.assign_join(reports, table, layers=len(self.layers))

    def _asks_periodic(self) -> bool:
        asked = {k if k != "has_attr" else v for b in self.rules.values() for k, v in (b["conditions"] or {}).items()}
        return bool(asked & {*PERIODIC, "exclude_category"})

    def prepare(self, reports: DataFrame, width: float = SLICE_S) -> DataFrame:
        """Add ``inside``, ``was_inside`` and ``life_no`` to reports (tail, now, seq, ...).

        Keys sent only now and then keep their last value within a life, where a rule
        asks for one of them.
        """
        out = self.with_lists(self._located(reports))
        out = timeline(out, ["tail"], "now", ["seq"], lag=["inside"], gap=self.expire_s, width=width)
        same = F.col("now") - F.col("prev1.now") <= self.expire_s
        empty = F.transform("inside", lambda s: F.lit(None).cast("string"))
        out = (
            out.withColumn("was_inside", F.when(same, F.col("prev1.inside")).otherwise(empty))
            .withColumnRenamed("session_no", "life_no").drop("prev1")
        )
        carried = [c for c in PERIODIC if c in out.columns]
        return sequence.carry_forward(out, carried, width=width) if carried and self._asks_periodic() else out

    def _plain(self) -> list[str]:
        return [n for n, b in self.rules.items() if "proximity" not in (b["conditions"] or {})]

    def _pauses(self, name: str) -> tuple[float, float]:
        """Seconds per aircraft and per rule; minus infinity where there is no pause."""
        cond = self.rules[name]["conditions"] or {}
        return tuple(-math.inf if cond.get(k) is None else float(int(cond[k] * 60)) for k in ("cooldown", "rule_cooldown"))

    def _cooldown(self, name: str) -> tuple[str, float] | None:
        per_tail, per_rule = self._pauses(name)
        if max(per_tail, per_rule) < 0:
            return None
        # a rule-wide pause at least as long as the per-aircraft one implies it
        if per_rule >= per_tail:
            return "rule", per_rule
        return ("tail", per_tail) if per_rule < 0 else ("both", per_tail)

    def _paced(self, fired: DataFrame, names: Sequence[str], time: str, order: Sequence[str], actors, width: float) -> DataFrame:
        """Firings of ``names`` with both pauses observed."""
        waits = {n: self._pauses(n) for n in names}
        secs = lambda i: F.coalesce(*[F.when(F.col("rule") == n, F.lit(w[i])) for n, w in waits.items()])
        part = fired.where(F.col("rule").isin(list(waits))).withColumn("_pause", secs(0)).withColumn("_rule_pause", secs(1))
        return folds.paced(part, ["rule"], time, order, actors, "_pause", "_rule_pause", width).drop("_pause", "_rule_pause")

    def firings(self, prepared: DataFrame, width: float = SLICE_S) -> DataFrame:
        """One row per (report, rule) that fires, after cooldowns."""
        names = self._plain()
        if not names:
            return prepared.withColumn("rule", F.lit("")).withColumn("rule_no", F.lit(0)).where(F.lit(False))
        position = {n: i for i, n in enumerate(self.rules)}
        hit = F.array_compact(F.array(*[
            F.when(self.predicate(n), F.struct(F.lit(n).alias("rule"), F.lit(position[n]).alias("rule_no"))) for n in names]))
        fired = prepared.withColumn("_hit", F.explode(hit)).select("*", "_hit.*").drop("_hit")
        waits = {n: self._cooldown(n) for n in names}
        out = fired.where(~F.col("rule").isin([n for n, w in waits.items() if w])) if any(waits.values()) else fired
        for scope, keys in (("tail", ["rule", "tail"]), ("rule", ["rule"])):
            scoped = {n: w[1] for n, w in waits.items() if w and w[0] == scope}
            if not scoped:
                continue
            secs = F.coalesce(*[F.when(F.col("rule") == n, F.lit(float(s))) for n, s in scoped.items()])
            part = fired.where(F.col("rule").isin(list(scoped))).withColumn("cooldown_s", secs)
            part = folds.cooldown(part, keys, "now", ["seq"], "cooldown_s", width).drop("cooldown_s")
            out = out.unionByName(part)
        both = [n for n, w in waits.items() if w and w[0] == "both"]
        return out.unionByName(self._paced(fired, both, "now", ["seq"], [("tail", "now")], width)) if both else out

    def pair_firings(self, prepared: DataFrame, checks: DataFrame | None = None, skip_nowhere: bool = True, width: float = SLICE_S) -> DataFrame:
        """Firings of the proximity rules: the columns of a report (the aircraft that
        looks), ``tail2`` and ``other`` (the one it sees), ``at`` (second of the check).

        A check looks at the last report of each aircraft, up to five seconds old, and
        runs at the seconds of ``checks`` (default: ``folds.checkpoints`` of ``prepared``;
        those of the raw reports are the same and cheaper).  Both members
        must meet the conditions; the looking one must be in some region unless
        ``skip_nowhere`` is off.  Each pair fires in both directions unless a pause
        forbids it: both members must be out of the pause, and it is the looking one
        whose pause starts.  Within a check aircraft look in the order of their tails.
        """
        position = {n: i for i, n in enumerate(self.rules)}
        names = [n for n in self.rules if n not in self._plain()]
        steps = sequence.flight_steps(prepared, carry=[])
        if len(names) > 1:
            steps = stage(steps, "steps")
        fields = [c for c in (*MEMBER, "now", "lat", "lon", "alt_baro") if c in steps.columns or c in ("now", "lat", "lon", "alt_baro")]
        checks = folds.checkpoints(prepared, "now", CHECK_S) if checks is None else checks
        out = None
        for name in names:
            vertical, lateral = self.rules[name]["conditions"]["proximity"]
            # positions are those of reports, so conditions hold or fail before the join
            pieces = proximity.track_pieces(steps.where(self.predicate(name)), hold=FRESH_S, interpolate=False, keep=MEMBER)
            # both sides of the join read the pieces, both directions the pairs
            pairs = stage(proximity.near_pairs(stage(pieces, "pieces"), float(lateral), float(vertical)), "pairs")
            rows = proximity.directed(pairs).where(self.pair_condition(name))
            if skip_nowhere:
                rows = rows.where(F.exists("inside1", lambda s: s.isNotNull()))
            rows = rows.select(
                F.lit(name).alias("rule"), F.lit(position[name]).alias("rule_no"), F.col("sec").alias("at"), "tail2", "lateral_nm", "alt_sep_ft",
                *[F.col(f"{c}1").alias(c) for c in fields], F.struct(*[F.col(f"{c}2").alias(c) for c in fields]).alias("other"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return prepared.select("*", F.lit("").alias("rule"), F.lit(0).alias("rule_no"), F.lit(0).cast("bigint").alias("at"), F.lit("").alias("tail2"),
                                   F.lit(0.0).alias("lateral_nm"), F.lit(0.0).alias("alt_sep_ft")).where(F.lit(False))
        out = out.join(checks.select(F.col("sec").alias("at")).distinct(), "at", "left_semi")
        paused = [n for n in names if self._cooldown(n)]
        if not paused:
            return out
        out = out.withColumn("_now2", F.col("other.now"))
        kept = self._paced(out, paused, "at", ["tail", "tail2"], [("tail", "now"), ("tail2", "_now2")], width)
        return out.where(~F.col("rule").isin(paused)).unionByName(kept).drop("_now2")

    def all_firings(self, prepared: DataFrame, checks: DataFrame | None = None, skip_nowhere: bool = True, width: float = SLICE_S) -> DataFrame:
        """Firings of single and of pair rules together; ``tail2`` is null for single ones."""
        plain = self.firings(prepared, width).withColumn("at", F.floor("now").cast("bigint")).withColumn("tail2", F.lit(None).cast("string"))
        if len(self._plain()) == len(self.rules):
            return plain
        return plain.unionByName(self.pair_firings(prepared, checks, skip_nowhere, width), allowMissingColumns=True)

    def with_notes(self, fired: DataFrame, width: float = SLICE_S) -> DataFrame:
        """``note``: the aircraft's note before this firing (last one set in its life)."""
        notes = {n: b["actions"]["note"] for n, b in self.rules.items() if "note" in (b["actions"] or {})}
        if not notes:
            return fired.withColumn("note", F.lit(None).cast("string"))
        sets = F.coalesce(*[F.when(F.col("rule") == n, F.lit(str(v))) for n, v in notes.items()])
        time, order = ("at", ["now", "seq", "rule_no", "tail2"]) if "at" in fired.columns else ("now", ["seq", "rule_no"])
        return running(fired, ["tail", "life_no"], time, order, lasts={"note": sets}, inclusive=False, width=width)

    def report(self, noted: DataFrame) -> DataFrame:
        """Counts per rule with a ``track`` action: in total (note null) and per note."""
        tracked = [n for n, b in self.rules.items() if "track" in (b["actions"] or {})]
        rows = noted.where(F.col("rule").isin(tracked))
        total = rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select("rule", F.lit(None).cast("string").alias("note"), "n")
        per_note = rows.where(F.col("note").isNotNull() & (F.col("note") != "")).groupBy("rule", "note").agg(F.count(F.lit(1)).alias("n"))
        return total.unionByName(per_note)

    def proximity_firings(self, steps: DataFrame, name: str, first_only: bool = False, interpolate: bool = True, hold: int = 5,
                          keep: Sequence[str] = MEMBER) -> DataFrame:
        """Pairs satisfying a proximity rule at each second, before pauses; both members
        must pass the other conditions of the rule."""
        vertical, lateral = self.rules[name]["conditions"]["proximity"]
        pieces = proximity.track_pieces(steps, hold=hold, interpolate=interpolate, keep=keep)
        rows = proximity.directed(proximity.near_pairs(pieces, float(lateral), float(vertical)))
        one, two = self.predicate(name, "1"), self.predicate(name, "2") & self.pair_condition(name)
        if first_only:
            return proximity.first_neighbour(rows, one, two)
        return rows.where(one & two)

    def altitude_window(self) -> tuple[int, int]:
        """Altitude limits of the first proximity rule that has both, else 0-18000."""
        for body in self.rules.values():
            cond = body["conditions"] or {}
            if "proximity" in cond and "min_alt" in cond and "max_alt" in cond:
                return int(cond["min_alt"]), int(cond["max_alt"])
        return sequence.MIN_ALT_FT, sequence.MAX_ALT_FT


def position_text(prefix: str = "") -> Column:
    p = prefix
    return F.concat_ws(" ", F.col(p + "tail"), F.date_format(as_timestamp(p + "now"), "MM/dd/yy HH:mm:ss"),
                       F.format_string("%.4f, %.4f", F.col(p + "lat"), F.col(p + "lon")), F.concat(F.col(p + "alt_baro").cast("string"), F.lit("ft")))


def slots_text(slots) -> Column:
    c = F.col(slots) if isinstance(slots, str) else slots
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda s: F.coalesce(s, F.lit("-"))), ", "), F.lit("]"))


def alerts(rules: Rules, fired: DataFrame) -> DataFrame:
    """Webhook rows: (rule, tail, now, channel, recipient, message)."""
    out = None
    for name, body in rules.rules.items():
        hook = (body["actions"] or {}).get("webhook")
        if not hook:
            continue
        channel, recipient = hook
        if channel == "slack":
            text = F.concat(
                F.lit(f"Rule {name} matched for: "), position_text(), F.lit(" "), slots_text("was_inside"), F.lit("->"), slots_text("inside"),
                F.lit("\nLIVE LINK: "), labels.live_link("lat", "lon"), F.lit("\nRECORDING: "), labels.replay_link("now", "lat", "lon"))
        else:
            text = F.concat(F.lit(f"Rule {name}: "), position_text(), F.lit(" "), slots_text("inside"))
        rows = fired.where(F.col("rule") == name).select(
            "rule", "tail", "now", F.lit(channel).alias("channel"), F.lit(recipient).alias("recipient"), text.alias("message"))
        out = rows if out is None else out.unionByName(rows)
    return out


def csv_lines(rules: Rules, fired: DataFrame, second_tail: str | None = None) -> DataFrame:
    """One post-processing line per firing of a rule with ``print_csv``."""
    kinds = {n: (b["actions"]["print_csv"] if isinstance(b["actions"]["print_csv"], str) else n)
             for n, b in rules.rules.items() if "print_csv" in (b["actions"] or {})}
    rows = fired.where(F.col("rule").isin(list(kinds)))
    stamp = as_timestamp("now")
    second_tail = second_tail or ("tail2" if "tail2" in fired.columns else None)
    tail2 = F.trim(F.col(second_tail)) if second_tail else F.lit("")
    line = F.concat(
        F.lit(EVENT_MARKER),
        F.concat_ws(",",
                    F.col("now").cast("string"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.date_format(stamp, "yyyy-MM-dd-HH:mm"),
                    F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("alt_baro").cast("string"), F.trim("tail"),
                    F.coalesce(tail2, F.lit("")), F.lit(""), labels.replay_link("now", "lat", "lon", 12), F.lit(""), F.lit(""),
                    labels.lookup("rule", kinds, ""), F.lit(""), F.lit(""), F.lit(""), F.lit("")))
    return rows.select("rule", "tail", "now", line.alias("line"))


def printed(fired: DataFrame) -> DataFrame:
    """Console lines of ``print`` rules; needs ``note``."""
    return fired.select("rule", "tail", "now", F.concat(
        F.col("rule"), F.lit(": "), F.date_format(as_timestamp("now"), "MM/dd/yy HH:mm:ss"), F.lit(" "), position_text(), F.lit(" "),
        slots_text("was_inside"), F.lit("->"), slots_text("inside"), F.lit(" "), F.coalesce(F.col("note"), F.lit(""))).alias("line"))


class Engine:
    """Rules bound to handlers: each handler gets a DataFrame, never single rows.

    Firings of a pair rule (``Rules.all_firings``) carry both aircraft: the columns of
    the one that looks, and ``tail2`` and ``other`` for the one it sees.
    """

    def __init__(self, rules: Rules):
        self.rules = rules
        self.handlers: dict[str, list[Callable[[DataFrame], None]]] = {}
        self.channels: dict[str, Callable[[DataFrame], None]] = {}
        self.expire_handlers: dict[str, Callable[[DataFrame], None]] = {}
        self.point_handlers: list[Callable[[DataFrame], None]] = []
        self.second_handlers: list[Callable[[DataFrame], None]] = []

    def on(self, rule_or_callback: str, handler: Callable[[DataFrame], None]) -> Engine:
        self.handlers.setdefault(rule_or_callback, []).append(handler)
        return self

    def on_expire(self, callback: str, handler: Callable[[DataFrame], None]) -> Engine:
        self.expire_handlers[callback] = handler
        return self

    def channel(self, name: str, handler: Callable[[DataFrame], None]) -> Engine:
        self.channels[name] = handler
        return self

    def on_points(self, handler: Callable[[DataFrame], None]) -> Engine:
        """``handler`` gets the resampled points, one row per aircraft and second."""
        self.point_handlers.append(handler)
        return self

    def on_seconds(self, handler: Callable[[DataFrame], None]) -> Engine:
        """``handler`` gets one row per second that has points: sec, points, aircraft."""
        self.second_handlers.append(handler)
        return self

    def dispatch_resampled(self, points: DataFrame) -> None:
        """``points``: output of ``sequence.resample``; stage it when more than one handler reads it."""
        for handler in self.point_handlers:
            handler(points)
        if self.second_handlers:
            seconds = self._seconds(points)
            for handler in self.second_handlers:
                handler(seconds)

    @staticmethod
    def _seconds(points: DataFrame) -> DataFrame:
        """Points and aircraft of each second. What is counted is written first, so a task gets about ``SECOND_ROWS`` of it
        however many there are; it is dealt by second once, for both counts."""
        seen = stage(points.select("sec", "tail"), "seconds")
        tasks = max(task_count(points), -(-seen.count() // SECOND_ROWS))
        dealt = seen.repartition(tasks, "sec")
        return dealt.groupBy("sec").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("tail").alias("aircraft"))

    def dispatch(self, fired: DataFrame) -> None:
        for name, body in self.rules.rules.items():
            wanted = [name, (body["actions"] or {}).get("callback")]
            for key in dict.fromkeys(w for w in wanted if w):
                for handler in self.handlers.get(key, ()):
                    handler(fired.where(F.col("rule") == name))
        sent = alerts(self.rules, fired) if self.channels else None
        if sent is not None:
            for channel, handler in self.channels.items():
                handler(sent.where(F.col("channel") == channel))

    def dispatch_expired(self, expired: DataFrame) -> None:
        """``expired``: last prepared report of each ended life."""
        for name, body in self.rules.rules.items():
            callback = (body["actions"] or {}).get("expire_callback")
            if callback in self.expire_handlers:
                self.expire_handlers[callback](expired.where(self.rules.predicate(name)))
