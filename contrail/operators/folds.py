"""Greedy folds: cooldown, heading decimation, closest-approach replacement.

Cooldowns follow pointers from firing to firing (``_entered``). Each of the other folds
walks a key's rows in order and keeps a row depending on the last kept one.  That is sequential, yet a key may be too large for one task, so the walk is
split like this:

1. per (key, slice): describe the slice as a function of the state it receives.
   The folds allow a short description, because the incoming state only
   decides which row of the slice is kept first; after that row the walk is
   fixed.
2. per key: run the state through the descriptions in slice order.  This reads a
   few numbers per slice, never rows.
3. per (key, slice): walk the slice from its now known incoming state.

Steps 1 and 3 hold one slice of one key in memory, step 2 one description per
slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage, task_count, tasks_for
from .timeline import SLICE_S, SLICE, running, sliced

LIMITS = "array<array<double>>"
# Rows that a task of heading decimation holds, about.
TRACK_ROWS = 1_000_000
# Slices that a walk with coupled pauses goes through before it hands its state on, at least.
STRETCH_SLICES = 64


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups of a partition sorted by ``by``: frames with their group bounds.

    The last group of a batch may continue in the next one and is held back.
    """
    held = None
    for pdf in batches:
        if held is not None and len(held):
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        fresh = np.zeros(len(pdf), dtype=bool)
        for c in by:
            col = pdf[c].to_numpy()
            fresh[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(fresh)
        if not len(starts):
            held = pdf
            continue
        cut = int(starts[-1])
        yield pdf.iloc[:cut], np.concatenate(([0], starts[:-1], [cut]))
        held = pdf.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def _lists(slices: pa.StructArray, names: Sequence[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Lists of numbers of a batch of slices, as flat arrays with the bounds that all of them share."""
    lists = [slices.field(c) for c in names]
    return {c: x.values.to_numpy(zero_copy_only=False) for c, x in zip(names, lists)}, lists[0].offsets.to_numpy()


def _split_fold(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], values: Sequence[str], width: float,
    describe: Callable, advance: Callable, walk: Callable, tasks: int,
) -> DataFrame:
    """The kept rows.

    ``describe(v) -> rows``, ``advance(state, rows) -> state``,
    ``walk(v, state, final) -> kept mask``.  ``v`` is a dict of numpy arrays in row
    order.  A state is a list of floats, or None before the first kept row;
    ``walk`` also learns whether the slice is the key's last.  Rows have four numbers.

    Rows are shuffled once, into one array a slice, and stay in it: Python sees only the values
    that the walk reads and answers with the places of the kept rows.
    """
    keys, values = list(keys), list(dict.fromkeys(values))
    part = [*keys, SLICE]
    base = sliced(df, time, width)
    fields = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    ddl = lambda names: ", ".join(f"`{c}` {fields[c]}" for c in names)
    # a fixed number of partitions: AQE would merge small ones and serialise the Python work
    record = F.struct(*dict.fromkeys([time, *order, *[c for c in df.columns if c not in keys]]))
    slices = base.repartition(tasks, *part).groupBy(*part).agg(F.sort_array(F.collect_list(record)).alias("_rows"))
    read = [F.col("_rows")[c].cast("array<double>").alias(f"_v{i}") for i, c in enumerate(values)]
    names = [f"_v{i}" for i in range(len(values))]

    def arrays(flat: dict, lo: int, hi: int) -> dict:
        return {c: flat[x][lo:hi] for c, x in zip(values, names)}

    def summarise(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, bounds = _lists(batch, names)
            yield pa.array([[x for r in describe(arrays(flat, lo, hi)) for x in r] for lo, hi in zip(bounds, bounds[1:])], pa.list_(pa.float64()))

    described = slices.select(*part, F.arrow_udf(summarise, "array<double>")(F.struct(*read)).alias("_desc"))

    def thread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _groups(batches, keys):
            incoming, final = [], []
            descs = pdf["_desc"].to_list()
            for lo, hi in zip(bounds, bounds[1:]):
                state = None
                for i in range(lo, hi):
                    incoming.append(state)
                    final.append(i == hi - 1)
                    state = advance(state, descs[i].reshape(-1, 4).tolist()) if i < hi - 1 else None
            yield pdf[part].assign(_state=incoming, _final=final)

    states = described.repartition(tasks, *keys).sortWithinPartitions(*part).mapInPandas(
        thread, f"{ddl(part)}, _state array<double>, _final boolean")
    # the states are the small side; arrays of rows need no sort
    right = states.withColumnsRenamed({c: f"_c_{c}" for c in part}).hint("shuffle_hash")
    joined = slices.join(right, _all_equal(slices, part), "left").drop(*[f"_c_{c}" for c in part])

    def finish(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, bounds = _lists(batch, names)
            states, finals = batch.field("_state").to_pylist(), batch.field("_final").to_pylist()
            chosen = [np.flatnonzero(walk(arrays(flat, lo, hi), state, bool(final))) for lo, hi, state, final in zip(bounds, bounds[1:], states, finals)]
            ends = np.cumsum([0, *map(len, chosen)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *chosen]).astype(np.int32)))

    chosen = joined.select(*keys, "_rows", F.arrow_udf(finish, "array<int>")(F.struct(*read, "_state", "_final")).alias("_kept"))
    # a filter on what Python returned would run it twice; a slice without kept rows gives one row of nulls
    kept = chosen.select(*keys, F.inline_outer(F.transform("_kept", lambda i: F.get("_rows", i)))).where(F.col(time).isNotNull())
    return kept.select(*df.columns)


def _all_equal(df: DataFrame, cols: list[str]):
    cond = None
    for c in cols:
        term = F.col(c) == F.col(f"_c_{c}")
        cond = term if cond is None else cond & term
    return cond


def _keep(df: DataFrame, positions: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` at the given positions; ``on`` is unique, so no key is hot."""
    return df.join(positions, on, "left_semi")


# --- cooldown -------------------------------------------------------------

def _last_fired(t: np.ndarray, wait: float) -> np.ndarray:
    """Of rising times: the last one fired when the walk fires at each of them."""
    n = len(t)
    after = np.searchsorted(t, t + wait, side="left")
    to = np.where(after < n, after, np.arange(n))
    while True:  # every round doubles the steps that a pointer stands for
        further = to[to]
        if (further == to).all():
            return t[to]
        to = further


def _entered(nodes: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Slices that the walk of each key fires in: ``keys, _slice, _from``, the time from which it may fire there.

    A node stands for the times of a slice up to ``_upto`` that end in the same last firing,
    ``_final``; the next firing is the first time ``_wait`` later, wherever it is. So nodes point at
    nodes, and the walk is the path from a key's first one. Paths are followed by pointer doubling:
    in round k the nodes known reach 2 ** k steps further, and pointers are composed with
    themselves, so rounds grow with the logarithm of the longest path.
    """
    node = nodes.select(*keys, F.col("_upto").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_of"))
    ask = nodes.select(*keys, (F.col("_final") + F.col("_wait")).alias("_at"), F.lit(0).alias("_kind"), F.col("_upto").alias("_of"))
    asked = running(node.unionByName(ask), keys, "_at", ["_kind", "_of"], nexts={"_next": F.when(F.col("_kind") == 1, F.col("_at"))}, inclusive=False, width=width)
    jumps = stage(asked.where("_kind = 0 and _next is not null").select(*keys, F.col("_of").alias("_at"), "_next", F.col("_at").alias("_from")), "jumps")
    known = nodes.groupBy(*keys).agg(F.min("_upto").alias("_at")).withColumn("_from", F.lit(float("-inf")))
    more = not jumps.isEmpty()
    known = stage(known, "known") if more else known
    while more:
        step = stage(known.select(*keys, "_at").join(jumps, [*keys, "_at"]).select(*keys, F.col("_next").alias("_at"), "_from"), "known")
        more = not step.isEmpty()
        if more:
            known = known.unionByName(step)
            further = jumps.select(*keys, F.col("_at").alias("_next"), F.col("_next").alias("_next2"), F.col("_from").alias("_from2"))
            jumps = stage(jumps.join(further, [*keys, "_next"]).select(*keys, "_at", F.col("_next2").alias("_next"), F.col("_from2").alias("_from")), "jumps")
    return known.select(*keys, F.floor(F.col("_at") / F.lit(float(width))).alias(SLICE), "_from")


def cooldown(df: DataFrame, keys: Sequence[str], time: str = "now", order: Sequence[str] = ("seq",), seconds: str = "cooldown_s",
             width: float = SLICE_S) -> DataFrame:
    """Rows at least ``seconds`` (a column, constant per key) after the last fired row.

    Slices are summed up as nodes and walked from where the path of the key enters them; no
    task holds more than a slice, whatever the share of a key and the length of the pause.
    """
    keys = list(keys)
    position = [*keys, time, *order]
    base = sliced(df.select(*dict.fromkeys([*position, seconds])), time, width)
    fields = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    part = [*keys, SLICE]
    ddl = lambda names: ", ".join(f"`{c}` {fields[c]}" for c in names)
    n = task_count(df)
    base = base.repartition(n, *part)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _groups(batches, part):
            out = []
            for lo, hi in zip(bounds, bounds[1:]):
                t, wait = np.unique(pdf[time].to_numpy("float64")[lo:hi]), float(pdf[seconds].iloc[lo])
                if wait <= 0:
                    continue
                final = _last_fired(t, wait)
                last = np.append(final[1:] != final[:-1], True)
                out.append(pdf.iloc[[lo] * int(last.sum())][keys].assign(_upto=t[last], _final=final[last], _wait=wait))
            if out:
                yield pd.concat(out, ignore_index=True)

    nodes = base.sortWithinPartitions(*part, time).mapInPandas(summed, f"{ddl(keys)}, _upto double, _final double, _wait double")
    entered = _entered(stage(nodes, "nodes"), keys, width)
    joined = base.join(entered.withColumnsRenamed({c: f"_c_{c}" for c in part}), _all_equal(base, part), "left").drop(*[f"_c_{c}" for c in part])
    joined = joined.where(F.col("_from").isNotNull() | (F.col(seconds) <= 0))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _groups(batches, part):
            times, chosen = pdf[time].to_numpy("float64"), np.zeros(len(pdf), dtype=bool)
            for lo, hi in zip(bounds, bounds[1:]):
                t, wait = times[lo:hi], float(pdf[seconds].iloc[lo])
                if wait <= 0:
                    chosen[lo:hi] = True
                    continue
                i = int(np.searchsorted(t, pdf["_from"].iloc[lo], side="left"))
                while i < len(t):
                    chosen[lo + i] = True
                    i = int(np.searchsorted(t, t[i] + wait, side="left"))
            yield pdf.loc[chosen, position]

    fired = joined.repartition(n, *part).sortWithinPartitions(*part, time, *order).mapInPandas(walk, ddl(position))
    return _keep(df, fired, position)


def checkpoints(df: DataFrame, time: str = "now", interval: float = 5.0) -> DataFrame:
    """Seconds (``sec``) at which a periodic check runs: the first second with a report
    at least ``interval`` after the check before.  The data's first second only starts
    the clock; silence has no checks.  A check sees all reports of its second."""
    secs = df.select(F.floor(time).cast("bigint").alias("sec")).where("sec is not null").distinct()
    secs = secs.withColumn("_all", F.lit(0)).withColumn("_pause", F.lit(float(interval)))
    first = secs.agg(F.min("sec")).scalar()
    return cooldown(secs, ["_all"], "sec", [], "_pause").where(F.col("sec") > first).select("sec")


def paced(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], actors: Sequence[tuple[str, str]],
          pause: str, key_pause: str, width: float = SLICE_S) -> DataFrame:
    """Rows that fire when each actor and the whole key must have been quiet.

    ``actors`` are (name, time) columns; the first one is the actor that fires.  A row
    fires when, for every actor present, its time is at least ``pause`` after that
    actor's last firing and at least ``key_pause`` after the key's last firing.  Rows
    are walked in (time, order), which must be unique within a key.

    What a slice does depends on every actor's last firing, so it has no short
    description.  Stretches of consecutive slices are therefore walked in parallel from an
    assumed state, and those whose predecessor ends in another state than assumed are walked
    again, up to the slice that ends as it did before, until none is left.  A state holds only
    firings still within a pause.  Walks from two states meet after some slices, and a stretch is
    long against that, so rounds stay few whatever the length of the data.  A task holds one slice
    at a time.  Walks that never meet are as sequential as the rule itself.
    """
    keys = list(keys)
    position = [*keys, time, *order]
    slim = list(dict.fromkeys([*position, *[c for a in actors for c in a], pause, key_pause]))
    part, sort = [*keys, SLICE], [time, *order]
    base = stage(sliced(df.select(*slim), time, width), "paced")
    fields = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    ddl = lambda names: ", ".join(f"`{c}` {fields[c]}" for c in names)
    n = task_count(df)
    late = 60.0  # a row's actors may have been heard this much before the row
    slices = stage(base.select(*part).distinct(), "paced")
    long = max(STRETCH_SLICES, -(-slices.count() // (4 * n)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(SLICE)) - 1
    slices = slices.withColumn("_stretch", F.floor(place / long))

    def pace(columns: list[list], lo: int, hi: int, last: dict, wait: float, wait_all: float) -> list[int]:
        """Rows lo..hi that fire; ``last`` is left as the walk leaves it."""
        fired, quiet = [], last.get("", -np.inf)
        own, at = columns[0], columns[1]
        for i in range(lo, hi):
            ready = True
            for name, when in zip(columns[::2], columns[1::2]):
                who = name[i]
                if isinstance(who, str) and (when[i] - quiet < wait_all or when[i] - last.get(who, -np.inf) < wait):
                    ready = False
                    break
            if ready:
                fired.append(i)
                last[own[i]] = quiet = at[i]
        if fired:
            last[""] = quiet
        return fired

    def actor_lists(pdf: pd.DataFrame) -> list[list]:
        return [pdf[c].to_list() for a in actors for c in a]

    def state_of(who, at) -> dict:
        return {} if who is None else dict(zip(who, at))

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, last, met = None, {}, False
        for pdf, bounds in _groups(batches, part):
            columns, out = actor_lists(pdf), []
            heads = pdf.iloc[bounds[:-1]]
            heads = heads[[*part, "_stretch", "_who", "_at", "_who0", "_at0", pause, key_pause]].reset_index(drop=True)
            for g, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                h = heads.loc[g]
                if (own := (*h[keys], h["_stretch"])) != stretch:
                    stretch, last, met = own, state_of(h["_who"], h["_at"]), False
                if met:
                    continue
                wait, wait_all = float(h[pause]), float(h[key_pause])
                before = dict(last)
                pace(columns, lo, hi, last, wait, wait_all)
                end = (h[SLICE] + 1) * width - late
                last = {k: v for k, v in last.items() if end - v < (wait if k else wait_all)}
                met = h["_who0"] is not None and last == state_of(h["_who0"], h["_at0"])
                out.append((*h[part], h["_stretch"], *listed(before), *listed(last)))
            if out:
                yield pd.DataFrame(out, columns=[*part, "_stretch", "_who", "_at", "_who2", "_at2"])

    def listed(state: dict) -> tuple[list, list]:
        return sorted(state), [state[k] for k in sorted(state)]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in _groups(batches, part):
            columns, chosen = actor_lists(pdf), []
            for lo, hi in zip(bounds, bounds[1:]):
                h = pdf.iloc[lo]
                chosen += pace(columns, lo, hi, state_of(h["_who"], h["_at"]), float(h[pause]), float(h[key_pause]))
            yield pdf.iloc[chosen][position]

    walked = f"{ddl(part)}, _stretch bigint, _who array<string>, _at array<double>, _who2 array<string>, _at2 array<double>"

    def entered(states: DataFrame, whole: list[str]) -> DataFrame:
        right = states.withColumnsRenamed({c: f"_c_{c}" for c in part})
        rows = base.join(right, _all_equal(base, part)).drop(*[f"_c_{c}" for c in part])
        return rows.repartition(n, *whole).sortWithinPartitions(*whole, *part, *sort)

    names, numbers = (F.array().cast(f"array<{kind}>") for kind in ("string", "double"))
    todo = slices.select(*keys, "_stretch").distinct().select("*", names.alias("_who"), numbers.alias("_at"))
    done = None
    while True:
        asked = slices.join(todo, [*keys, "_stretch"])
        if done is None:
            asked = asked.withColumn("_who0", F.lit(None).cast("array<string>")).withColumn("_at0", F.lit(None).cast("array<double>"))
        else:
            asked = asked.join(done.select(*part, F.col("_who2").alias("_who0"), F.col("_at2").alias("_at0")), part)
        fresh = stage(entered(asked, [*keys, "_stretch"]).mapInPandas(leave, walked), "paced")
        done = fresh if done is None else stage(done.join(fresh.select(*part), part, "left_anti").unionByName(fresh), "paced")
        before = Window.partitionBy(*keys).orderBy(SLICE)
        left = lambda c, none: F.coalesce(F.lag(c).over(before), none)
        seen = done.select("*", left("_who2", names).alias("_who1"), left("_at2", numbers).alias("_at1"))
        wrong = (F.col("_who") != F.col("_who1")) | (F.col("_at") != F.col("_at1"))
        todo = stage(seen.where(wrong).select(*keys, "_stretch", F.col("_who1").alias("_who"), F.col("_at1").alias("_at")), "paced")
        if todo.isEmpty():
            break
    fired = entered(done.select(*part, "_who", "_at"), part).mapInPandas(choose, ddl(position))
    return _keep(df, fired, position)


# --- heading decimation -----------------------------------------------------

def decimate(df: DataFrame, keys: Sequence[str], time: str = "sec", order: Sequence[str] = (), heading: str = "track",
             min_change: float = 10.0, width: float = SLICE_S) -> DataFrame:
    """Keep each track's first and last row, and rows whose heading differs by
    ``min_change`` or more from the last kept heading.

    The rows are counted before, so that a task gets about ``TRACK_ROWS`` of them: put
    ``session.stage`` before what makes them if that is expensive."""

    def last_kept(h, i, known):
        # walks that meet go on as one: ``known`` has the end of each row's
        cur, seen = h[i], [i]
        for j in range(i + 1, len(h)):
            d = abs(h[j] - cur)
            if d >= min_change and (d <= 180.0 or 360.0 - d >= min_change):
                if j in known:
                    cur = known[j]
                    break
                seen.append(j)
                cur = h[j]
        known.update(dict.fromkeys(seen, cur))
        return cur

    def describe(v):
        # Incoming headings still unmatched form one arc [a, b] around the first
        # heading; every row cuts its ends off.  Rows: (kind, a, b, result).
        h, known = v[heading].tolist(), {}
        c, lo, hi = h[0], -min_change, min_change
        rows = [(c, last_kept(h, 0, known), 0.0, 0.0)]
        for i in range(1, len(h)):
            d = (h[i] - c + 180.0) % 360.0 - 180.0
            new_lo, new_hi = max(lo, d - min_change), min(hi, d + min_change)
            if new_lo > lo or new_hi < hi:
                result = known[i] if i in known else last_kept(h, i, known)
                if new_lo >= new_hi:
                    rows.append((lo, hi, result, 1.0))
                    lo = hi = 0.0
                    break
                if new_lo > lo:
                    rows.append((lo, new_lo, result, 1.0))
                if new_hi < hi:
                    rows.append((new_hi, hi, result, 1.0))
                lo, hi = new_lo, new_hi
        return rows

    def advance(state, desc):
        center, first_result = desc[0][0], desc[0][1]
        if state is None:
            return [first_result]
        d = (state[0] - center + 180.0) % 360.0 - 180.0
        if abs(d) >= min_change:
            return [first_result]
        for lo, hi, result, _ in desc[1:]:
            # a kept end is at exactly min_change from the row that cut it
            if lo <= d <= hi:
                return [result]
        return state

    def walk(v, state, final_slice):
        h = v[heading].tolist()
        kept = np.zeros(len(h), dtype=bool)
        kept[0] = state is None
        cur, rows = h[0] if state is None else state[0], []
        for i, x in enumerate(h):
            d = abs(x - cur)
            if d >= min_change and (d <= 180.0 or 360.0 - d >= min_change):
                rows.append(i)
                cur = x
        kept[rows] = True
        kept[-1] |= final_slice
        return kept

    position = [*keys, time, *order]
    tasks = tasks_for(df, TRACK_ROWS)
    if not any("map<" in kind for _, kind in df.dtypes):
        return _split_fold(df, keys, time, order, [heading], width, describe, advance, walk, tasks)
    # maps have no order, so their rows are fetched by position
    kept = _split_fold(df.select(*dict.fromkeys([*position, heading])), keys, time, order, [heading], width, describe, advance, walk, tasks)
    return _keep(df, kept, position)


# --- closest approach -------------------------------------------------------

def closest_approach(df: DataFrame, keys: Sequence[str], time: str = "sec", order: Sequence[str] = (), lateral: str = "lateral_nm",
                     vertical: str = "alt_sep_ft", width: float = SLICE_S) -> DataFrame:
    """Positions of the rows that replaced the stored minima, which happens when the
    lateral or the vertical separation is below the stored one (both are then
    stored together).  The last such row of a key is its closest approach."""

    def chain(lat, alt):
        """Last row adopted when the walk adopts row i, for every i."""
        n = len(lat)
        final = np.arange(n)
        for i in range(n - 2, -1, -1):
            later = np.nonzero((lat[i + 1:] < lat[i]) | (alt[i + 1:] < alt[i]))[0]
            if len(later):
                final[i] = final[i + 1 + int(later[0])]
        return final

    def describe(v):
        # running minima: the rows at which an incoming pair can be replaced first
        lat, alt = v[lateral], v[vertical]
        low_lat, low_alt = np.minimum.accumulate(lat), np.minimum.accumulate(alt)
        fresh = np.append(True, (low_lat[1:] < low_lat[:-1]) | (low_alt[1:] < low_alt[:-1]))
        final = chain(lat, alt)
        return [(low_lat[i], low_alt[i], lat[final[i]], alt[final[i]]) for i in np.nonzero(fresh)[0]]

    def advance(state, desc):
        if state is None:
            return list(desc[0][2:])
        for low_lat, low_alt, lat, alt in desc:
            if low_lat < state[0] or low_alt < state[1]:
                return [lat, alt]
        return state

    def walk(v, state, final_slice):
        lat, alt = v[lateral], v[vertical]
        adopted = np.zeros(len(lat), dtype=bool)
        cur = state
        for i in range(len(lat)):
            if cur is None or lat[i] < cur[0] or alt[i] < cur[1]:
                adopted[i] = True
                cur = (lat[i], alt[i])
        return adopted

    position = [*keys, time, *order]
    slim = df.select(*dict.fromkeys([*position, lateral, vertical]))
    return _split_fold(slim, keys, time, order, [lateral, vertical], width, describe, advance, walk, task_count(df)).select(*position)
