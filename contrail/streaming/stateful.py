"""Stateful streams: aircraft tracking with expiry, event lifecycle, cooldown.

State is small per key (last report, running minima, last firing).  The rows of a
key within one micro-batch are sorted before use; how many there can be is set by
the source's rate limit.  Time is event time: expiry and closing are driven by the
watermark, and rows older than it are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geo
from ..session import scratch_path, task_count

PARTITIONS = "spark.sql.shuffle.partitions"
EXPIRE_S = 180
QUIET_S = 61


def with_event_time(df: DataFrame, time: str = "now", delay: str = "10 seconds") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros((F.col(time) * 1_000_000).cast("bigint"))).withWatermark("event_time", delay)


def _sorted(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts, ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


def _arm(state: GroupState, due: float) -> None:
    """Timer at ``due`` seconds, or just past the watermark if that is later."""
    state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))


# Rows that leave a key's Python function at once.
OUT_ROWS = 20_000

TRACK_SCHEMA = "tail string, kind string, seq bigint, now double, life_start double, was_inside array<string>, inside array<string>"


def track(reports: DataFrame, expire_s: float = EXPIRE_S) -> DataFrame:
    """Reports (tail, now, seq, inside, event_time) with the regions of the report
    before, and one 'expired' row with the final state of every ended life.

    A batch's reports of a key are held as numbers, with one list for each set of regions, and rows
    leave in pieces, so a task holds some 20 bytes a report.
    """
    names = ["tail", "kind", "seq", "now", "life_start", "was_inside", "inside"]

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            start, last, seq, inside = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "expired", seq, last, start, None, list(inside))], columns=names)
            return
        cur = state.get if state.exists else None
        regions, numbers, parts = [], {}, []
        for pdf in batches:
            codes = np.empty(len(pdf), "int32")
            for i, inside in enumerate(pdf["inside"]):
                own = tuple(None if x is None else str(x) for x in inside)
                if own not in numbers:
                    numbers[own] = len(regions)
                    regions.append(list(own))
                codes[i] = numbers[own]
            parts.append((pdf["now"].to_numpy("float64"), pdf["seq"].to_numpy("int64"), codes))
        now, seq, codes = (np.concatenate([p[j] for p in parts]) for j in range(3))
        del parts
        order = np.lexsort((seq, now))
        for lo in range(0, len(order), OUT_ROWS):
            at, out = order[lo:lo + OUT_ROWS], []
            for t, n, c in zip(now[at].tolist(), seq[at].tolist(), codes[at].tolist()):
                inside = regions[c]
                if cur is not None and t - cur[1] > expire_s:
                    out.append((key[0], "expired", cur[2], cur[1], cur[0], None, list(cur[3])))
                    cur = None
                was = [None] * len(inside) if cur is None else list(cur[3])
                start = t if cur is None else cur[0]
                out.append((key[0], "report", n, t, start, was, inside))
                cur = (start, t, n, inside)
            if lo + OUT_ROWS >= len(order):
                state.update(cur)
                _arm(state, cur[1] + expire_s)
            yield pd.DataFrame(out, columns=names)

    rows = reports.select("tail", "seq", "now", "inside", "event_time")
    return rows.groupBy("tail").applyInPandasWithState(
        step, TRACK_SCHEMA, "start double, last double, seq bigint, inside array<string>", "append", GroupStateTimeout.EventTimeTimeout)


REORDER_SCHEMA = "tail string, kind string, seq bigint, now double"


def reorder(reports: DataFrame, delay_s: float = 10.0) -> DataFrame:
    """Reports (tail, now, seq) in the order of time, and those that came too late, counted apart.

    A buffer holds each aircraft's reports until its latest one is ``delay_s`` past them; they
    leave it in order, kind 'on_time'. A report ``delay_s`` or more behind the latest that came
    before it (in the order of ``seq``) can't be put in order any more: it leaves at once as
    'late'. So every report is late, on time, or still held; an aircraft's last reports stay held
    until it reports again. Buffers hold ``delay_s`` of one aircraft. No watermark is set, since
    Spark would drop late rows uncounted, and no timer of processing time, with which a run over
    what is available would never end.
    """
    def step(key, batches, state: GroupState):
        high, now, seq = state.get if state.exists else (-np.inf, [], [])
        rows = _sorted(batches, ["seq"])
        came, number = rows["now"].to_numpy("float64"), rows["seq"].to_numpy("int64")
        before = np.maximum.accumulate(np.append(high, came))[:-1]
        late = came < before - delay_s
        high = max(high, float(came.max()))
        held_now, held_seq = np.append(now, came[~late]), np.append(np.array(seq, np.int64), number[~late])
        order = np.lexsort((held_seq, held_now))
        held_now, held_seq = held_now[order], held_seq[order]
        ready = int(np.searchsorted(held_now, high - delay_s, side="right"))
        kinds = ["late"] * int(late.sum()) + ["on_time"] * ready
        seqs, nows = [*number[late].tolist(), *held_seq[:ready].tolist()], [*came[late].tolist(), *held_now[:ready].tolist()]
        state.update((high, held_now[ready:].tolist(), held_seq[ready:].tolist()))
        yield pd.DataFrame({"tail": [key[0]] * len(kinds), "kind": kinds, "seq": seqs, "now": nows})

    return reports.select("tail", "now", "seq").groupBy("tail").applyInPandasWithState(
        step, REORDER_SCHEMA, "high double, now array<double>, seq array<bigint>", "append", GroupStateTimeout.NoTimeout)


LIFECYCLE_SCHEMA = "tail1 string, tail2 string, kind string, create_time double, last_time double, cpa_time double, lateral_nm double, alt_sep_ft double, hits bigint"


def lifecycle(hits: DataFrame, quiet_s: float = QUIET_S) -> DataFrame:
    """An 'open' row at the first hit of a pair and a 'close' row after a silence.

    Input: tail1, tail2, sec, last_now, lateral_nm, alt_sep_ft, event_time.  The
    stored minima are replaced together when either separation is below them.
    """
    def row(key, kind, s):
        create, last, cpa, lat, alt, n = s
        return (key[0], key[1], kind, create, last, cpa, lat, alt, n)

    def step(key, batches, state: GroupState):
        out = []
        if state.hasTimedOut:
            out.append(row(key, "close", state.get))
            state.remove()
        else:
            cur = tuple(state.get) if state.exists else None
            for r in _sorted(batches, ["sec"]).itertuples(index=False):
                at = float(r.last_now)
                if cur is not None and r.sec - cur[1] > quiet_s:
                    out.append(row(key, "close", cur))
                    cur = None
                if cur is None:
                    cur = (at, at, at, float(r.lateral_nm), float(r.alt_sep_ft), 1)
                    out.append(row(key, "open", cur))
                else:
                    create, _, cpa, lat, alt, n = cur
                    if r.lateral_nm < lat or r.alt_sep_ft < alt:
                        cpa, lat, alt = at, float(r.lateral_nm), float(r.alt_sep_ft)
                    cur = (create, at, cpa, lat, alt, n + 1)
            state.update(cur)
            _arm(state, cur[1] + quiet_s)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LIFECYCLE_SCHEMA.split(", ")])

    rows = hits.select("tail1", "tail2", "sec", "last_now", "lateral_nm", "alt_sep_ft", "event_time")
    return rows.groupBy("tail1", "tail2").applyInPandasWithState(
        step, LIFECYCLE_SCHEMA, "create double, last double, cpa double, lat double, alt double, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def cooldown(matches: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Rows that fire: at least ``seconds`` since the last fired row of their key.

    Input: key columns (strings), now, seq, event_time.  State ends ``seconds``
    after the last firing, when it can no longer hold anything back.
    """
    def step(key, batches, state: GroupState):
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for r in _sorted(batches, ["now", "seq"]).itertuples(index=False):
                if last is None or r.now - last >= seconds:
                    last = float(r.now)
                    out.append((*key, last, int(r.seq)))
            state.update((last,))
            _arm(state, last + seconds)
        yield pd.DataFrame(out, columns=[*keys, "now", "seq"])

    schema = ", ".join(f"{k} string" for k in keys) + ", now double, seq bigint"
    return matches.select(*keys, "now", "seq", "event_time").groupBy(*keys).applyInPandasWithState(
        step, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def checkpoint_windows(reports: DataFrame, seconds: int = 5, key: Column | None = None) -> DataFrame:
    """Reports per tumbling window, emitted when the watermark passes the window."""
    groups = [F.window("event_time", f"{seconds} seconds").alias("w")] + ([key] if key is not None else [])
    return reports.groupBy(*groups).agg(F.count(F.lit(1)).alias("reports"))


PAIR_SCHEMA = "tail1 string, seq1 bigint, lat1 double, lon1 double, tail2 string, seq2 bigint, lat2 double, lon2 double"
HELD = np.dtype([("side", "i1"), ("tail", "i4"), *[(c, "i8") for c in ("seq", "at", "ct", "y0", "y1", "x0", "x1")], *[(c, "f8") for c in ("lat", "lon", "alt")]])
#: Cells a side of a block; keys that blocks of a stretch of time are dealt to (as many in each run, since state is by key).
BLOCK_CELLS = 10
BUCKETS = 256
#: Copies of reports, and pairs of reports, that are looked at together.
MEET_AT_ONCE = 200_000
#: Degrees beyond which places share their cells, and what stands for a missing ``seq``.
FARTHEST = 1e4
NO_SEQ = -(2**63)


def _shares(counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of rows whose counts add up to ``most`` or less (or single rows): a row's place once for each number below its count."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
        row = np.repeat(np.arange(lo, hi), counts[lo:hi])
        yield row, np.arange(ends[hi - 1] - before) - (ends[row] - counts[row] - before)
        lo = hi


def _meetings(a: np.ndarray, b: np.ndarray, age: int, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of reports at most ``age`` apart, where the cell of the one is in the reach of the other."""
    if not len(a) or not len(b):
        return
    first = min(int(a["ct"].min()), int(b["ct"].min()))

    def cell(ct, y, x):  # equal cells have equal numbers; tiny cells or very long times can share one, so cells are compared below
        return ((ct - first) * (1 << 20) + y) * (1 << 20) + x

    span, start = stretch + 4 * age, lambda r: r["at"] - r["ct"] * stretch + 2 * age
    own = cell(a["ct"], a["y0"], a["x0"])
    cells, rank = np.unique(own, return_inverse=True)
    key = rank * span + start(a)
    order = np.argsort(key, kind="stable")
    key = key[order]
    wide = b["x1"] - b["x0"] + 1
    for row, k in _shares((b["y1"] - b["y0"] + 1) * wide, MEET_AT_ONCE):
        r = b[row]
        y, x = r["y0"] + k // wide[row], r["x0"] + k % wide[row]
        number = cell(r["ct"], y, x)
        at = np.minimum(np.searchsorted(cells, number), len(cells) - 1)
        met = cells[at] == number
        row, y, x, at, begun = row[met], y[met], x[met], at[met] * span, start(r[met])
        lo, hi = np.searchsorted(key, at + begun - age, side="left"), np.searchsorted(key, at + begun + age, side="right")
        for j, k in _shares(hi - lo, MEET_AT_ONCE):
            i = order[lo[j] + k]
            same = (a["ct"][i] == b["ct"][row[j]]) & (a["y0"][i] == y[j]) & (a["x0"][i] == x[j])
            yield i[same], row[j[same]]


def fresh_pairs(a: DataFrame, b: DataFrame, lateral_nm: float, vertical_ft: float, max_age_s: int = 5, cell_deg: float = 0.05) -> DataFrame:
    """Reports of two streams at most ``max_age_s`` apart in time and within both limits.

    An interval join of two streams on grid cells and stretches of time. The one side is copied to the blocks of cells in its
    reach, which follows from its latitude, and to the stretches in its interval; within a block and a stretch a report meets
    those of its time in the cells of its reach, whatever a batch holds. Both sides carry watermarks: late reports are dropped,
    and reports that no later one can meet leave the state. It holds some 90 bytes a copy (1.5 copies of the one side, one of
    the other), of the batch before and this one.
    """
    dy = lateral_nm / geo.NM_PER_DEGREE * 1.01
    age = max_age_s * 1_000_000
    stretch = 12 * age
    far = np.sin(min(lateral_nm * 1.000001 / (2 * geo.EARTH_RADIUS_NM), np.pi / 2)) ** 2
    numbers = [c for c in HELD.names if c != "tail"]

    def side(df: DataFrame, n: int, reach: float, held_s: int) -> DataFrame:
        rows = df.select(
            F.lit(n).alias("side"), "tail", F.coalesce(F.col("seq").cast("bigint"), F.lit(NO_SEQ)).alias("seq"), "event_time", F.unix_micros("event_time").alias("at"),
            F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("alt_baro").cast("double").alias("alt")).dropna()
        rows = rows.withColumn(f"ct{n}", F.explode(F.sequence(*[F.floor((F.col("at") + d) / stretch) for d in (-held_s, held_s)])))
        for c, place, by in (("y", "lat", F.lit(reach)), ("x", "lon", geo.lon_reach(reach, "lat") if reach else F.lit(0.0))):
            ends = [F.floor(F.greatest(F.least(F.col(place) + d, F.lit(FARTHEST)), F.lit(-FARTHEST)) / cell_deg) for d in (-by, by)]
            rows = rows.withColumn(f"b{c}", F.explode(F.sequence(*[F.floor(end / BLOCK_CELLS) for end in ends])))
            low = F.col(f"b{c}") * BLOCK_CELLS
            rows = rows.withColumns({f"{c}0": F.greatest(ends[0], low), f"{c}1": F.least(ends[1], low + BLOCK_CELLS - 1)})
        bucket = F.pmod(F.hash(f"ct{n}", "by", "bx"), F.lit(BUCKETS)).alias("bucket")
        return rows.select(bucket, "side", "tail", "seq", "at", F.col(f"ct{n}").alias("ct"), "y0", "y1", "x0", "x1", "lat", "lon", "alt", "event_time")

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tails, parts = {}, []
        if state.exists:
            names, held = state.get
            tails.update((n, i) for i, n in enumerate(names))
            held = np.frombuffer(bytes(held), HELD)
            parts.append(held[held["at"] >= state.getCurrentWatermarkMs() * 1000 - age])
        before = sum(map(len, parts))
        for pdf in batches:
            part = np.empty(len(pdf), HELD)
            for c in numbers:
                part[c] = pdf[c].to_numpy()
            codes, own = pd.factorize(pdf["tail"])
            part["tail"] = np.array([tails.setdefault(n, len(tails)) for n in own], "i4")[codes]
            parts.append(part)
        rows = np.concatenate(parts)
        new = np.arange(len(rows)) >= before
        names = np.array(list(tails), object)
        place = np.empty(len(names), int)
        place[np.argsort(names)] = np.arange(len(names))
        one, two = (np.flatnonzero(rows["side"] == n) for n in (1, 2))
        for i, j in _meetings(rows[one], rows[two], age, stretch):
            i, j = one[i], two[j]
            p, q = rows[i], rows[j]
            lat1, lat2 = np.radians(p["lat"]), np.radians(q["lat"])
            h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(np.radians(q["lon"] - p["lon"]) / 2) ** 2
            near = (new[i] | new[j]) & (place[p["tail"]] < place[q["tail"]]) & (np.abs(p["alt"] - q["alt"]) < vertical_ft) & (h <= far * (1 + 1e-9))
            p, q = p[near], q[near]
            if len(p):
                yield pd.DataFrame({f"{c}{n}": names[r[c]] if c == "tail" else r[c] for n, r in ((1, p), (2, q)) for c in ("tail", "seq", "lat", "lon")})
        used, own = np.unique(rows["tail"], return_inverse=True)
        rows["tail"] = own
        state.update((names[used].tolist(), rows.tobytes()))
        _arm(state, (int(rows["at"].max()) + age) / 1e6 + 1)

    both = side(a, 1, 0.0, 0).union(side(b, 2, dy, age))
    pairs = both.groupBy("bucket").applyInPandasWithState(
        step, PAIR_SCHEMA, "tails array<string>, held binary", "append", GroupStateTimeout.EventTimeTimeout)
    seqs = [F.nullif(F.col(c), F.lit(NO_SEQ)).alias(c) for c in ("seq1", "seq2")]
    return pairs.where(geo.haversine_nm("lat1", "lon1", "lat2", "lon2") < lateral_nm).select("tail1", seqs[0], "tail2", seqs[1])


def run_available(stream: DataFrame, name: str, most_tasks: int | None = None) -> DataFrame:
    """Process everything the source holds now into the shared folder; read it back.

    Every batch commits the state of each of the session's shuffle partitions; ``most_tasks`` bounds them for this run, where
    batches are small whatever the table.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True)
    tasks = task_count(stream)
    spark.conf.set(PARTITIONS, min(tasks, most_tasks or tasks))
    try:  # a query keeps the settings it is started with
        query = writer.start()
    finally:
        spark.conf.set(PARTITIONS, tasks)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
