"""Ordered computations that never hold a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(time)`` sends every row of a key to one
task.  When one key owns a third of the input that task decides the runtime.
The functions here cut each key's time axis into fixed slices and work in two
levels:

1. window functions inside (key, slice): this is the wide shuffle, and a hot key
   spreads over as many tasks as it has slices;
2. one summary row per (key, slice): a window over those rows gives every slice
   what it needs to know of the slices around it, and a join on (key, slice)
   brings it back.

The summary has one row per slice, so a key costs (time span / width) rows at
level 2 however many reports it has.  The join reuses the partitioning of level
1, so the wide side is shuffled once; AQE turns it into a broadcast join when the
measured summary is small.  Keys must not be null.

An order over all rows has no key: ``ranged`` cuts it at sampled borders instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

HOUR = 3600.0
DAY = 86400.0
# Default slice: ten minutes.  One aircraft sends about a thousand reports in it.
SLICE_S = 600.0
SLICE = "_slice"
RANGE = "_range"
# Rows one task should order at most.
SLICE_ROWS = 2_000_000


def _epoch(df: DataFrame, time: str) -> Column:
    if dict(df.dtypes)[time] in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    return F.col(time).cast("double")


def sliced(df: DataFrame, time: str, width: float) -> DataFrame:
    return df.withColumn(SLICE, F.floor(_epoch(df, time) / F.lit(float(width))))


def fitted_width(df: DataFrame, keys: Sequence[str], time: str, width: float = SLICE_S, rows: int = SLICE_ROWS) -> float:
    """A slice width at which no (key, slice) exceeds about ``rows`` rows.

    Counts the rows per slice (combined on the map side) and narrows the width by
    the excess of the fullest one.
    """
    counts = sliced(df, time, width).groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("n"))
    fullest = counts.agg(F.max("n")).first()[0] or 0
    return width if fullest <= rows else max(width * rows / fullest, 1.0)


def _join_back(local: DataFrame, carry: DataFrame, part: list[str]) -> DataFrame:
    cond = None
    right = carry
    for c in part:
        right = right.withColumnRenamed(c, f"_c_{c}")
        term = F.col(c) == F.col(f"_c_{c}")
        cond = term if cond is None else cond & term
    return local.join(right, cond, "left").drop(*[f"_c_{c}" for c in part])


def timeline(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    order: Sequence[str] = (),
    lag: Sequence[str] = (),
    depth: int = 1,
    gap: float | None = None,
    end: str | None = None,
    following: bool = False,
    width: float = SLICE_S,
) -> DataFrame:
    """Add the ``depth`` previous rows of the same key, and session numbers.

    Adds ``prev1 .. prevN`` (struct of time, ``lag`` columns; null before the
    first row).  With ``gap``, ``session_no`` counts from 1 and grows when
    ``time - prev1.end > gap``.  With ``following``, ``next_time`` is the time of
    the next row.
    """
    keys = list(keys)
    part = [*keys, SLICE]
    end = end or time
    base = sliced(df, time, width)
    w = Window.partitionBy(*part).orderBy(time, *order)
    fields = list(dict.fromkeys([time, end, *lag]))
    record = F.struct(*fields)

    local = base.withColumn("_rn", F.row_number().over(w))
    for i in range(1, depth + 1):
        local = local.withColumn(f"_l{i}", F.lag(record, i).over(w))
    local = local.withColumn("_lead", F.lead(F.col(time)).over(w)) if following else local
    secs = "double" if dict(df.dtypes)[time] not in ("timestamp", "timestamp_ntz") else None

    def num(c: Column) -> Column:
        return c.cast("double") if secs else F.unix_micros(c.cast("timestamp")) / 1e6

    if gap is not None:
        local = local.withColumn(
            "_brk", F.when(num(F.col(time)) - num(F.col(f"_l1.{end}")) > gap, 1).otherwise(0))

    # one row per slice; the tail holds its last rows, newest first
    tail = F.array(record, *[F.col(f"_l{i}") for i in range(1, depth)])
    summary = local.groupBy(*part).agg(
        F.max_by(tail, F.col("_rn")).alias("_tail"),
        F.min(time).alias("_t0"),
        (F.sum("_brk") if gap is not None else F.lit(0)).alias("_nb"),
    )
    by_key = Window.partitionBy(*keys).orderBy(SLICE)
    before = by_key.rowsBetween(-depth, -1)
    carry = summary.withColumn(
        "_carry",
        F.filter(F.flatten(F.reverse(F.collect_list("_tail").over(before))), lambda r: r.isNotNull()),
    )
    if following:
        carry = carry.withColumn("_lead0", F.lead("_t0").over(by_key))
    if gap is not None:
        edge = F.when(num(F.col("_t0")) - num(F.get("_carry", F.lit(0))[end]) > gap, 1).otherwise(0)
        carry = carry.withColumn("_edge", edge).withColumn(
            "_base",
            F.sum(F.col("_nb") + F.col("_edge")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_nb"),
        )
    keep = [*part, "_carry"] + (["_lead0"] if following else []) + (["_base"] if gap is not None else [])
    if gap is not None:
        local = local.withColumn("_cum", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = _join_back(local, carry.select(*keep), part)
    for i in range(1, depth + 1):
        out = out.withColumn(
            f"prev{i}",
            F.when(F.col("_rn") > i, F.col(f"_l{i}")).otherwise(F.get("_carry", F.lit(i) - F.col("_rn"))))
    if gap is not None:
        out = out.withColumn("session_no", (F.col("_base") + F.col("_cum") + 1).cast("bigint"))
    if following:
        out = out.withColumn("next_time", F.coalesce("_lead", "_lead0"))
    drop = [SLICE, "_rn", "_carry", "_lead", "_lead0", "_brk", "_cum", "_base"] + [f"_l{i}" for i in range(1, depth + 1)]
    return out.drop(*drop)


def running(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    inclusive: bool = True,
    width: float = SLICE_S,
) -> DataFrame:
    """Prefix sums and nearest non-null values before (or after) each row.

    ``sums`` and ``lasts`` look back, ``nexts`` looks ahead.  ``inclusive`` says
    whether the row itself counts.  An empty key list gives a global prefix.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    keys = list(keys)
    part = [*keys, SLICE]
    base = sliced(df, time, width)
    for name, expr in {**sums, **lasts, **nexts}.items():
        base = base.withColumn(f"_x_{name}", expr)
    w = Window.partitionBy(*part).orderBy(time, *order)
    back = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    # looking ahead is looking back in the opposite order: a frame that only grows at
    # its end costs one step a row, one that shrinks at its start the whole rest
    falling = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in (time, *order)])
    ahead = falling.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    position = F.struct(time, *order)
    aggs = [F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums]
    aggs += [F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), position)).alias(f"_s_{n}") for n in lasts]
    aggs += [F.min_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), position)).alias(f"_s_{n}") for n in nexts]
    summary = base.groupBy(*part).agg(*aggs)
    by_key = Window.partitionBy(*keys).orderBy(SLICE)
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *part,
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_b_{n}") for n in sums],
        *[F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in lasts],
        *[F.last(f"_s_{n}", ignorenulls=True).over(later).alias(f"_b_{n}") for n in nexts],
    )
    local = base
    for n in sums:
        local = local.withColumn(f"_w_{n}", F.sum(f"_x_{n}").over(back))
    for n in lasts:
        local = local.withColumn(f"_w_{n}", F.last(f"_x_{n}", ignorenulls=True).over(back))
    for n in nexts:
        local = local.withColumn(f"_w_{n}", F.last(f"_x_{n}", ignorenulls=True).over(ahead))
    out = _join_back(local, carry, part)
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.col(f"_w_{n}"), F.lit(0)) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)))
    for n in [*lasts, *nexts]:
        out = out.withColumn(n, F.coalesce(f"_w_{n}", f"_b_{n}"))
    names = [*sums, *lasts, *nexts]
    return out.drop(SLICE, *[f"_{p}_{n}" for n in names for p in "xwb"])


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows written in even ranges of ``order``: ``_range`` numbers the ranges, ``_at`` a range's rows from 0.

    The borders are quantiles of a bounded sample, so a stray value widens no range, and they end
    with the row as it is read, so rows with equal values are split as well.
    """
    names = list(order)
    read = df.withColumn("_row", F.monotonically_increasing_id())
    placed = read.repartitionByRange(*names, "_row").sortWithinPartitions(*names, "_row").withColumn("_n", F.monotonically_increasing_id())
    # the upper bits of a row's number are its partition's
    placed = placed.withColumn(RANGE, F.shiftright("_n", 33)).withColumn("_at", F.col("_n") - F.shiftleft(RANGE, 33))
    return stage(placed.drop("_row", "_n"), "ranges")


def prefixed(df: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over all rows up to each one, it included, in ``order``: within its range, and one row for each range before."""
    rows = ranged(df, order).withColumns({f"_x_{n}": v for n, v in sums.items()})
    inside = Window.partitionBy(RANGE).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(RANGE).agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums])
    totals = totals.select(RANGE, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    out = rows.withColumns({n: F.sum(f"_x_{n}").over(inside) for n in sums}).join(totals, RANGE)
    out = out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums})
    return out.drop(RANGE, "_at", *[f"_{p}_{n}" for n in sums for p in "xb"])


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Global 0-based row numbers in ``order``, without a window over rows: a row's place in its range and the
    sizes of the ranges before."""
    rows = ranged(df, order)
    before = F.sum("_rows").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_rows")).select(RANGE, F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(sizes, RANGE).withColumn(name, F.col("_before") + F.col("_at")).drop(RANGE, "_at", "_before")
