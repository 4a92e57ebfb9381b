"""Small automata over each key's rows, run slice by slice and composed.

An automaton that reads a key's rows in order needs the state its first row meets.  Within a
slice (see ``timeline``) that state matters only up to the first row that sets it, so a slice is a
small map: where each state leads, and what it adds to a count.  The maps have one row per slice;
windows over those rows compose them and tell each slice the state it starts from.

The reports are shuffled once, by key and slice.  Whatever follows on the same rows
(``longest_runs``) partitions by the same columns and more, so it needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import SLICE, SLICE_S, _join_back, sliced

UNSET, NEAR, FAR = 0, 1, 2


def visits_and_pieces(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], near: Column, far: Column, gap: float, lag: Sequence[str] = (),
    width: float = SLICE_S,
) -> DataFrame:
    """Split each key's rows by silences and, within those, by going near and then far again.

    Adds ``visit`` (from 1, grows when the time since the row before exceeds ``gap``), ``piece``
    (from 0 in each visit, grows behind a row that is ``far`` when the last row before it that was
    either was ``near``; the row that cuts ends its piece) and ``before`` (``lag`` columns and time
    of the row before in the same piece, null on its first).  The slice stays as a column, and
    with it the partitioning by key and slice.  A null ``near`` or ``far`` counts as false.
    """
    keys = list(keys)
    part = [*keys, SLICE]
    w = Window.partitionBy(*part).orderBy(time, *order)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    record = F.struct(*dict.fromkeys([time, *lag]))
    late = lambda now, last: F.coalesce(now - last > gap, F.lit(False))
    mark = F.when(near, F.lit(NEAR)).when(far, F.lit(FAR))

    rows = sliced(df, time, width).withColumn("_mark", mark).withColumns({"_row": record, "_rn": F.row_number().over(w)})
    rows = rows.withColumn("_prev", F.lag("_row").over(w))
    rows = rows.withColumn("_brk", late(F.col(time), F.col(f"_prev.{time}")))
    # a silence sets the state, so does a mark; `_state` is null on rows that leave it as it is
    rows = rows.withColumn("_state", F.coalesce("_mark", F.when(F.col("_brk"), UNSET)))
    rows = rows.withColumn("_met", F.when(F.col("_brk"), UNSET).otherwise(F.last("_state", ignorenulls=True).over(earlier)))
    is_far = F.coalesce(F.col("_mark") == FAR, F.lit(False))
    rows = rows.withColumns({
        "_cut": F.when(is_far & (F.col("_met") == NEAR), 1).otherwise(0),
        # the one row of a slice whose cut hangs on the state the slice starts from
        "_open": F.when(is_far & F.col("_met").isNull(), 1).otherwise(0)})
    rows = rows.withColumns({
        "_breaks": F.sum(F.col("_brk").cast("int")).over(upto), "_cuts": F.coalesce(F.sum("_cut").over(earlier), F.lit(0)),
        "_opened": F.coalesce(F.max("_open").over(earlier), F.lit(0)),
        "_pcut": F.lag("_cut").over(w), "_popen": F.lag("_open").over(w)})
    rows = rows.withColumn("_since", F.last(F.when(F.col("_brk"), F.col("_cuts")), ignorenulls=True).over(upto))

    # the map of a slice: what it does to the state, how many cuts it adds, what it ends with
    maps = rows.groupBy(*part).agg(
        F.max_by("_row", "_rn").alias("_tail"), F.min(time).alias("_t0"), F.max("_breaks").alias("_nb"),
        F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("_rn"))).alias("_to"), F.max("_open").alias("_hangs"),
        (F.sum("_cut") - F.coalesce(F.max("_since"), F.lit(0))).alias("_adds"),
        F.max_by("_cut", "_rn").alias("_endcut"), F.max_by("_open", "_rn").alias("_endopen"))
    by_key = Window.partitionBy(*keys).orderBy(SLICE)
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
    maps = maps.withColumn("_back", F.lag("_tail").over(by_key))
    maps = maps.withColumn("_edge", late(F.col("_t0"), F.col(f"_back.{time}")))
    reached = F.last(F.coalesce("_to", F.when(F.col("_edge"), UNSET)), ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    maps = maps.withColumn("_from", F.when(F.col("_edge"), UNSET).otherwise(reached))
    maps = maps.withColumn("_extra", F.when((F.col("_hangs") == 1) & (F.col("_from") == NEAR), 1).otherwise(0))
    maps = maps.withColumns({
        "_adds": F.col("_adds") + F.when(F.col("_nb") == 0, F.col("_extra")).otherwise(0),
        "_first": F.sum(F.col("_nb") + F.col("_edge").cast("int")).over(so_far) - F.col("_nb") + 1,
        "_visit": F.sum(F.when(F.col("_edge") | (F.col("_nb") > 0), 1).otherwise(0)).over(so_far)})
    in_visit = Window.partitionBy(*keys, "_visit").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    maps = maps.withColumn("_run", F.sum("_adds").over(in_visit))
    ends_cut = (F.col("_endcut") == 1) | ((F.col("_endopen") == 1) & (F.col("_extra") == 1))
    maps = maps.withColumns({"_pieces": F.lag("_run").over(by_key), "_closed": F.lag(ends_cut).over(by_key)})
    maps = maps.select(
        *part, "_first", "_extra", F.when(F.col("_edge"), 0).otherwise(F.coalesce("_pieces", F.lit(0))).alias("_pieces"),
        F.when(~F.col("_edge") & ~F.coalesce("_closed", F.lit(False)), F.col("_back")).alias("_back"))

    out = _join_back(rows, maps, part)
    piece = F.when(F.col("_breaks") > 0, F.col("_cuts") - F.col("_since")).otherwise(
        F.col("_pieces") + F.col("_cuts") + F.col("_extra") * F.col("_opened"))
    behind_cut = (F.col("_pcut") == 1) | ((F.col("_popen") == 1) & (F.col("_extra") == 1))
    before = F.when(F.col("_rn") == 1, F.col("_back")).when(~F.col("_brk") & ~behind_cut, F.col("_prev"))
    return out.select(
        *df.columns, SLICE, (F.col("_first") + F.col("_breaks")).cast("bigint").alias("visit"), piece.cast("bigint").alias("piece"), before.alias("before"))


def longest_runs(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], ok: str, length: str) -> DataFrame:
    """Greatest sum of ``length`` over consecutive rows that are ``ok``, for each key (``run``; 0 when none is).

    ``df`` carries its slice.  A slice gives the run it begins with, the longest, the one it
    ends with, and whether all its rows are ok; a run that goes on over slices is the end of one,
    all of some, and the beginning of the last.
    """
    keys = list(keys)
    part = [*keys, SLICE]
    w = Window.partitionBy(*part).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_bad", F.when(F.col(ok), 0).otherwise(1)).withColumn("_no", F.sum("_bad").over(w))
    runs = rows.groupBy(*part, "_no").agg(F.sum(F.when(F.col("_bad") == 0, F.col(length)).otherwise(0.0)).alias("_len"))
    maps = runs.groupBy(*part).agg(
        F.max("_len").alias("_best"), F.sum(F.when(F.col("_no") == 0, F.col("_len")).otherwise(0.0)).alias("_head"),
        F.max("_no").alias("_bads"), F.max_by("_len", "_no").alias("_end"))
    by_key = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("_go", F.coalesce(F.sum(F.when(F.col("_bads") > 0, 1).otherwise(0)).over(by_key), F.lit(0)))
    run = lambda no, size: F.struct(no.alias("no"), F.col(size).alias("len"))
    ends = F.array(run(F.col("_go"), "_head"))
    ends = F.when(F.col("_bads") == 0, ends).otherwise(F.concat(ends, F.array(run(F.col("_go") + 1, "_end"))))
    joined = maps.select(*keys, "_best", F.explode(ends).alias("_r")).groupBy(*keys, "_r.no").agg(F.sum("_r.len").alias("_len"), F.max("_best").alias("_best"))
    return joined.groupBy(*keys).agg(F.max(F.greatest("_len", "_best")).alias("run"))
