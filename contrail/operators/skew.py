"""Joins and ranks that stay balanced when a few keys own most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

# A key is hot when it holds at least this share of the rows, so at most
# 1 / HOT_SHARE keys can be hot and their list always fits a broadcast.
HOT_SHARE = 1.0 / 256
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding at least ``share`` of all rows (never more than 1/share of them)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_t")).select((F.col("_t") * share).alias("_t"))
    return counts.where(F.col("_n") >= F.greatest(total.scalar(), F.lit(1000.0))).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS,
                share: float = HOT_SHARE) -> DataFrame:
    """Equi-join on ``keys`` (inner or left) with hot keys of the left side spread.

    Left rows of a hot key get one of ``salts`` salts by a hash of the row; the
    matching right rows are copied once per salt.  All other rows use salt 0 and
    are not copied.
    """
    keys = list(keys)
    hot = F.broadcast(hot_keys(left, keys, share).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    lhs = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    rhs = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return lhs.join(rhs, [*keys, "_salt"], how).drop("_salt")


def exact_rank(
    df: DataFrame, groups: Sequence[str], value: str, picks: dict[str, Column], bucket: float, weight: str | None = None,
) -> DataFrame:
    """The value at given 0-based ranks of each group, exactly, in two steps.

    ``weight`` names a
    column of multiplicities.  ``picks`` maps an output name to a rank as a function of the group size
    (Column ``_total``).  A histogram of ``value / bucket`` finds the bucket that
    holds each rank; only values of that bucket are ranked.  Both steps count
    distinct values after map-side combining, so no task sees a group's raw rows.
    """
    groups, counts = list(groups), "_times"
    each = F.count(F.lit(1)) if weight is None else F.sum(weight)
    vals = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(each.alias(counts))
    # the histogram and the ranks both read them
    vals = stage(vals.withColumn("_bk", F.floor(F.col(value) / F.lit(float(bucket)))), "values")
    hist = vals.groupBy(*groups, "_bk").agg(F.sum(counts).alias("_c"))
    w = Window.partitionBy(*groups).orderBy("_bk")
    hist = (
        hist.withColumn("_below", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_below", F.coalesce("_below", F.lit(0)))
        .withColumn("_total", F.sum("_c").over(Window.partitionBy(*groups)))
    )
    ranks = F.array(*[F.struct(F.lit(n).alias("pick"), r.cast("bigint").alias("rank")) for n, r in picks.items()])
    wanted = hist.select("*", F.explode(ranks).alias("_p")).where(
        (F.col("_p.rank") >= F.col("_below")) & (F.col("_p.rank") < F.col("_below") + F.col("_c"))
    ).select(*groups, "_bk", "_below", "_total", F.col("_p.pick").alias("pick"), F.col("_p.rank").alias("rank"))
    inside = Window.partitionBy(*groups, "_bk", "pick").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = vals.join(wanted, [*groups, "_bk"]).withColumn("_upto", F.col("_below") + F.sum(counts).over(inside))
    hit = (F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col(counts) <= F.col("rank"))
    return ranked.where(hit).groupBy(*groups).agg(
        F.max("_total").alias("n"),
        *[F.max(F.when(F.col("pick") == n, F.col(value))).alias(n) for n in picks],
    )


# Largest dimension that is copied to every executor, as text.
DIMENSION_BYTES = 32 << 20


def dimension_join(left: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a dimension on ``keys``: broadcast when its measured size is within
    ``DIMENSION_BYTES``, else a salted shuffle join.

    Bytes are measured, not rows: a row may hold a whole polygon.
    """
    size = dim.select(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))).first()[0] or 0
    if size <= DIMENSION_BYTES:
        return left.join(F.broadcast(dim), list(keys), how)
    return salted_join(left, dim, keys, how)
