"""Mixing sources to target weights by weighted sampling with exponential keys.

Every document draws ``-ln(u) / quality`` (Efraimidis and Spirakis): sorting by it draws
without replacement, better documents earlier. Within a source, documents are taken in that
order until the source's budget of words is spent; a budget above the source's size buys
complete epochs first and the fraction that is left afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.session import stage

from .common import WORD

#: Marks of noise; a document's quality is one less its marks per word.
NOISE = r"[#$%&*|!]+"
LEAST_QUALITY = 0.1
#: The source of rows without one needs a name inside joins; it cannot clash, a flag stands beside it.
_NONE = ""


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    marks = F.coalesce(F.regexp_count(text, F.lit(NOISE)), F.lit(0))
    return F.greatest(F.lit(LEAST_QUALITY), F.when(size > 0, 1 - marks.cast("double") / size).otherwise(F.lit(1.0)))


def uniform(key: Column, seed: str) -> Column:
    """52 bits of MD5 of the seed and the key, inside (0, 1); the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Water filling: ``source, size -> target``, one row per source.

    Sources in code point order (null last) get the repeating ``weights`` and share ``share``
    times all words; nobody gets more than ``most`` times its size, and what a full source
    leaves goes to the others by weight. The level is found in closed form: in the order of
    ``most * size / weight`` the full sources are a prefix.
    """
    by_name = Window.orderBy(F.col("_none"), F.col("_source"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("_w", F.get(kinds, (F.row_number().over(by_name) - 1) % len(weights)))
    w = w.withColumn("_cap", F.col("_size").cast("double") * most).withColumn("_fill", F.col("_cap") / F.col("_w"))
    by_fill = Window.orderBy("_fill", "_none", "_source")
    upto, every = by_fill.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    w = w.withColumns({
        "_full": F.sum("_cap").over(upto), "_rest": F.sum("_w").over(every) - F.sum("_w").over(upto),
        "_total": F.sum("_size").over(every).cast("double") * share})
    # The words poured at a level are a concave function, and each number of full sources gives
    # a line above it; so the level is the highest at which one of the lines meets the total.
    lines = F.max(F.when(F.col("_rest") > 0, (F.col("_total") - F.col("_full")) / F.col("_rest"))).over(every)
    level = F.greatest(F.col("_total") / F.sum("_w").over(every), lines)
    full = F.col("_total") >= F.sum("_cap").over(every)
    return w.withColumn("_target", F.when(full, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * level))).select(
        "_none", "_source", F.col("_size").alias("_source_size"), F.col("_target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    row_col: str | None = None,
) -> DataFrame:
    """How many words of every document a mix takes.

    Returns one row per input row: ``id, source, size, source_size, target, taken, quality``.

    * ``size`` counts runs of non-white-space; null and empty texts have none and give none.
    * ``taken = epochs * size`` plus the document's part in the last, fractional epoch: the
      document on which the budget ends gives the words that are left, later ones nothing.
      So the sum over a source is its target, rounded down.
    * Null sources are one source, the last. Rows that repeat an id and a text draw the same
      key and stand side by side; they count and are taken row by row.
    * Ties of the key go by id, nulls last. Reruns give the same result.
    * ``row_col`` names a column of unique row numbers: it comes first in the result, and says
      which of the rows that tie in key, id and size is taken first.
    * An empty table gives an empty result. Other columns are not read.

    Texts are read once and never shuffled. The prefix sums run in two levels, over ranges of
    the rows in order and inside each of them. Sampled splitters end with the row number, so
    ranges are even whatever the qualities, and equal keys are split: no task holds a source.
    """
    size = words(F.col(text_col))
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    base = docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_given"), F.col(source_col).isNull().alias("_none"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE)).alias("_source"), size.alias("_size"), quality(F.col(text_col), size).alias("_quality"))
    base = base.withColumn("_key", -F.log(uniform(F.col("_id"), seed)) / F.col("_quality"))
    base = stage(base, "mix-sizes")
    key = ["_none", "_source"]
    order = ["_key", F.col("_id").asc_nulls_last(), "_size", "_row"]
    ranges = stage(base.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    sizes = base.groupBy(*key).agg(F.sum("_size").alias("_size"))
    goal = targets(sizes, weights, share, most)
    spent = F.col("_target").cast("long")
    epochs = F.when(F.col("_source_size") > 0, F.floor(spent / F.col("_source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("_epochs", epochs).withColumn("_left", spent - F.col("_epochs") * F.col("_source_size"))
    # One row per source, written so that the join goes by its size: broadcast below the session's
    # threshold, else a shuffle join whose hot sources adaptive execution can split.
    goal = stage(goal, "mix-goals")
    full = ranges.join(goal, key)
    sums = ranges.groupBy(*key, "_range").agg(F.sum("_size").alias("_sum"))
    below = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_below", F.coalesce(F.sum("_sum").over(below), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = full.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(sums, [*key, "_range"])
    rest = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_left") - F.col("_below") - F.col("_inside")))
    return part.select(
        *[F.col("_row").alias(c) for c in [row_col] if c is not None], F.col("_id").alias(id_col), F.col("_given").alias(source_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_epochs") * F.col("_size") + rest).cast("long").alias("taken"), F.col("_quality").alias("quality"))
