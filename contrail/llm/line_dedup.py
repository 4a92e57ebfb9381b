"""Line deduplication: explode normalised lines, hash them, count documents, drop, reassemble.

Built-in functions only. Lines are never shuffled, only their 16-byte hashes; texts move
once, to meet the positions their documents lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.session import stage

from .common import SPACES, ascii_lower


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _two_hashes(value: Column) -> list[Column]:
    return [F.xxhash64(value).alias("_h1"), F.xxhash64(F.lit("second"), value).alias("_h2")]


def _kept_lines(lines: Column, gone: Column) -> Column:
    """Lines whose position is not in the sorted array ``gone``, which ends with the number of lines."""
    before = lambda i: F.coalesce(F.get(gone, i - 1), F.lit(-1))
    runs = F.transform(gone, lambda x, i: F.slice(lines, before(i) + 2, x - before(i) - 1))
    return F.array_join(F.flatten(runs), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines that ``min_docs`` documents or more hold, except in the smallest id.

    Returns ``id, text, n_lines, n_dropped``, one row per input row.

    * A line ends at ``\\n``; its key is the line stripped of ASCII white space at both
      ends and with A-Z in lower case. Keys under ``min_chars`` code points always stay.
    * Null and empty texts are one empty line; the returned text is then empty.
    * Rows that repeat an id are one document: a line they share counts once, and stays in
      each of them when their id is the smallest.
    * A null id is a document of its own, after all others.
    * An empty table gives an empty result; other columns of ``docs`` are not read.

    The hashes of a key make 128 bits. Hot lines are combined before the shuffle, and the
    join with the dropped keys is a plain shuffle join that adaptive execution splits.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lines = F.split(F.col("_text"), "\n", -1)
    mark = F.xxhash64("_text").alias("_mark")  # rows of one id with unequal texts stay apart
    each = base.select("_id", mark, F.posexplode(lines).alias("_pos", "_line")).select("_id", "_mark", "_pos", line_key(F.col("_line")).alias("_key"))
    each = each.where(F.length("_key") >= min_chars).select("_id", "_mark", "_pos", *_two_hashes(F.col("_key")))
    if min_docs == 2:  # two documents at least: the smallest and the largest id differ
        counts = each.groupBy("_h1", "_h2").agg(
            F.min("_id").alias("_keep"), F.max("_id").alias("_last"), F.max(F.col("_id").isNull().cast("int")).alias("_null"))
        shared = counts.where((F.col("_keep") != F.col("_last")) | ((F.col("_null") == 1) & F.col("_keep").isNotNull()))
    else:
        counts = each.select("_h1", "_h2", "_id").distinct().groupBy("_h1", "_h2").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        shared = counts.where(F.col("_n") >= min_docs)
    # Written first, so that adaptive execution sees two plain shuffles and can split a hot line.
    shared = stage(shared.select("_h1", "_h2", "_keep"), "shared-lines")
    gone = each.join(shared, ["_h1", "_h2"]).where(~F.col("_id").eqNullSafe(F.col("_keep")))
    gone = gone.groupBy("_id", "_mark").agg(F.collect_set("_pos").alias("_gone")).select(F.col("_id").alias("_gid"), F.col("_mark").alias("_gmark"), "_gone")
    full = base.withColumn("_mark", mark).join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_mark") == F.col("_gmark")), "left")
    full = full.withColumn("_ends", F.concat(F.array_sort("_gone"), F.array(F.size(lines))))
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(_kept_lines(lines, F.col("_ends")))
    return full.select(
        F.col("_id").alias(id_col), kept.alias(text_col), F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"))
