"""Exact deduplication by sorting contents.

Sampled splitters range-partition the normalised texts, an external sort puts equal texts
side by side, and each text is compared in full with its neighbour. The range key ends with
the tie order of the rows, so copies of one text may span any number of partitions; runs
that touch a partition's border are joined from one small row per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.session import stage

from .common import SPACES

#: Characters of a text that a splitter holds; further ones are represented by a hash.
SPLITTER_CHARS = 32


def squeezed(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts in a sorted partition."""
    part, run, last, sha, lead = TaskContext.get().partitionId(), -1, None, "", None
    for batch in batches:
        norm, ids = batch.column(0), batch.column(1)
        runs, shas, leads, firsts = [], [], [], []
        for text, doc in zip(norm, ids.to_pylist()):
            text = text.as_buffer().to_pybytes()
            firsts.append(text != last)
            if text != last:
                run, last, sha, lead = run + 1, text, hashlib.sha256(text).hexdigest(), doc
            runs.append(run)
            shas.append(sha)
            leads.append(lead)
        n = len(runs)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(firsts, pa.bool_()), pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()), pa.array(leads, ids.type), pa.array(shas, pa.string())],
            names=["_id", "_begins", "_part", "_run", "_lead", "_sha"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal after deleting ASCII white space.

    Returns one row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    * Of equal texts the row with the most code points stays, then the smallest id; null
      ids come last. Null and empty texts are equal to each other.
    * Rows that repeat an id are members of their own: each counts in ``group_size``, and of
      those that bear the kept id with the longest text one is marked ``kept``, so every group
      has exactly one kept row. The id may be a struct, compared field by field.
    * An empty table gives an empty result; other columns of ``docs`` are not read.

    A text is shuffled once. Range borders are cut by its first characters and its SHA-256, and across
    them texts are compared by SHA-256.
    """
    rows = docs.select(squeezed(F.col(text_col)).alias("_norm"), F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_chars"))
    order = [F.col("_head"), F.col("_hash"), F.col("_norm"), F.col("_chars").desc(), F.col("_id").asc_nulls_last()]
    keyed = rows.withColumns({"_head": F.substring("_norm", 1, SPLITTER_CHARS), "_hash": F.sha2(F.col("_norm").cast("binary"), 256)})
    spread = keyed.repartitionByRange(*[x for i, x in enumerate(order) if i != 2]).sortWithinPartitions(*order)
    kind = docs.schema[id_col].dataType.simpleString()
    found = spread.select(F.col("_norm").cast("binary"), "_id").mapInArrow(
        _neighbours, f"_id {kind}, _begins boolean, _part int, _run bigint, _lead {kind}, _sha string")
    members = stage(found, "exact-members")

    runs = members.groupBy("_part", "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_sha").alias("_sha"), F.max("_lead").alias("_lead"))
    runs = runs.select("*", F.col("_part").alias("_rpart"), F.col("_run").alias("_rrun"))
    # One row per partition: its first and last run. A first run that continues the partition
    # before belongs to the last run that began anew.
    ends = members.groupBy("_part").agg(F.min_by("_sha", "_run").alias("_first"), F.max_by("_sha", "_run").alias("_last"), F.max("_run").alias("_end"))
    before = Window.orderBy("_part")
    ends = ends.withColumn("_goes_on", F.coalesce(F.lag("_last").over(before) == F.col("_first"), F.lit(False)))
    anew = F.when(~(F.col("_goes_on") & (F.col("_end") == 0)), F.struct("_part", "_end"))
    root = F.last(anew, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    links = ends.withColumn("_root", root).where("_goes_on").select(
        "_part", F.lit(0).cast("bigint").alias("_run"), F.col("_root._part").alias("_tpart"), F.col("_root._end").alias("_trun"))
    runs = runs.join(links, ["_part", "_run"], "left")
    runs = runs.withColumns({"_rpart": F.coalesce("_tpart", "_rpart"), "_rrun": F.coalesce("_trun", "_rrun")}).drop("_tpart", "_trun")
    touched = links.select("_tpart", "_trun").distinct()
    chained = runs.join(touched, (F.col("_rpart") == F.col("_tpart")) & (F.col("_rrun") == F.col("_trun")), "left_semi")
    heads = chained.groupBy("_rpart", "_rrun").agg(
        F.sum("_n").alias("_size"), F.min_by("_lead", F.struct("_part", "_run")).alias("_keep"))
    runs = runs.join(heads, ["_rpart", "_rrun"], "left").select(
        "_part", "_run", F.coalesce("_size", "_n").alias("_size"), F.when(F.col("_size").isNull(), F.col("_lead")).otherwise(F.col("_keep")).alias("_keep"),
        ((F.col("_part") == F.col("_rpart")) & (F.col("_run") == F.col("_rrun"))).alias("_anew"))
    out = members.join(runs, ["_part", "_run"])
    return out.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_begins") & F.col("_anew")).alias("kept"), F.col("_sha").alias("text_sha256"))
