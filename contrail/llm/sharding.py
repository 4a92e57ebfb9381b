"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands on the ring at many points; a row goes to the first point clockwise from the
hash of its key. A shard takes no more than its bound: what overflows continues clockwise to the
next point of a shard with room. Points and keys keep their places when shards are added, so few
rows move, and the bounds say how even the shards are whatever keys repeat.

Rows of one arc (the stretch of ring before a point) are alike until their order decides who
overflows. So the bounds are kept by counting: loads are summed for each arc on the map side, the
overflow is worked out on the points alone, whose number doesn't grow with the rows, and rows find
their shard by their place in the arc. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contrail.session import stage

#: Places on the ring are numbers below 2 ** RING_BITS; a bucket of the look-up holds those that share BUCKET_BITS.
RING_BITS, BUCKET_BITS = 52, 14
#: Rounds of overflow worked out in one job.
ROUNDS = 6
MEASURES = ("rows", "bytes")
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def place(key: Column) -> Column:
    """Where a string stands on the ring: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, replicas: int, seed: str = "ring") -> DataFrame:
    """``idx, pos, shard``: the points in the order of the ring, ``replicas`` of each shard."""
    points = spark.range(shards * replicas).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("_replica"))
    points = points.withColumn("pos", place(F.concat_ws(":", F.lit(seed), "shard", "_replica")))
    return points.select((F.row_number().over(Window.orderBy("pos", "shard")) - 1).alias("idx"), "pos", "shard")


def _buckets(points: DataFrame) -> DataFrame:
    """``_bucket, _ends``: the arcs that reach into each bucket, as (last place, idx) in order. Places
    behind the last point belong to the arc of the first."""
    shift = RING_BITS - BUCKET_BITS
    order = Window.orderBy("idx")
    arcs = points.select("idx", "pos", (F.coalesce(F.lag("pos").over(order), F.lit(-1)) + 1).alias("_from"))
    behind = points.agg((F.max("pos") + 1).alias("_from")).select(F.lit(0).cast("int").alias("idx"), F.lit((1 << RING_BITS) - 1).alias("pos"), "_from")
    arcs = arcs.unionByName(behind).where(F.col("_from") <= F.col("pos"))
    each = arcs.withColumn("_bucket", F.explode(F.sequence(F.shiftright("_from", shift), F.shiftright("pos", shift))))
    return each.groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("_ends"))


def flows(points: DataFrame, loads: DataFrame, shards: int, slack: float) -> DataFrame:
    """``idx, total, flow``: how the load of each arc is dealt, ``flow`` being (shard, amount) in the
    order of the rows.

    In a round every arc offers what it has left to the next point clockwise whose shard has room;
    a shard takes from the nearest arcs first, up to its room. A round ends with nothing left or
    with one shard more that is full, so there are at most as many rounds as shards. ``loads`` has a
    row for each arc at most, so the whole of it is small and sits in one partition.
    """
    pool = points.join(loads, "idx", "left").withColumn("_left", F.coalesce("_load", F.lit(0)).cast("long")).drop("_load")
    line, every = Window.orderBy("idx"), Window.partitionBy()
    pool = pool.withColumn("idx", F.row_number().over(line) - 1).withColumn("total", F.sum("_left").over(every))  # one partition from here on
    if slack:
        bound = F.ceil(F.col("total") * (1 + slack) / shards)
    else:  # the bounds add up to the load itself
        bound = F.floor(F.col("total") / shards) + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0)
    pool = pool.withColumn("_room", bound.cast("long")).withColumn("flow", F.array().cast("array<struct<shard:int,amount:bigint>>"))
    number = F.count(F.lit(1)).over(every)
    onwards = Window.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        for _ in range(ROUNDS):
            open_here = F.when(F.col("_room") > 0, F.struct("idx", "shard", "_room"))
            pool = pool.withColumn("_to", F.coalesce(F.last(open_here, True).over(onwards), F.min(open_here).over(every)))
            pool = pool.withColumn("_way", F.pmod(F.col("_to.idx") - F.col("idx"), number))
            mine = Window.partitionBy("_to.shard")
            before = F.sum("_left").over(mine.orderBy("_way", "idx").rowsBetween(Window.unboundedPreceding, -1))
            pool = pool.withColumn("_goes", F.greatest(F.lit(0), F.least(F.col("_left"), F.col("_to._room") - F.coalesce(before, F.lit(0)))))
            # where all are full there is no target, and nothing left that needs one
            used = F.struct(F.coalesce("_to.shard", F.lit(-1)).alias("shard"), F.coalesce(F.sum("_goes").over(mine), F.lit(0)).alias("n"))
            given = F.map_from_entries(F.collect_set(used).over(every))
            pool = pool.withColumns({
                "flow": F.when(F.col("_goes") > 0, F.concat("flow", F.array(F.struct(F.col("_to.shard").alias("shard"), F.col("_goes").alias("amount"))))).otherwise(F.col("flow")),
                "_room": F.col("_room") - F.coalesce(F.element_at(given, F.col("shard")), F.lit(0)),
                "_left": F.col("_left") - F.coalesce("_goes", F.lit(0))})
        pool = stage(pool.select("idx", "shard", "total", "_left", "_room", "flow"), "ring-flows").coalesce(1)
        if pool.where("_left > 0").isEmpty():
            return pool.select("idx", "total", "flow")


def ring_shards(
    docs: DataFrame, shards: int, replicas: int = 256, measure: str = "rows", slack: float = 0.0,
    id_col: str = "doc_id", text_col: str = "text", extra: int = 16, seed: str = "ring",
) -> DataFrame:
    """The shard of every row, and its slot there.

    Returns one row per input row: ``id, size, text_crc32, shard, slot, home``. ``size`` is the
    text's UTF-8 bytes and ``extra``; ``home`` is the shard that the ring alone would name, other
    than ``shard`` where that was full. ``slot`` counts a shard's rows from 0 without gaps.

    * ``measure`` rows: a shard holds at most ``(1 + slack) * rows / shards`` rows, rounded up;
      without slack all shards are exactly full, and counts differ by one at most.
      ``measure`` bytes: the same of sizes, beyond which a shard can go by a part of one row for
      each stretch of the ring that it takes rows from.
    * The key is the id. Null ids are one key; rows that repeat an id stand at one place on the
      ring, and as many of them as a shard can't take continue clockwise, like others. So one key
      may have any share of the rows. Rows of a place go by size, checksum and row.
    * Null and empty texts have ``extra`` bytes and checksum 0. Texts of any length are read once
      and not shuffled. Rows alike in id, size and checksum may trade slots in a rerun with
      other file splits; all else is the same in every run.
    * An empty table gives an empty result; other columns are not read.
    """
    if measure not in MEASURES or slack < 0 or shards < 1:
        raise ValueError(f"measure is one of {MEASURES}, slack at least 0, shards at least 1")
    spark = docs.sparkSession
    points = stage(ring(spark, shards, replicas, seed), "ring-points")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + extra).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
        F.monotonically_increasing_id().alias("_row"), place(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("_pos"))
    # the look-up has one row for each bucket of the ring, whatever the input
    rows = rows.withColumn("_bucket", F.shiftright("_pos", RING_BITS - BUCKET_BITS)).join(F.broadcast(_buckets(points)), "_bucket")
    arc = F.element_at(F.filter("_ends", lambda e: e["pos"] >= F.col("_pos")), 1)["idx"]
    load = F.lit(1).cast("long") if measure == "rows" else F.col("_size")
    rows = stage(rows.select("_id", "_size", "_crc", "_row", "_pos", arc.alias("_arc"), load.alias("_load")), "ring-rows")
    dealt = flows(points, rows.groupBy(F.col("_arc").alias("idx")).agg(F.sum("_load").alias("_load")), shards, slack)

    # Ranges of the rows in the order of the ring: sampled borders end with the row, so a key of any
    # share is split. The number of a row in its range comes with the sort.
    order = ["_arc", "_pos", F.col("_id").asc_nulls_last(), "_size", "_crc", "_row"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    ranges = stage(ranges.withColumn("_range", F.shiftright("_n", 33)).drop("_pos", "_row"), "ring-ranges")
    cell = ["_arc", "_range"]
    cells = ranges.groupBy(*cell).agg(F.sum("_load").alias("_sum"), F.min("_n").alias("_first"))
    below = F.sum("_sum").over(Window.partitionBy("_arc").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_below", F.coalesce(below, F.lit(0)))
    cells = stage(cells.join(dealt.select(F.col("idx").alias("_arc"), "flow"), "_arc").join(points.select(F.col("idx").alias("_arc"), F.col("shard").alias("home")), "_arc"), "ring-cells")
    full = ranges.join(cells.drop("_sum"), cell)
    if measure == "rows":
        inside = F.col("_n") - F.col("_first")
    else:
        inside = F.coalesce(F.sum("_load").over(Window.partitionBy(*cell).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = full.withColumn("_at", F.col("_below") + inside)
    # the flow whose part of the arc holds the place of the row
    found = F.aggregate(
        "flow", F.struct(F.lit(-1).alias("shard"), F.lit(0).cast("long").alias("end")),
        lambda s, f: F.when(s["end"] > F.col("_at"), s).otherwise(F.struct(f["shard"].alias("shard"), (s["end"] + f["amount"]).alias("end"))))
    full = full.withColumn("_shard", found["shard"])
    pieces = full.groupBy("_shard", *cell).agg(F.count(F.lit(1)).alias("_rows"), F.min("_n").alias("_start"))
    offset = F.sum("_rows").over(Window.partitionBy("_shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1))
    pieces = stage(pieces.withColumn("_offset", F.coalesce(offset, F.lit(0))).drop("_rows"), "ring-pieces")
    out = full.join(pieces, ["_shard", *cell])
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"),
        (F.col("_offset") + F.col("_n") - F.col("_start")).alias("slot"), "home")
