"""Ring rules by the thousand: a grid equi-join instead of one predicate per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.skew import dimension_join

CELL_DEG = 1.0


def ring_cells(rules: DataFrame, cell: float = CELL_DEG) -> DataFrame:
    """``rules``: rule, radius_nm, lat, lon; one row per grid cell of each ring's box."""
    r = rules.withColumn("_b", geo.bounds("lat", "lon", F.col("radius_nm")))
    r = r.withColumn("cy", F.explode(F.sequence(F.floor(F.col("_b.south") / cell), F.floor(F.col("_b.north") / cell))))
    return r.withColumn("cx", F.explode(F.sequence(F.floor(F.col("_b.west") / cell), F.floor(F.col("_b.east") / cell)))).drop("_b")


def grid_stats(cells: DataFrame) -> DataFrame:
    n = cells.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("k"))
    return n.agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("k"), 4).alias("mean_rules"), F.max("k").alias("max_rules"), F.min("k").alias("min_rules"))


def match_rings(points: DataFrame, rules: DataFrame, cell: float = 0.25) -> DataFrame:
    """(point, rule) pairs inside a ring; a rule reaches only the points of its cells."""
    dim = ring_cells(rules, cell).select("cy", "cx", "rule", "radius_nm", F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    probe = points.withColumn("cy", F.floor(F.col("lat") / cell)).withColumn("cx", F.floor(F.col("lon") / cell))
    met = dimension_join(probe, dim, ["cy", "cx"])
    return met.where(geo.haversine_nm("lat", "lon", "_la", "_lo") <= F.col("radius_nm")).drop("cy", "cx", "_la", "_lo", "radius_nm")
