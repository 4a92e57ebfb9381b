"""The two ways to assign regions agree, also on generated airport regions."""

import math
import random

from pyspark.sql import functions as F

from contrail.operators import regions
from contrail.plans import q_density
from contrail.plans import tables as t
from contrail.sources.dimensions import as_layers


def test_join_equals_inline_on_generated_regions(spark, sf):
    made = regions.airport_regions(q_density._field(spark, sf).where("ident < 'KH'"))
    made = made.withColumn("layer", F.lit(0)).withColumn("file", F.lit("f")).withColumn("idx", F.col("idx") + F.ascii(F.substring("ident", 2, 1)) * 4)
    layers = as_layers(made.select("layer", "file", "idx", "name", "min_alt", "max_alt", "hdg0", "hdg1", "ring"))
    p = t.positions(spark, sf)
    joined = {(r["seq"], r["inside"][0]) for r in regions.assign_join(p, made).collect()}
    inline = {(r["seq"], r["inside"][0]) for r in regions.assign_inline(p, layers).collect()}
    assert joined == inline and len({x for _, x in inline}) > 2


def test_too_many_inline_regions_are_refused(spark, sf):
    one = t.REGION_LAYERS[0][0]
    try:
        regions.assign_inline(t.positions(spark, sf), [[one] * 65])
    except ValueError as e:
        assert "assign_join" in str(e)
    else:
        raise AssertionError("expected an error")


def _blob(rnd, x, y, size, corners):
    """A ring around a place, its corners at uneven distances."""
    turn = sorted(rnd.random() * 2 * math.pi for _ in range(corners))
    return [(x + size * rnd.uniform(0.4, 1) * math.cos(a), y + size * rnd.uniform(0.4, 1) * math.sin(a)) for a in turn]


def _region(ring, idx, layer=0, **more):
    return {"name": f"r{layer} {idx}", "min_alt": 0, "max_alt": 5000, "hdg0": 0.0, "hdg1": 360.0, "ring": ring, **more}


def test_covers_of_any_size_equal_the_ring_test(spark):
    rnd = random.Random(5)
    sizes = [0.002, 0.05, 0.4, 3, 25, 60]
    layers = [[_region(_blob(rnd, rnd.uniform(-20, 20), rnd.uniform(-20, 20), sizes[i // 4], rnd.randint(3, 30)), i, k) for i in range(24)] for k in (0, 1)]
    layers[0].insert(0, _region([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)], 99))  # edges on cells' borders
    spots = [(rnd.uniform(-30, 30), rnd.uniform(-30, 30)) for _ in range(3000)]
    for layer in layers:
        for r in layer:
            x, y = r["ring"][0]
            spots += [(y + rnd.gauss(0, 0.01), x + rnd.gauss(0, 0.01)) for _ in range(20)] + [(y, x)]
    spots += [(i / 4, j / 4) for i in range(-2, 7) for j in range(-2, 7)]
    df = spark.createDataFrame([(i, la, lo, 1000, 90.0) for i, (la, lo) in enumerate(spots)] + [(-1, None, None, 1000, 90.0)],
                               "seq long, lat double, lon double, alt_baro long, track double")
    joined = {r["seq"]: r["inside"] for r in regions.assign_join(df, regions.region_table(spark, layers)).collect()}
    inline = {r["seq"]: r["inside"] for r in regions.assign_inline(df, layers).collect()}
    assert joined == inline and len({x for pair in joined.values() for x in pair}) > 20


def test_a_continent_makes_few_cells_and_most_need_no_ring(spark):
    rnd = random.Random(2)
    rings = [[(math.cos(i / 500 * 2 * math.pi) * 60 + 10, math.sin(i / 500 * 2 * math.pi) * 40) for i in range(500)],
             [(-180.0, -90.0), (-180.0, 90.0), (180.0, 90.0), (180.0, -90.0)], _blob(rnd, 0, 0, 14, 40), _blob(rnd, 3, 3, 0.9, 40), _blob(rnd, 5, 5, 1e-4, 5)]
    table = regions.region_table(spark, [[_region(ring, i) for i, ring in enumerate(rings)]])
    cover = regions.region_cover(table).groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("edges").isNull()).alias("inner"), F.max(F.size("edges")).alias("edges")).collect()
    n = {r["idx"]: r for r in cover}
    assert set(n) == set(range(5)) and all(r["n"] <= 900 for r in cover)
    assert n[0]["inner"] > 15 and n[0]["edges"] < 250 and n[4]["n"] <= 4


def test_no_regions_and_rings_without_points(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 100, 10.0)], "seq long, lat double, lon double, alt_baro long, track double")
    assert regions.assign_join(df, regions.region_table(spark, [[]])).collect()[0]["inside"] == [None]
    assert regions.assign_join(df, regions.region_table(spark, [[_region([], 0)]])).collect()[0]["inside"] == [None]
