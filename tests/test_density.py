"""Traffic density, pyramid and hotspot surface against plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from contrail.operators import density

SEGMENTS = "hex string, flight_no long, seq long, x0 long, y0 long, x1 long, y1 long, alt long"


def segments(n=300):
    pick, out = random.Random(4), []
    for i in range(n):
        x, y = 1000 + pick.randrange(900), 5000 + pick.randrange(900)
        far = 2500 if pick.random() < 0.03 else 60
        out.append((f"h{i % 7}", i % 3, i, x, y, x + pick.randint(-far, far), y + pick.randint(-far, far), 1000))
    return out + [("park", 1, n + k, 1100, 5100, 1100, 5100, 1000) for k in range(500)]


def drawn(rows, width=2):
    seen = {}
    for hex_, flight, _, x0, y0, x1, y1, _ in rows:
        n = max(abs(x1 - x0), abs(y1 - y0))
        for i in range(n + 1):
            u = i / n if n else 0.0
            x, y = math.floor(x0 + u * (x1 - x0) + 0.5), math.floor(y0 + u * (y1 - y0) + 0.5)
            for w in range(width):
                at = (x, y + w) if abs(x1 - x0) >= abs(y1 - y0) else (x + w, y)
                seen.setdefault(at, set()).add((hex_, flight))
    return {at: len(who) for at, who in seen.items()}


def test_density_of_shares_equals_plain_drawing(spark, monkeypatch):
    monkeypatch.setattr(density, "DRAW_ROWS", 20)  # busy tiles are drawn by many tasks
    monkeypatch.setattr(density, "DRAW_AT_ONCE", 7)
    rows = segments()
    got = {(r.tx * 256 + r.px, r.ty * 256 + r.py): r.cnt for r in density.traffic_density(spark.createDataFrame(rows, SEGMENTS), 11).collect()}
    assert got == drawn(rows)


def test_height_band_drops_whole_tiles_only(spark):
    rows = [("h", 1, 1, 300_000, 300_000, 300_900, 300_020, 900), ("h", 1, 2, 300_000, 300_100, 300_900, 300_120, 9_000)]
    z = 11
    tile = lambda k, x: density.tiles.tile_center(F.lit(x), F.lit(300_000 // 256), F.lit(float(z)))
    places = spark.range(5).select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("ident"), tile(0, 300_000 // 256 + F.col("id")).alias("c"), (F.col("id") % 2 * 5000).alias("elev"))
    airports = places.select("ordinal", "ident", "c.lat", "c.lon", "elev")
    got = density.traffic_density(spark.createDataFrame(rows, SEGMENTS), z, airports, 1000).collect()
    # 900 ft is in the band of the tiles at 0 ft, every second one, and 9000 ft in that of none
    assert {(r.tx - 300_000 // 256) % 2 for r in got} == {0} and {r.ty * 256 + r.py for r in got} <= set(range(300_000, 300_025))
    low = {at for at in drawn(rows[:1]) if (at[0] // 256 - 300_000 // 256) % 2 == 0}
    assert {(r.tx * 256 + r.px, r.ty * 256 + r.py) for r in got} == low


def test_a_jump_is_copied_to_the_tiles_it_crosses(spark):
    jump = spark.createDataFrame([("h", 1, 1, 0, 0, 256 * 2000, 256 * 1500, 0)], SEGMENTS)
    assert density.segment_tiles(jump).count() <= 2000 + 1500 + 1


def test_pyramid_folds_are_the_single_steps(spark):
    pick = random.Random(6)
    px = spark.createDataFrame([(z, tx, ty, pick.randrange(256), pick.randrange(256), *(pick.randrange(256) for _ in range(4))) for z in (9,) for tx in range(6) for ty in range(5) for _ in range(60)],
                               "z int, tx long, ty long, px long, py long, r int, g int, b int, a int").dropDuplicates(["tx", "ty", "px", "py"]).cache()
    rows = lambda df: sorted(map(tuple, df.select("z", "tx", "ty", "px", "py", "r", "g", "b", "a").collect()))
    one = rows(density.pyramid(px, 9, 4, fold=1))
    assert one == rows(density.pyramid(px, 9, 4, fold=3)) == rows(density.pyramid(px, 9, 4, fold=5)) and {r[0] for r in one} == {8, 7, 6, 5, 4}


def test_hotspots_add_up_from_any_number_of_tasks(spark):
    rng = np.random.default_rng(2)
    pts = [(float(a), float(o)) for a, o in rng.normal((40, -119), (0.2, 0.3), (500, 2))]
    df = spark.createDataFrame(pts, "lat double, lon double")
    got = [{r.node: r.intensity for r in density.hotspots(df.repartition(n), grid=12).collect()} for n in (1, 9)]
    assert got[0].keys() == got[1].keys() and all(abs(got[0][k] - got[1][k]) < 1e-9 for k in got[0])
    lat, lon = np.array(pts).T
    f2 = 500 ** (-1 / 3)
    cov = np.cov(lat, lon) * f2
    grid = [np.linspace(v.min() - 0.1 * np.ptp(v), v.max() + 0.1 * np.ptp(v), 12) for v in (lat, lon)]
    inv = np.linalg.inv(cov)
    d = np.array([[np.exp(-0.5 * sum(inv[i, j] * a * b for i, a in enumerate((y - lat, x - lon)) for j, b in enumerate((y - lat, x - lon)))).sum() for x in grid[1]] for y in grid[0]]).ravel()
    scaled = (d - d.min()) / (d.max() - d.min() + 1e-10)
    assert all(abs(got[0][k] - v) < 1e-6 for k, v in enumerate(scaled) if k in got[0]) and {k for k, v in enumerate(scaled) if v > 0.1} == set(got[0])
