"""Pairs and airports far north, where a degree of longitude is short."""

import pytest
from pyspark.sql import functions as F

from contrail.operators.los import nearest_airports
from contrail.operators.proximity import near_pairs


@pytest.mark.parametrize("lat", [36.6, 60.5, 70.0, 80.0, -70.0])
@pytest.mark.parametrize("start", [0.001, 0.0385, 0.049])
def test_pairs_are_found_at_any_latitude(spark, lat, start):
    import math

    apart = 0.28 / 60 / math.cos(math.radians(lat))
    point = "struct<now:double,lat:double,lon:double,alt_baro:double,gs:double,track:double>"
    rows = [(t, t, i, 100, 100, (100.0, lat, lon, 1000.0, 0.0, 0.0), (100.0, lat, lon, 1000.0, 0.0, 0.0)) for i, (t, lon) in enumerate((("a", start), ("b", start + apart)))]
    pieces = spark.createDataFrame(rows, f"tail string, flight_id string, seq long, s0 long, s1 long, p {point}, q {point}")
    assert near_pairs(pieces, 0.3, 400.0).count() == 1


def test_airport_near_a_northern_point(spark):
    airports = spark.createDataFrame([(0, "PABR", 71.285, -156.766, 44.0)], "ordinal int, ident string, lat double, lon double, elev double")
    points = spark.createDataFrame([(1, 71.28, -156.766 + d) for d in (0.249, -0.249, 0.1)], "id int, lat double, lon double").withColumn("id", F.monotonically_increasing_id())
    assert nearest_airports(points, airports, ["id"], radius_nm=4.9).count() == 3
