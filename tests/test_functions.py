import pytest
from pyspark.sql import functions as F

from contrail.functions import geo, idents, labels, tiles, times, weather


def one(spark, col):
    return spark.range(1).select(F.lit(col) if not hasattr(col, "alias") else col).first()[0]


@pytest.mark.parametrize("hex_id,tail", [
    ("aab1cf", "N78888"), ("c07bed", "C-GUYE"), ("C00BCF", "C-FEMG"), ("a00001", "N1"), ("adf7c7", "N99999"), ("a00002", "N1A"), ("a00003", "N1AA"),
    ("c00001", "C-FAAA"), ("c044a9", "C-GAAA"), ("400000", None), ("adf7c8", None), ("c0ffff", None)])
def test_icao_to_tail(spark, hex_id, tail):
    assert one(spark, idents.icao_to_tail(F.lit(hex_id))) == tail


@pytest.mark.parametrize("vis,ceiling,category", [
    (10.0, None, "VFR"), (4.0, None, "MVFR"), (10.0, 2500.0, "MVFR"), (2.0, None, "IFR"), (10.0, 800.0, "IFR"), (0.5, 5000.0, "LIFR"), (None, None, "UNKNOWN"),
    (5.0, 3000.0, "MVFR"), (None, 499.0, "LIFR"), (5.1, 3000.0, "VFR")])
def test_flight_category(spark, vis, ceiling, category):
    assert one(spark, weather.flight_category(F.lit(vis).cast("double"), F.lit(ceiling).cast("double"))) == category


@pytest.mark.parametrize("text,wind", [("KWVI 31008KT 10SM", (310, 8)), ("VRB05KT", (None, 5)), ("00000KT", (None, 0)), ("36012G20KT", (360, 12)), ("none", (None, 0))])
def test_wind(spark, text, wind):
    assert tuple(one(spark, weather.parse_wind(F.lit(text)))) == wind


@pytest.mark.parametrize("ident,number", [("20", "20"), ("9L", "09"), ("36R", "36"), ("37", ""), ("H1", ""), ("N", ""), ("00", ""), (" 18c ", "18")])
def test_runway_number(spark, ident, number):
    assert one(spark, idents.runway_number(F.lit(ident))) == number


@pytest.mark.parametrize("code,icao", [("wvi", "KWVI"), ("KWVI", "KWVI"), ("S43", "S43"), ("EGLL", "EGLL"), ("1R8", "1R8")])
def test_codes(spark, code, icao):
    assert one(spark, idents.faa_to_icao(F.lit(code))) == icao


@pytest.mark.parametrize("alt,label", [("0", "0k-3k"), ("2999", "0k-3k"), ("3000", "3k-6k"), ("18000", "10k-18k"), ("18001", "18k+"), ("-5", "18k+"), ("ground", "unknown")])
def test_altitude_label(spark, alt, label):
    assert one(spark, labels.altitude_label(F.lit(alt))) == label


def test_headings(spark):
    inside = lambda h, a, b: one(spark, geo.heading_between(F.lit(float(h)), F.lit(float(a)), F.lit(float(b))))
    assert inside(350, 340, 20) and inside(10, 340, 20) and not inside(180, 340, 20) and inside(20, 20, 30) and not inside(31, 20, 30)
    assert tuple(one(spark, geo.heading_range(F.lit(10.0), F.lit(25.0)))) == (345, 35)
    assert one(spark, geo.circular_diff(F.lit(350.0), F.lit(10.0))) == 20.0


def test_tile_round_trip(spark):
    for la, lo, z in ((36.9, -121.8, 11), (-33.9, 151.2, 9), (0.1, 0.1, 3)):
        t = tiles.tile_pixel(F.lit(la), F.lit(lo), F.lit(float(z)))
        b = one(spark, tiles.tile_bounds(t["tx"], t["ty"], F.lit(float(z))))
        assert b["south"] <= la <= b["north"] and b["west"] <= lo <= b["east"]


def test_approach_box(spark):
    def box(la, lo):
        return one(spark, geo.in_approach_box(F.lit(la), F.lit(lo), F.lit(37.0), F.lit(-122.0), F.lit(360.0)))

    assert box(36.99, -122.0) and not box(37.01, -122.0) and not box(36.97, -122.0) and not box(36.99, -121.99)


def test_time_functions(spark):
    assert one(spark, times.hhmm_utc(F.lit(1661692178.0))) == 1309
    assert one(spark, times.date_from_mmddyy(F.lit("060125"))).isoformat() == "2025-06-01"
    assert one(spark, times.day_type(F.lit("2025-06-01").cast("date"))) == "weekend"


def test_density_alpha(spark):
    a = [one(spark, tiles.density_alpha(F.lit(c))) for c in (0, 1, 10, 40, 4000)]
    assert a == [0, 8, 106, 255, 255]
