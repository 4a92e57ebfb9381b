import gzip
import json

import pytest
from pyspark.sql import functions as F

from contrail.sinks import rule_outputs, tables as sinks
from contrail.sources import dimensions as dims
from contrail.sources import lines as src
from contrail.sources import traces


def test_strict_and_numeric_coercion(spark):
    line = '{"now":1,"hex":"a061d9","lat":40,"lon":-119.5,"gs":100,"track":"x","alt_baro":%s}'
    def parse(alt, mode):
        return src.parse_reports(spark.createDataFrame([(line % alt,)], "value string"), "value", mode).first()

    r = parse("4000", "strict")
    assert (r["lat"], r["lon"], r["gs"], r["track"], r["alt_baro"]) == (0.0, -119.5, 0.0, 0.0, 4000)
    assert [parse(a, "strict")["alt_baro"] for a in ('"ground"', '"4000"', "4000.0")] == [0, 0, 0]
    n = parse("4000", "numeric")
    assert (n["lat"], n["gs"], n["alt_baro"]) == (40.0, 100.0, 4000)
    assert parse('"ground"', "numeric")["on_ground"] and not n["on_ground"]


def test_lines_without_altitude_or_json_are_dropped(spark):
    rows = ['{"now":1,"hex":"a"}', "{broken", "", '{"now":2,"hex":"a","alt_baro":null}']
    assert src.parse_reports(spark.createDataFrame([(r,) for r in rows], "value string")).count() == 1


def test_tail_fallbacks(spark):
    rows = ['{"now":1,"hex":"a061d9","r":"X","alt_baro":1}', '{"now":1,"hex":"4ca123","r":"EI-ABC","alt_baro":1}',
            '{"now":1,"hex":"4ca124","flight":"EIN1 ","alt_baro":1}', '{"now":1,"hex":"4ca125","alt_baro":1}', '{"now":1,"alt_baro":1}']
    reps = src.parse_reports(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert reps.where("tail is null").count() == 3
    got = [r["tail"] for r in src.tracked(reps).collect()]
    assert got[1:] == ["EI-ABC", "EIN1", "4ca125"] and got[0].startswith("N")


def test_trace_files(spark, tmp_path):
    body = {"icao": "4ca123", "timestamp": 1000.9, "trace": [
        [0.4, 1.0, 2.0, "ground", 10.7, 90.0, 0, None, None], [5.9, 1.1, 2.1, 1200, None, 91.0, 0, None, {"flight": " ABC1 ", "squawk": "1200"}],
        [9, 1.2, 2.2, 1300, 99.9, 92.0, 0, None, {"flight": "ZZZ"}]]}
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    whole = gzip.compress(json.dumps(body).encode())
    (deep / "one.json").write_bytes(whole)
    (tmp_path / "plain.json").write_text(json.dumps({**body, "icao": "4ca124", "r": "EI-X"}))
    (tmp_path / "cut.json").write_bytes(whole[:20])
    (tmp_path / "other.txt").write_text("x")
    rows = traces.scan_traces(spark, str(tmp_path)).orderBy("hex", "now").collect()
    assert [(r["hex"], r["now"], r["alt_baro"], r["gscp"], r["tail"]) for r in rows] == [
        ("4ca123", 1000.0, "0", 10, None), ("4ca123", 1005.0, "1200", 0, "ABC1"), ("4ca123", 1009.0, "1300", 99, "ABC1"),
        ("4ca124", 1000.0, "0", 10, "EI-X"), ("4ca124", 1005.0, "1200", 0, "EI-X"), ("4ca124", 1009.0, "1300", 99, "EI-X")]
    assert rows[1]["squawk"] == "1200" and rows[0]["on_ground"]


KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><Placemark><name>Scenic: 4500-7000  0-360</name><Polygon><outerBoundaryIs><LinearRing>
<coordinates> -119.0,40.0,0 -118.0,40.0,0 -118.0,41.0,0 -119.0,40.0,0 </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Folder>
<Placemark><name>%s</name><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2,0 3,4,0 5,6,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""


def test_region_file(spark, tmp_path):
    path = tmp_path / "r.kml"
    path.write_text(KML % "Rwy 25 Approach: -100-5500 230-270")
    rows = dims.scan_regions(spark, str(path)).orderBy("idx").collect()
    assert [(r["name"], r["min_alt"], r["max_alt"], r["hdg0"], r["hdg1"], len(r["ring"])) for r in rows] == [
        ("scenic", 4500, 7000, 0.0, 360.0, 4), ("rwy 25 approach", -100, 5500, 230.0, 270.0, 3)]
    layers = dims.as_layers(dims.scan_regions(spark, str(path)))
    assert layers[0][1]["ring"][0] == (1.0, 2.0)
    path.write_text(KML % "no range here")
    with pytest.raises(Exception, match="does not parse"):
        dims.scan_regions(spark, str(path)).collect()


def test_dimension_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'ident,type,name,latitude_deg,longitude_deg,elevation_ft,iso_country\nKWVI,small_airport,"Watson, Muni",36.9,-121.7,,US\nUS-1,small_airport,x,1,1,1,US\nEGLL,large_airport,x,1,1,1,GB\nH1,heliport,x,1,1,1,US\n')
    assert [(r["ident"], r["elev"], r["name"]) for r in dims.scan_airports(spark, str(tmp_path / "a.csv")).collect()] == [("KWVI", 0.0, "Watson, Muni")]
    (tmp_path / "r.csv").write_text(
        "airport_ident,length_ft,width_ft,closed,le_ident,le_latitude_deg,le_longitude_deg,le_heading_degT,le_elevation_ft,he_ident,he_latitude_deg,he_longitude_deg,he_heading_degT,he_elevation_ft\n"
        "kwvi,4000,75,0,02,36.9,-121.8,,100,20,36.95,-121.79,200.5,\n")
    from contrail.operators import airport

    a = airport.runway_anchors(dims.scan_runways(spark, str(tmp_path / "r.csv")).withColumn("ident", F.col("ident"))).orderBy("runway").collect()
    assert [r["runway"] for r in a] == ["02", "20"] and 0 < a[0]["heading"] < 20 and a[1]["heading"] == 200.5
    (tmp_path / "m.csv").write_text("station,valid,vsby,skyc1,skyl1\nWVI,2025-06-01 00:15,M,OVC,800\nWVI,,10,CLR,M\n")
    m = dims.scan_metar(spark, str(tmp_path / "m.csv")).collect()
    assert len(m) == 1 and m[0]["vsby"] is None and m[0]["skyl1"] == "800"
    (tmp_path / "l.txt").write_text("# head\nKEIK 7\n\nKCCB   # note\nS43\n")
    lst = src.airport_list(dims.scan_lines(spark, str(tmp_path / "l.txt")), first=2).collect()
    assert [(r["code"], r["radius_nm"]) for r in lst] == [("KEIK", 7.0), ("KCCB", None)]


def test_shards_and_pruned_scan(spark, tmp_path):
    rows = [(1748736000.0 + i, 36.5 + i % 3, -122.3, str(1000 * i)) for i in range(30)] + [(1748736000.0, None, -122.0, "1"), (1748736000.0, 36.5, -122.3, "ground")]
    df = spark.createDataFrame(rows, "now double, lat double, lon double, alt_baro string")
    sinks.write_shards(df, str(tmp_path / "s"), (36, 38, -123, -122))
    out = spark.read.parquet(str(tmp_path / "s"))
    assert {(r["cell_lat"], r["cell_lon"]) for r in out.collect()} == {(36, -123), (37, -123)}
    assert out.count() == sum(1 for i in range(30) if i % 3 < 2 and i <= 18) + 1
    plan = dims.scan_events(spark, str(tmp_path / "s"), (36, 37, -123, -122))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell_lat" in plan.split("PartitionFilters")[1][:200]


def test_versioned_table(spark, tmp_path):
    t = rule_outputs.TableSink(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.merge(spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, v int, x int"), ["k"], newest="v")
    t.merge(spark.createDataFrame([("b", 9, 8), ("c", 1, 1)], "k string, v int, x int"), ["k"], newest="v")
    assert {tuple(r) for r in t.read().collect()} == {("a", 2, 6), ("b", 9, 8), ("c", 1, 1)}
    t.append_epoch(spark.createDataFrame([("d", 1, 1)], "k string, v int, x int"), 3)
    t.append_epoch(spark.createDataFrame([("e", 1, 1)], "k string, v int, x int"), 3)
    assert [tuple(r) for r in t.read_epochs().select("k").collect()] == [("e",)]
