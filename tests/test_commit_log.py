"""Keyed tables behind a log of commits."""

import glob
import os

import pytest

from contrail.sinks.commit_log import Conflict, KeyedTable, OpsSink
from contrail.sinks.rule_outputs import batch_handler

KV = "k string, v int, x int"


def files(root):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{root}/data/**/*.parquet", recursive=True)}


def rows(table, number=None):
    return sorted(map(tuple, table.read(number).collect()))


def test_merges_leave_other_parts_alone(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    assert table.read() is None
    table.merge(spark.createDataFrame([(f"k{i}", 1, i) for i in range(200)] + [("k0", 9, 7)], KV), newest="v")
    first, before = rows(table), files(table.root)
    assert len(first) == 200 and ("k0", 9, 7) in first
    table.merge(spark.createDataFrame([("k5", 2, 50), ("new", 2, 51)], KV))
    table.merge(spark.createDataFrame([("k5", 3, 60)], KV))
    expected = {r[0]: r for r in first} | {"k5": ("k5", 3, 60), "new": ("new", 2, 51)}
    assert rows(table) == sorted(expected.values()) and rows(table, 0) == first
    # no file was written again, and buckets without a changed key still consist of their first part
    assert {f: t for f, t in files(table.root).items() if f in before} == before
    parts = table.manifest()["parts"]
    assert sum(len(p) > 1 or not p[0].startswith("c000000000000") for p in parts.values()) <= 2 and len(table.commits()) == 3


def test_inserts_add_parts_and_full_buckets_are_joined(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=1)
    for i in range(10):
        table.merge(spark.createDataFrame([(f"k{i}", i, i)], KV))
    assert rows(table) == [(f"k{i}", i, i) for i in range(10)] and len(table.manifest()["parts"]["0"]) <= 8
    table.merge(spark.createDataFrame([], KV))
    assert len(rows(table)) == 10


def test_two_writers_and_batches_delivered_again(spark, tmp_path, monkeypatch):
    one = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    one.merge(spark.createDataFrame([("a", 1, 1)], KV), stream="s", epoch=0)
    assert not one.merge(spark.createDataFrame([("a", 5, 5)], KV), stream="s", epoch=0) and rows(one) == [("a", 1, 1)]
    other = KeyedTable(spark, one.root, ["k"], 4)
    monkeypatch.setattr(other, "commits", lambda: [])  # has not seen the commit
    monkeypatch.setattr(other, "manifest", lambda number=None: {"buckets": 4, "parts": {}, "epochs": {}, "schema": None})
    with pytest.raises(Conflict):
        other.merge(spark.createDataFrame([("b", 1, 1)], KV))
    assert rows(one) == [("a", 1, 1)]


def test_ops_go_through_the_aircraft_table(spark, tmp_path):
    ops, aircraft = KeyedTable(spark, str(tmp_path / "o"), ["tail", "now"], 4), KeyedTable(spark, str(tmp_path / "a"), ["tail"], 4)
    sink = OpsSink(ops, aircraft)
    batch = spark.createDataFrame([("N1", 1.0, "Takeoff"), ("N2", 2.0, "Landing"), ("N1", 3.0, "Landing")], "tail string, now double, operation string")
    handler = batch_handler(lambda df: sink.add(df, "ops", 0), required=True)
    handler(batch, 0)
    handler(batch, 0)
    assert {r.tail: r.aircraft_id for r in aircraft.read().collect()} == {"N1": "new-N1", "N2": "new-N2"}
    assert ops.read().count() == 3 and {r.aircraft_id for r in ops.read().where("tail = 'N1'").collect()} == {"new-N1"}
    with pytest.raises(ZeroDivisionError):
        batch_handler(lambda df: 1 / 0, required=True)(batch, 1)
    batch_handler(lambda df: 1 / 0)(batch, 1)  # an alert's failure is only reported
