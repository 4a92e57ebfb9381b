"""Tests of the findings of round 3 on the training-data operators."""

import glob

import numpy as np
import pytest

from contrail.llm import common, jaccard
from contrail.session import shared_dir


def _roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("at_once", [jaccard.LINKS_AT_ONCE, 300])
def test_components_join_what_a_task_holds(spark, monkeypatch, at_once):
    """op9: a chain and random links; what fits a task needs no rounds of shuffles."""
    monkeypatch.setattr(jaccard, "LINKS_AT_ONCE", at_once)
    draw = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(500)] + [(int(a), int(b)) for a, b in draw.integers(1000, 3000, (900, 2)) if a != b]
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/links-*"))
    got = jaccard.components(spark.createDataFrame(edges, "_a long, _b long").repartition(5)).collect()
    assert len(got) == len({r["_node"] for r in got})
    assert {r["_node"]: r["_root"] for r in got} == _roots(edges)
    written = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/links-*")) - before
    assert len(written) == 2 or at_once == 300


def test_components_of_no_links(spark):
    assert jaccard.components(spark.createDataFrame([], "_a long, _b long")).collect() == []


def test_free_memory_goes_back():
    """pipeline: a worker that waits keeps no memory of the task behind it."""
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def step(batches):
        blocks, _held = [np.ones(8000) for _ in range(2000)], held.append(np.ones(8000))
        yield from batches

    held, before = [], resident()
    assert list(common.released(step)([1, 2])) == [1, 2]
    assert resident() - before < 64 << 20
