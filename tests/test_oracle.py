"""Registered queries against their SQL in DuckDB."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAMPLE = ["W2", "W8_altitude_trend", "W9_trips", "W21_event_quality", "J1_proximity_first_only", "J3_point_in_region_join", "A2_busyness_cube", "A5_gap_percentiles",
          "A14_pixel_density", "A15_hotspot_surface", "A16_completeness", "J13_event_diff", "K5_track_report", "G8_airport_regions", "O3_evenly_spaced", "X8_icao_to_tail_us"]


def check(sf, names):
    run = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "check.py"), sf, *names], capture_output=True, text=True, timeout=3000)
    assert run.returncode == 0, run.stdout[-4000:]


def test_sample(sf):
    check(sf, SAMPLE)


@pytest.mark.slow
@pytest.mark.skipif(not os.environ.get("ALL_QUERIES"), reason="set ALL_QUERIES=1 to run every query")
def test_all(sf):
    check(sf, [])


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200
