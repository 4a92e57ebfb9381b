"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "W2_flight_numbers", "W5_resample", "W8_altitude_trend", "W9_trips", "W4_region_transitions", "F22_region_membership", "J3_point_in_region_join",
    "J2_resampled_proximity", "J1_proximity_all_pairs", "W21_event_quality", "A2_busyness_cube", "A4_coverage_quality", "A7_runway_usage",
    "A14_pixel_density", "G5_zoom_pyramid", "A15_hotspot_surface", "T5_cooldown_per_aircraft", "K5_track_report", "J5_multi_airport_shard", "J10_asof_users",
    "A16_completeness", "J13_event_diff", "O2_every_nth", "K8_grid_shards",
]


def main() -> None:
    from contrail.plans.catalog import QUERIES
    from contrail.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/events.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
