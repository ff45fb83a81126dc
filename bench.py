"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line. One query warms the session up; then each runs
``$BENCH_RUNS`` times (default 3, once only if the first run took ``LONG`` seconds or
more) and the median is reported, with the bytes the first run shuffled.
``BENCH_WARM=1`` also runs every query once before its timed runs. Results go to the
``noop`` sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slickwatch.plans.catalogue import QUERIES
from slickwatch.session import local_session

LONG = 8.0
HEADLINE = [
    "ais_quality_flags",
    "report_gaps",
    "vessel_tracks",
    "vessel_behaviour",
    "asof_last_position",
    "track_region_distance",
    "priority_score",
    "case_attribution",
    "triage_tier",
    "rank_candidates",
    "select_hypotheses",
    "closest_pair_within",
    "asof_forcing_nearest",
    "forcing_bilinear",
    "coverage_check",
    "particle_status",
    "scenario_sensitivity",
    "source_envelope",
    "arrival_metrics",
    "box_filter",
    "dark_seed",
    "connected_components",
    "pixel_polygon_overlap",
    "category_fp_report",
    "split_leakage",
    "forbidden_scan",
    "dup_content",
    "greedy_groups",
    "component_geometry",
    "distance_to_land",
    "forcing_gate",
    "morph_open",
    "polygon_iou",
]


def run(spark, key, folder):
    start = time.perf_counter()
    QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def shuffled(spark) -> int:
    """Bytes that the session's tasks have written to shuffles so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    warm = os.environ.get("BENCH_WARM", "0") == "1"
    keys = sys.argv[1:] or HEADLINE
    if keys == ["all"]:
        keys = list(QUERIES)
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    times, moved = {}, {}
    run(spark, "triage_tier", folder)
    for key in keys:
        if warm:
            run(spark, key, folder)
        before = shuffled(spark)
        took = [run(spark, key, folder)]
        moved[key] = shuffled(spark) - before
        took += [run(spark, key, folder) for _ in range(runs - 1 if took[0] < LONG else 0)]
        times[key] = round(statistics.median(took), 3)
        print(f"{key} {times[key]} {moved[key]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "shuffle_bytes": moved,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
