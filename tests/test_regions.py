"""Closest approach by bounds of cells, against every report with every corner."""

import math
import random

import pytest
from pyspark.sql import functions as F

from slickwatch.operators import regions
from slickwatch.operators import tracks as vessels
from slickwatch.operators.spatial import salted_join, with_point_cell
from slickwatch.plans import vessel as vessel_plans
from slickwatch.plans.registry import Tables

RING = "array<struct<x: double, y: double>>"


def metres(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(a)))


def tracks(rng, vessels, steps):
    """Dense tracks of one case, and a ship at anchor that holds most reports."""
    out = []
    for v in range(vessels):
        lat, lon, way = -20.5 + rng.uniform(-0.5, 0.5), 57.5 + rng.uniform(-0.5, 0.5), rng.uniform(0, 6.28)
        for k in range(steps):
            way += rng.uniform(-0.2, 0.2)
            lat, lon = lat + 0.006 * math.sin(way), lon + 0.006 * math.cos(way)
            out.append((1, f"v{v}", lat, lon, k * 60))
    return out + [(1, "anchored", -20.41, 57.62, k) for k in range(2 * steps)] + [(2, "v0", -20.5, 57.5, 7)]


def areas(rng):
    out = []
    for r in range(9):
        x, y, s = 57.5 + rng.uniform(-0.6, 0.6), -20.5 + rng.uniform(-0.6, 0.6), rng.uniform(0.001, 0.2)
        ring = [(x + s * math.cos(t * 0.5), y + s * math.sin(t * 0.5)) for t in range(12)]
        out.append((1, r, [{"x": a, "y": b} for a, b in [*ring, ring[0]]], True))
    return out + [(2, 20, out[0][2], True), (3, 30, out[0][2], True)]


def test_closest_against_every_pair(spark):
    rng = random.Random(3)
    rows, live = tracks(rng, 12, 250), areas(rng)
    p = spark.createDataFrame(rows, "case_id int, mmsi string, lat double, lon double, sec long").repartition(4)
    p = with_point_cell(p, "lon", "lat", regions.CELL_DEG)
    r = spark.createDataFrame(live, f"case_id int, region_id int, ring {RING}, eligible boolean")
    got = {(x.case_id, x.mmsi, x.region_id): (x._at.km, x._at.sec) for x in regions._closest_vertices(p, r).collect()}
    want = {}
    for case, mmsi, lat, lon, sec in rows:
        for c, region, ring, _ in live:
            if c == case:
                d = min(metres(lat, lon, q["y"], q["x"]) for q in ring) / 1000
                want[case, mmsi, region] = min(want.get((case, mmsi, region), (math.inf, 0)), (d, sec))
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 for k in want)
    anchored = [k for k in want if k[1] == "anchored"]
    assert anchored and all(got[k][1] == 0 for k in anchored)  # of equal distances the earliest report
    cells = p.select("case_id", "mmsi", "_cx", "_cy").distinct().count()
    assert regions.surviving_cells(p, r).count() < 0.6 * cells * 9


def test_no_join_on_the_case_alone(spark):
    left = spark.range(1000).select(F.lit(1).alias("case_id"), "id")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "case_id int, r string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = salted_join(left, right, ["case_id"], ["id"])
        tasks = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out.count() == 2000 and len(tasks) > 1 and "_salt" in plan


@pytest.mark.parametrize("boundary", ["vertex", "segment"])
def test_tracks_as_one_row_against_report_by_report(spark, boundary):
    """Short tracks meet the regions without a shuffle of pairs, and like tracks of any length; large cases are told by their reports."""
    rng = random.Random(5)
    p = spark.createDataFrame(tracks(rng, 6, 40), "case_id int, mmsi string, lat double, lon double, sec long")
    r = spark.createDataFrame(areas(rng), f"case_id int, region_id int, ring {RING}, eligible boolean").drop("eligible")
    p = p.select("*", F.timestamp_seconds("sec").alias("ts"), F.monotonically_increasing_id().alias("ordinal"))
    p = p.select("*", F.lit("V").alias("vessel_name"), F.lit("T").alias("vessel_type"), (F.col("sec") % 13 * 1.0).alias("sog"), (F.col("sec") % 360 * 1.0).alias("cog"))
    r = r.select("*", F.lit("C").alias("candidate_id"), F.lit(24).alias("horizon_hours"), F.lit(-20.0).alias("c_lat"), F.lit(57.0).alias("c_lon"), F.lit(True).alias("eligible"))
    keys = ["case_id", "mmsi"]
    long = vessels.vessel_profiles(vessels.with_previous(p, keys), keys).drop("mean_sog")  # its last digits hang on the order of the sum
    short = vessels.vessel_profiles(vessels.with_previous(p.repartition("case_id"), keys, whole=True), keys, whole=True, reports=regions.report())
    assert sorted(short.select(long.columns).collect()) == sorted(long.collect())
    by_report = regions.track_region_distance(p, r, long, boundary, carry=["end_ts"])
    by_track = regions.track_region_distance(None, r, short, boundary, carry=["end_ts"])
    want = sorted(by_report.collect())
    assert want and sorted(by_track.collect()) == want
    plan = regions.track_region_distance(None, r, short, boundary)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2  # reports and regions, once each
    few, many = regions.split_cases(p, 10**9)
    assert many is None and few.count() == p.count()
    few, many = regions.split_cases(p, 0)
    assert few.count() == 0 and many.count() == p.count()


def test_short_tracks_against_report_by_report(spark):
    """Tracks of up to six reports, some of them inside a region: the reports written out, and those after them, count alike."""
    rng = random.Random(11)
    live = areas(rng)
    rows = [(1, f"s{n}-{v}", lat, lon, sec) for n in range(1, 7) for _, v, lat, lon, sec in tracks(rng, 4, n) if v != "anchored"]
    for n in range(1, 7):  # the last report alone, the first alone, or all lie in the middle of a region
        mid = [sum(q[k] for q in live[n][2][:-1]) / 12 for k in ("y", "x")]
        rows += [(1, f"{kind}{n}", *(mid if hit(k, n) else (-18.0, 55.0)), 60 * (n - k)) for kind, hit in INSIDE.items() for k in range(n)]
    r = spark.createDataFrame(live, f"case_id int, region_id int, ring {RING}, eligible boolean")
    r = r.select("*", F.lit("C").alias("candidate_id"), F.lit(24).alias("horizon_hours"), F.lit(-20.0).alias("c_lat"), F.lit(57.0).alias("c_lon"))
    p = spark.createDataFrame(rows, "case_id int, mmsi string, lat double, lon double, sec long").coalesce(1)
    p = p.select("*", F.timestamp_seconds("sec").alias("ts"), F.lit("V").alias("vessel_name"), F.lit("T").alias("vessel_type"))
    profiles = p.groupBy("case_id", "mmsi", "vessel_name", "vessel_type").agg(
        F.lit(10.0).alias("median_gap_minutes"), F.min("lat").alias("first_lat"), F.min("lon").alias("first_lon"), F.collect_list(regions.report()).alias("reports")
    )
    got = regions.track_region_distance(None, r, profiles)
    want = sorted(regions.track_region_distance(p, r, profiles.drop("reports")).collect())
    assert sorted(got.collect()) == want and len(want) == 9 * len({x[1] for x in rows})
    found = {(x.mmsi, x.region_id): x.inside_points for x in want}
    assert all(found[f"{kind}{n}", n] == sum(hit(k, n) for k in range(n)) for n in range(1, 7) for kind, hit in INSIDE.items())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # regions of the small packed file get their corners in all tasks


INSIDE = {"last": lambda k, n: k == n - 1, "first": lambda k, n: k == 0, "all": lambda k, n: True}


def test_cases_are_dealt_to_all_tasks(spark):
    """Reports are few bytes but much work, so adaptive execution may not put their tasks together."""
    _, profiles = vessel_plans.case_tracks(Tables(spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in profiles._jdf.queryExecution().executedPlan().toString()


def test_retrieval_meets_cells_in_one_exchange(spark, monkeypatch):
    """What cases retrieve, against every pair; no size estimate may broadcast their cells, or shuffle the reports a second time."""
    rng = random.Random(23)
    near = [(k, -20.9 + k * 0.45, 57.4 + k * 0.3, 1_596_600_000 + k * 90_000) for k in range(4)]
    cases = spark.createDataFrame(near, "case_id long, aoi_lat double, aoi_lon double, o long")
    rows = [(i, rng.uniform(-22, -19), rng.uniform(56.5, 60), 1_596_600_000 + rng.randrange(-500_000, 400_000)) for i in range(3000)]
    reports = spark.createDataFrame(rows, "ordinal long, lat double, lon double, s long").select("*", F.timestamp_seconds("s").alias("ts"))
    got = regions.case_positions(reports, cases.withColumn("obs_ts", F.timestamp_seconds("o")).drop("o"))
    want = {
        (c, i) for c, y, x, o in near for i, lat, lon, s in rows
        if y - 0.6 <= lat <= y + 0.6 and x - 0.6 <= lon <= x + 0.6 and o - 120 * 3600 <= s <= o + 10 * 3600
    }
    pairs = [(r.case_id, r.ordinal) for r in got.collect()]
    assert len(pairs) == len(want) > 100 and set(pairs) == want

    written = []
    monkeypatch.setattr(vessel_plans, "staged", lambda df, name: written.append(df) or df)
    vessel_plans.case_tracks(Tables(spark, "/root/testdata/sf0.001"))
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "REPARTITION" not in plan
