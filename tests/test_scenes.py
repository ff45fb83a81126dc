"""Components, groups, hulls and distances against plain Python and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators import ensembles as ens
from slickwatch.operators import forcing as fc
from slickwatch.operators import grouping, land
from slickwatch.operators import raster as ra
from slickwatch.operators.ordered import distributed_rank, grouped_percentiles


def flood(mask):
    label, labels = 0, np.zeros(mask.shape, int)
    for start in zip(*np.nonzero(mask)):
        if labels[start]:
            continue
        label += 1
        stack = [start]
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not labels[y, x]:
                labels[y, x] = label
                stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return labels


def test_components_match_flood_fill(spark):
    mask = np.random.default_rng(5).random((40, 60)) < 0.42
    px = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "scene_id bigint, y bigint, x bigint")
    got = ra.labelled_pixels(ra.label_components(px)).collect()
    want = flood(mask)
    pairs = {(r.label, want[r.y, r.x]) for r in got}
    assert len(got) == mask.sum()
    assert len(pairs) == want.max() == len({a for a, _ in pairs})


def test_saturated_scene(spark):
    rows = [(1, i, i % 2 == 0, True) for i in range(100)]
    df = spark.createDataFrame(rows, "scene_id bigint, x bigint, seed boolean, usable boolean")
    assert ra.saturation(df, 0.10).first().status == "INSUFFICIENT_DATA"


def test_leader_groups_match_sequential_pass(spark):
    rng = np.random.default_rng(11)
    n, hw = 90, 0.003
    lon, lat = 57.5 + rng.random(n) * 0.12, -20.4 + rng.random(n) * 0.12
    head, con, score = rng.integers(0, 180, n), rng.integers(0, 90, n) / 10, rng.integers(0, 60, n)
    rows = [(1, f"C{i}", i, float(lon[i]), float(lat[i]), float(head[i]), float(con[i]), float(score[i]), i % 9 != 0) for i in range(n)]
    df = spark.createDataFrame(
        rows, "scene_id bigint, candidate_id string, ordinal bigint, lon double, lat double, orientation_deg double, contrast_db double, score double, in_review boolean"
    )
    df = df.withColumn("ring", geo.ring_from_offsets("lon", "lat", [(-hw, -hw), (hw, -hw), (hw, hw), (-hw, hw)]))
    got = {r.candidate_id: r.assigned_group for r in grouping.leader_groups(df).collect()}

    def ea(i):
        s = np.sin(np.radians([lat[i] - hw, lat[i] + hw]))
        e2, e = geo.WGS84_E2, geo.WGS84_E2**0.5
        q = (1 - e2) * (s / (1 - e2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))
        x = geo.WGS84_A * np.radians([lon[i] - hw, lon[i] + hw])
        return x, geo.WGS84_A / 2 * q

    def apart(i, j):
        (xi, yi), (xj, yj) = ea(i), ea(j)
        gx = max(0, xi[0] - xj[1], xj[0] - xi[1])
        gy = max(0, yi[0] - yj[1], yj[0] - yi[1])
        return np.hypot(gx, gy)

    def close(i, j):
        h = abs(head[i] - head[j])
        h = 180 - h if h > 90 else h
        return apart(i, j) <= 2000 and h <= 35 and abs(con[i] - con[j]) <= 4

    order = sorted((i for i in range(n) if i % 9), key=lambda i: (-score[i], i))
    want, number = {}, 0
    for k, i in enumerate(order):
        if i in want:
            continue
        number += 1
        want[i] = number
        for j in order[k + 1 :]:
            if j not in want and close(i, j):
                want[j] = number
    for i in range(n):
        assert got[f"C{i}"] == (f"GRP{want[i]:03d}" if i in want else "GRP_UNASSIGNED"), i


def test_hull_and_overlap(spark):
    pts = np.random.default_rng(3).normal(size=(3000, 2))
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in pts], "g int, lon double, lat double").repartition(7)
    ring = np.array([(p.x, p.y) for p in ens.convex_hulls(df, ["g"]).first().ring])
    x, y = ring[:, 0], ring[:, 1]
    area = np.dot(x[:-1], y[1:]) - np.dot(y[:-1], x[1:])
    assert area > 0
    for a, b in zip(ring[:-1], ring[1:]):
        side = (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0])
        assert side.min() > -1e-9


def test_land_distance_levels(spark):
    def box(x, y, s):
        return geo.ring_from_offsets(F.lit(x), F.lit(y), [(-s, -s), (s, -s), (s, s), (-s, s)])

    lands = spark.range(1).select(box(57.5, -20.0, 0.01).alias("ring"))
    cands = spark.createDataFrame([("near", 57.515), ("mid", 57.6), ("far", 58.5), ("farther", 60.5), ("on", 57.505)], "candidate_id string, x double")
    cands = cands.select("candidate_id", geo.ring_from_offsets("x", F.lit(-20.0), [(-0.001, -0.001), (0.001, -0.001), (0.001, 0.001), (-0.001, 0.001)]).alias("ring"))
    got = {r.candidate_id: r.distance_m for r in land.distance_to_land(cands, lands).collect()}
    metres = 6378137 * np.pi / 180
    assert got["on"] == 0
    none = land.distance_to_land(cands, lands.limit(0)).collect()
    assert len(none) == 5 and {r.distance_m for r in none} == {999999.0}
    for name, x in (("near", 57.515), ("mid", 57.6), ("far", 58.5), ("farther", 60.5)):
        assert abs(got[name] - (x - 0.001 - 57.51) * metres) < 0.01


def test_percentiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 5000), rng.normal(size=5000).round(2))]
    df = spark.createDataFrame(data, "k int, v double")
    got = {r.k: (r.a, r.b) for r in grouped_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}, 0.1).collect()}
    for k in range(3):
        v = [b for a, b in data if a == k]
        assert np.allclose(got[k], (np.median(v), np.percentile(v, 95)))
    ranked = distributed_rank(df, ["k"], [F.floor("v")], ["asc"], [F.col("v")]).collect()
    for k in range(3):
        part = sorted((r for r in ranked if r.k == k), key=lambda r: r.rank)
        assert [r.rank for r in part] == list(range(1, len(part) + 1))
        assert [r.v for r in part] == sorted(r.v for r in part)


def test_seeds_lie_inside_and_repeat(spark):
    ring = geo.ring_from_offsets(F.lit(57.5), F.lit(-20.0), [(-0.04, -0.04), (0.04, -0.04), (0.04, 0.0), (0.0, 0.0), (0.0, 0.04), (-0.04, 0.04)])
    polys = spark.range(1).select(F.lit("C1").alias("candidate_id"), ring.alias("ring"))
    a = ens.seed_particles(polys, 500)
    assert a.count() == 500
    assert a.join(polys, "candidate_id").filter(~geo.point_in_ring(F.col("ring"), "lon", "lat")).count() == 0
    b = ens.seed_particles(polys.repartition(3), 500)
    assert a.exceptAll(b).count() == 0


def test_seeds_in_rounds_and_topped_up(spark):
    """A sliver lacks points after all attempts and gets the rest; a block needs one round; both have every number once."""
    sliver = geo.ring_from_offsets(F.lit(57.5), F.lit(-20.0), [(-0.1, -0.1), (0.1, 0.1), (0.1, 0.1001), (-0.1, -0.0999)])
    block = geo.ring_from_offsets(F.lit(57.0), F.lit(-20.0), [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)])
    polys = spark.range(2).select(F.when(F.col("id") == 0, "thin").otherwise("block").alias("candidate_id"), F.when(F.col("id") == 0, sliver).otherwise(block).alias("ring"))
    rows = ens.seed_particles(polys, 60).collect()
    assert sorted((r.candidate_id, r.seq) for r in rows) == [(c, k) for c in ("block", "thin") for k in range(1, 61)]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, ens.seed_particles(polys.repartition(5), 60).collect()))
    inside = spark.createDataFrame(rows).join(polys, "candidate_id").filter(geo.point_in_ring(F.col("ring"), "lon", "lat")).groupBy("candidate_id").count().collect()
    counts = {r.candidate_id: r["count"] for r in inside}
    assert counts["block"] == 60 and counts.get("thin", 0) < 60


def test_training_lock_fails_on_one_row(spark):
    from slickwatch.operators import candidates as cand

    rows = [(f"C{k}", "UNLABELLED_REAL_CASE", False) for k in range(20)]
    kind = "candidate_id string, label_status string, training_allowed boolean"
    assert cand.training_lock(spark.createDataFrame(rows, kind)).count() == 20
    for bad in (("C", "UNLABELLED_REAL_CASE", True), ("C", "LABELLED", False), ("C", None, False), ("C", "UNLABELLED_REAL_CASE", None)):
        with pytest.raises(Exception, match="unlabelled"):
            cand.training_lock(spark.createDataFrame([*rows, bad], kind)).collect()


def test_sparse_pixels_are_not_neighbours(spark):
    """Absent pixels part their neighbours; box means refuse lines with gaps."""
    rows = [(1, 0, 0, True), (1, 0, 10, False), (1, 0, 11, True), (1, 0, 12, True)]
    df = spark.createDataFrame(rows, "scene_id long, y long, x long, mask boolean")
    got = {r.x: r.out for r in ra.open_mask(df.withColumn("mask", F.col("mask").cast("int")), "mask", "out").collect()}
    assert got[0] == 1 and got[10] == 0
    line = df.select("scene_id", "y", "x", F.lit(13).alias("width"), F.lit(1).alias("height"), F.lit(1.0).alias("v"))
    with pytest.raises(Exception, match="lacks pixels"):
        ra.box_mean(line, "v", 3, "m").collect()


def test_groups_without_active_particles(spark):
    rows = [("h1", 24, 0, 1.0 * k, 2.0 * (k % 7)) for k in range(30)] + [("h2", 24, 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "hypothesis string, horizon int, status int, lat double, lon double")
    got = {r.hypothesis: r for r in ens.source_envelopes(df).collect()}
    assert got["h1"].particle_count == 30 and got["h1"].geometry_type == "Polygon"
    assert (got["h2"].particle_count, got["h2"].ring, got["h2"].geometry_type) == (0, None, None)
    valid = {r.hypothesis: r.validity for r in ens.region_validity(ens.source_envelopes(df).withColumn("forcing_fraction", F.lit(0.9))).collect()}
    assert valid == {"h1": "PARTIAL", "h2": "INVALID"}


def test_hulls_of_groups_cut_by_batches(spark):
    """A group that goes on in the next batch gives one ring, whatever order its keys were first seen in."""
    rows = [
        (h, horizon, 10.0 * h + float(np.cos(k)), horizon + float(np.sin(k)))
        for h in range(12) for horizon in (24, 48, 72, 96) if h or horizon > 48 for k in range(12)
    ]
    df = spark.createDataFrame(rows, "hypothesis long, horizon int, lon double, lat double").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "31")
    try:
        got = ens.convex_hulls(df, ["hypothesis", "horizon"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 46 and {(r.hypothesis, r.horizon) for r in got} == {r[:2] for r in rows}
    assert {len(r.ring) for r in got} == {13}


def test_points_without_a_grid_have_no_offset(spark):
    cells = [(1, 0, y, x, 0, -20.0 + y * 0.1, 57.0 + x * 0.1, 0.1, 0.2) for y in range(3) for x in range(3)]
    grid = spark.createDataFrame(cells, "ds long, ti long, yi long, xi long, t_s long, lat double, lon double, u double, v double")
    points = spark.createDataFrame([(1, 1, -19.95, 57.05, 0), (2, 2, -19.95, 57.05, 0)], "point_id long, ds long, lat double, lon double, t_s long")
    wet = fc.wet_cells(points, grid, ("u", "v"))
    got = {r.point_id: r for r in wet.collect()}
    assert got[1].offset_m > 0 and (got[2].actual_lat, got[2].offset_m, got[2].support) == (None, None, "VALID")
    sums = {r.ds: r for r in fc.offset_summary(wet, ["ds"]).collect()}
    assert sums[1].median_offset_m == got[1].offset_m and (sums[2].max_offset_m, sums[2].median_offset_m, sums[2].unsupported) == (None, None, 0)


def test_a_computed_ring_is_computed_once(spark):
    """The area of a projected ring holds its projection once, not once an edge and corner."""
    df = spark.range(1).select(geo.ring_from_offsets(F.lit(57.0), F.lit(-20.0), [(0, 0), (0.1, 0), (0, 0.1)]).alias("ring"))
    text = df.select(geo.ring_area(geo.equal_area_ring(F.col("ring"))).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert text.lower().count("ln(") == 1


def test_regions_of_a_small_file_are_not_broadcast(spark):
    from slickwatch.plans.catalogue import QUERIES

    plan = QUERIES["point_in_polygon"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_axes_are_not_written_with_every_point(spark, monkeypatch):
    kept, cut = [], fc.cut_lineage
    monkeypatch.setattr(fc, "cut_lineage", lambda df: kept.append(df.dtypes) or cut(df))
    cells = [(1, t, y, x, t * 3600, -20.0 + y * 0.1, 57.0 + x * 0.1, 0.1, 0.2) for t in range(2) for y in range(3) for x in range(3)]
    grid = spark.createDataFrame(cells, "ds long, ti long, yi long, xi long, t_s long, lat double, lon double, u double, v double")
    points = spark.createDataFrame([(1, 1, -19.95, 57.05, 900), (2, 2, -19.95, 57.05, 0), (3, 1, -19.85, 57.05, 9000)], "point_id long, ds long, lat double, lon double, t_s long")
    got = {r.point_id: (round(r.c_u, 9), r.c_status) for r in fc.forcing_at(points, grid, {"c": ("u", "v")}).collect()}
    assert got == {1: (0.1, "VALID"), 2: (0.0, "OUT_OF_DOMAIN"), 3: (0.1, "VALID")}
    assert len(kept) == 2 and not [c for types in kept for c, kind in types if kind.startswith("array")]


def test_seeds_of_a_small_table_are_drawn_in_many_tasks(spark, monkeypatch):
    parts, cut = [], ens.cut_lineage
    monkeypatch.setattr(ens, "cut_lineage", lambda df: parts.append(df.rdd.getNumPartitions()) or cut(df))
    ring = geo.ring_from_offsets(F.lit(57.0), F.lit(-20.0), [(0, 0), (0.1, 0), (0, 0.1)])
    polygons = spark.range(6).coalesce(1).select(F.col("id").cast("string").alias("candidate_id"), ring.alias("ring"))
    assert ens.seed_particles(polygons, 3).count() == 18 and parts[0] == 4
