"""Intersection areas by slabs against a fine lattice and known shapes; hulls in sorted groups."""

import numpy as np
from pyspark.sql import functions as F

from slickwatch.operators import ensembles as ens
from slickwatch.operators import overlap

RINGS = "array<array<struct<x: double, y: double>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(rng, x, y, size, n):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = size * rng.uniform(0.3, 1, n)
    return list(zip(x + r * np.cos(angle), y + r * np.sin(angle)))


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def inside(rings, x, y):
    odd = np.zeros(len(x), int)
    for r in rings:
        for a, b in zip(r, [*r[1:], r[0]]):
            if a[1] != b[1]:
                odd += ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0])
    return odd % 2 == 1


def measured(spark, pairs):
    rows = [(i, [ring(r) for r in a] if a else a, [ring(r) for r in b] if b else b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"id int, a {RINGS}, b {RINGS}")
    return {r.id: (r.area_a, r.area_b, r.area_both) for r in overlap.intersection(df, ["id"]).collect()}


def test_known_areas(spark):
    notch = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    pairs = [
        ([square(0, 0, 2)], [square(1, 1, 2)]),  # a corner
        ([square(0, 0, 2)], [square(0, 0, 2)]),  # the same
        ([square(0, 0, 2)], [square(2, 0, 2)]),  # a common side
        ([square(0, 0, 4)], [square(1, 1, 1)]),  # inside
        ([square(0, 0, 2)], [square(5, 5, 1)]),  # apart
        ([notch], [square(1, 1, 2)]),  # concave: the notch cuts the square
        ([square(0, 0, 6), square(2, 2, 2)[::-1]], [square(1, 1, 4)]),  # a hole
        ([square(0, 0, 2)[::-1]], [square(1, 0, 2)]),  # the other way round
        (None, [square(0, 0, 1)]),
        ([], [square(0, 0, 1)]),
        ([[(0, 0), (1, 1)]], [square(0, 0, 1)]),  # no polygon
    ]
    got = measured(spark, pairs)
    both = [1, 4, 0, 1, 0, None, 12, 2, 0, 0, 0]
    assert all(b is None or abs(got[i][2] - b) < 1e-12 for i, b in enumerate(both))
    assert got[6][0] == 32 and got[8] == (0.0, 1.0, 0.0) and got[10][0] == 0
    hit = inside([notch], *(g.ravel() for g in np.meshgrid(np.linspace(1, 3, 1201)[:-1] + 1 / 1200, np.linspace(1, 3, 1201)[:-1] + 1 / 1200)))
    assert abs(got[5][2] - 4 * hit.mean()) < 2e-3
    ratio = overlap.overlap_ratio(spark.createDataFrame([(1, [ring(square(0, 0, 2))], [ring(square(1, 0, 2))]), (2, None, None)], f"id int, a {RINGS}, b {RINGS}"), ["id"]).collect()
    assert {r.id: round(r.iou, 12) for r in ratio} == {1: round(2 / 6, 12), 2: 0.0}


def test_concave_against_a_lattice(spark):
    rng = np.random.default_rng(9)
    pairs = [([star(rng, 0, 0, 1, 11)], [star(rng, *rng.uniform(-0.8, 0.8, 2), rng.uniform(0.3, 1.2), 9)]) for _ in range(30)]
    got = measured(spark, pairs)
    x, y = (g.ravel() for g in np.meshgrid(np.linspace(-1.2, 1.2, 900), np.linspace(-1.2, 1.2, 900)))
    for i, (a, b) in enumerate(pairs):
        want = (inside(a, x, y) & inside(b, x, y)).mean() * 2.4**2
        assert abs(got[i][2] - want) < 0.02


def test_hulls_of_many_groups(spark):
    """Groups over several batches and tasks, hot ones too, come out whole."""
    rng = np.random.default_rng(4)
    key = np.where(rng.random(60_000) < 0.5, 0, rng.integers(1, 300, 60_000))
    xy = rng.normal(size=(60_000, 2)).round(2)
    df = spark.createDataFrame([(int(k), None if k % 7 == 3 else "s", float(x), float(y)) for k, (x, y) in zip(key, xy)], "k int, s string, lon double, lat double").repartition(6)
    got = {r.k: [(p.x, p.y) for p in r.ring] for r in ens.convex_hulls(df, ["k", "s"]).collect()}
    assert len(got) == len(set(key.tolist()))
    for k, corners in got.items():
        pts = xy[key == k]
        assert set(corners) == {tuple(p) for p in ens._hull(pts[:, 0], pts[:, 1]).tolist()} and corners[0] == corners[-1]


def test_arrivals_on_a_concave_candidate(spark):
    """The reference case, a cloud without active particles, and a notched target."""
    shape = lambda pts: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [*pts, pts[0]]])
    rows = [(1, 0, -20.45, 57.55), (1, 0, -20.46, 57.56), (1, 0, -20.44, 57.54), (2, 1, -20.45, 57.55), (2, 2, -20.4, 57.5)]
    rows += [(3, 0, y, x) for x, y in square(57.5, -20.5, 0.1)] + [(3, 1, -20.0, 57.0)]
    p = spark.createDataFrame(rows, "hypothesis int, status int, lat double, lon double")
    notch = [(57.5, -20.5), (57.6, -20.5), (57.6, -20.4), (57.55, -20.5), (57.5, -20.4)]
    t = spark.range(1, 4).select(F.col("id").cast("int").alias("hypothesis"), F.when(F.col("id") == 3, shape(notch)).otherwise(shape([(57.5, -20.5), (57.6, -20.5), (57.6, -20.4), (57.5, -20.4)])).alias("ring"))
    got = {r.hypothesis: r for r in ens.arrival_metrics(p, t, ["hypothesis"]).collect()}
    assert (got[1].active_count, got[1].active_fraction, got[1].inside_fraction, got[1].stranded_count) == (3, 1.0, 1.0, 0)
    assert got[1].centroid_distance_km >= 0 and got[1].equivalent_radius_km > 0 and got[1].iou == 0 and got[1].convex_hull_area_km2 < 1e-6
    assert (got[2].stranded_count, got[2].stranded_fraction, got[2].iou, got[2].convex_hull_area_km2, got[2].median_distance_km) == (2, 1.0, 0.0, 0.0, 999.0)
    assert (got[3].stranded_count, got[3].stranded_fraction, got[3].iou) == (1, 0.2, 0.5)


def test_distances_of_small_and_large_clouds(spark):
    """Percentiles by sorted arrays and by bins are the same, and what needs no hull makes none."""
    live = spark.range(900).select((F.col("id") % 2).alias("hypothesis"), F.when(F.col("id") % 4 != 1, F.pow(F.col("id") * 7919 % 991, 1.5)).alias("_km"))
    sizes = live.groupBy("hypothesis").agg(F.count("*").alias("active_count"))
    got = [sorted(ens._percentiles(live, ["hypothesis"], sizes, held).collect()) for held in (10**6, 449, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2 and got[0][0].median_distance_km is not None
    p = spark.range(400).select(F.lit(1).alias("hypothesis"), (F.col("id") % 7 * 0.01 - 20.0).alias("lat"), (F.col("id") % 11 * 0.01 + 57.0).alias("lon"), F.lit(0).alias("status"))
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(57.0, -20.0), (57.05, -20.0), (57.05, -19.9), (57.0, -20.0)]])
    t = spark.range(1).select(F.lit(1).alias("hypothesis"), ring.alias("ring"))
    whole, plain = ens.arrival_metrics(p, t, ["hypothesis"]), ens.arrival_metrics(p, t, ["hypothesis"], shape=False)
    assert set(whole.columns) - set(plain.columns) == {"iou", "convex_hull_area_km2"}
    assert whole.select(plain.columns).collect() == plain.collect()
    assert plain.select(ens.closure_class(plain)).count() == 1
