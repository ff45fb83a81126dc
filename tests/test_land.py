"""Land as edges on cells: lakes, parts, overlaps and large polygons against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slickwatch.operators import land

RING = "array<struct<x: double, y: double>>"
KIND = f"ring {RING}, holes array<{RING}>"
E2 = 0.0066943799901413165


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(rng, x, y, size, n=9):
    """A concave ring around a point."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = size * rng.uniform(0.35, 1, n)
    return list(zip(x + r * np.cos(angle), y + r * np.sin(angle)))


def box(x, y, s):
    return [(x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s)]


def edges(points):
    p = np.array([*points, points[0]])
    return p[:-1], p[1:]


def odd(points, x, y):
    a, b = edges(points)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return int((((a[:, 1] > y) != (b[:, 1] > y)) & (x < cut)).sum())


def gaps(points, x, y):
    a, b = edges(points)
    d = b - a
    t = np.clip(((x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]) / (d**2).sum(1), 0, 1)
    return np.hypot(a[:, 0] + t * d[:, 0] - x, a[:, 1] + t * d[:, 1] - y).min()


def expected_class(polygons, x, y):
    near = False
    for outer, holes in polygons:
        rings = [outer, *holes]
        if sum(odd(r, x, y) for r in rings) % 2:
            return 0
        near |= min(gaps(r, x, y) for r in rings) <= land.BUFFER_DEG
    return 2 if near else 1


@pytest.mark.parametrize("size", [0.003, 0.02, 0.7])
def test_classes_with_lakes_parts_and_overlaps(spark, size):
    rng = np.random.default_rng(7)
    polygons = [(star(rng, 57 + rng.uniform(0, 0.4), -20 + rng.uniform(0, 0.4), rng.uniform(0.005, 0.08)), []) for _ in range(14)]
    polygons += [(box(57.2, -19.8, 0.15), [star(rng, 57.2, -19.8, 0.12)]), (box(57.2, -19.8, 0.02), [box(57.2, -19.8, 0.01)])]
    polygons += [(box(56.5, -19.9, 0.3), []), polygons[0]]
    df = spark.createDataFrame([(ring(o), [ring(h) for h in holes] or None) for o, holes in polygons], KIND)
    points = [(1, k, 0, 56.9 + rng.uniform(0, 0.6), -20.1 + rng.uniform(0, 0.6)) for k in range(700)] + [(2, 0, 0, 57.2, -19.8), (2, 1, 0, 57.215, -19.8), (2, 1, 0, 57.215, -19.8)]
    pixels = spark.createDataFrame(points, "scene_id int, y int, x int, lon double, lat double")
    got = land.classify_pixels(pixels, df, size).collect()
    assert len(got) == len(points)
    assert {(r.lon, r.lat): r.land_class for r in got} == {(p[3], p[4]): expected_class(polygons, p[3], p[4]) for p in points}
    plan = land.classify_pixels(pixels, df, size)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    bare = land.classify_pixels(pixels, df.limit(0), size)
    assert {r.land_class for r in bare.collect()} == {1}


def test_cells_follow_the_length_of_an_edge(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 5.0, 10.0, 5.0)], "p int, x1 double, y1 double, x2 double, y2 double")
    found = {r.p: r["count"] for r in land._edge_cells(e, 0.01, 0.001).groupBy("p").count().collect()}
    assert found[1] < 5 * 1001 and found[2] < 3 * 1003


def flat(points):
    """Equal-area metres of a ring's corners."""
    e, out = math.sqrt(E2), []
    for x, y in points:
        s = math.sin(math.radians(y))
        q = (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
        out.append((6378137.0 * math.radians(x), 6378137.0 / 2 * q))
    return out


def crosses(p, q):
    a, b = edges(p)
    c, d = edges(q)
    side = lambda a, b, p: (b[:, None, 0] - a[:, None, 0]) * (p[None, :, 1] - a[:, None, 1]) - (b[:, None, 1] - a[:, None, 1]) * (p[None, :, 0] - a[:, None, 0])
    return bool(((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0).T).any())


def expected_distance(candidate, polygons):
    best = math.inf
    for outer, holes in polygons:
        rings = [outer, *holes]
        if sum(odd(r, *candidate[0]) for r in rings) % 2 or any(crosses(candidate, r) for r in rings) or any(odd(candidate, *p) % 2 for r in rings for p in r):
            return 0.0
        for r in rings:
            best = min([best, *(gaps(r, *p) for p in candidate), *(gaps(candidate, *p) for p in r)])
    return best


def test_distance_against_every_edge(spark):
    """Near and far, in lakes and around islands, beside a continent and many specks of land."""
    rng = np.random.default_rng(11)
    lands = [(star(rng, 57 + rng.uniform(0, 1), -20 + rng.uniform(0, 1), 10 ** rng.uniform(-4, -1)), []) for _ in range(60)]
    lands += [(box(62, -20, 2.5), [box(62, -20, 1.0)]), (box(57.5, -18.3, 0.2), [star(rng, 57.5, -18.3, 0.15)])]
    cands = [star(rng, 56 + rng.uniform(0, 3), -21 + rng.uniform(0, 3), 10 ** rng.uniform(-3.5, -1), 7) for _ in range(120)]
    cands += [box(62.3, -20.1, 0.01), box(57.5, -18.3, 0.01), box(57.5, -18.3, 0.5), box(30, 40, 0.01), box(61, -20, 0.3), box(59.6, -20, 0.01)]
    # A star holds its centre only if no angle between corners exceeds a half circle; the first corner decides anyway.
    df = spark.createDataFrame([(ring(o), [ring(h) for h in holes]) for o, holes in lands], KIND)
    rows = spark.createDataFrame([(k, ring(c)) for k, c in enumerate(cands)], f"candidate_id int, ring {RING}")
    got = {r.candidate_id: r.distance_m for r in land.distance_to_land(rows, df).collect()}
    flat_lands = [(flat(o), [flat(h) for h in holes]) for o, holes in lands]
    want = [expected_distance(flat(c), flat_lands) for c in cands]
    assert len(got) == len(cands)
    assert np.allclose([got[k] for k in range(len(cands))], want, rtol=1e-9, atol=1e-6)
    assert sum(w == 0 for w in want) >= 4 and want[len(cands) - 3] > 1e6


def test_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    """Ten times the candidates and land on the same area: about ten times the pairs."""
    counts, kept = [], land.staged

    def counted(df, name):
        out = kept(df, name)
        if name == "near-edges":
            counts.append(out.count())
        return out

    monkeypatch.setattr(land, "staged", counted)
    for n in (300, 3000):
        at = F.rand(5) * 2, F.rand(6) * 2
        shape = lambda s: F.array(*[F.struct((F.lit(57.0) + F.col("a") + dx * s).alias("x"), (F.lit(-21.0) + F.col("b") + dy * s).alias("y")) for dx, dy in box(0, 0, 1) + [(-1, -1)]])
        lands = spark.range(0, n, 1, 4).select(at[0].alias("a"), at[1].alias("b")).select(shape(0.04 / math.sqrt(n)).alias("ring"))
        cands = spark.range(0, n, 1, 3).select(F.col("id").alias("candidate_id"), at[0].alias("a"), at[1].alias("b")).select("candidate_id", shape(0.02 / math.sqrt(n)).alias("ring"))
        assert land.distance_to_land(cands, lands).count() == n
    assert counts[1] < 15 * counts[0]


def test_copies_of_land_places_and_outlines_are_met_once(spark, monkeypatch):
    """More copies of the same land, pixels and candidates give the same results, but no more pairs."""
    rng, met = np.random.default_rng(11), []
    inside, near = land.memberships, land.near_edges
    monkeypatch.setattr(land, "memberships", lambda points, edges, *a, **k: met.append((points.count(), edges.count())) or inside(points, edges, *a, **k))
    monkeypatch.setattr(land, "near_edges", lambda todo, edges, sizes: met.append((todo.count(), edges.count())) or near(todo, edges, sizes))
    islands = [(ring(star(rng, 57 + k * 0.1, -20, 0.03)), [ring(box(57 + k * 0.1, -20, 0.004))]) for k in range(4)]
    outlines = [ring(box(56.95 + 0.05 * k, -20.02, 0.01)) for k in range(6)]
    places = [(56.98 + 0.01 * x, -20.03 + 0.01 * y) for x in range(12) for y in range(6)]
    found = []
    for copies in (1, 5):
        lands = spark.createDataFrame(islands * copies, KIND)
        cands = spark.createDataFrame([(f"{c}-{k}", o) for c in range(copies) for k, o in enumerate(outlines)], f"candidate_id string, ring {RING}")
        pixels = spark.createDataFrame([(c, k, *p) for c in range(copies) for k, p in enumerate(places)], "scene_id long, x long, lon double, lat double")
        classes = {(r.scene_id, r.x): r.land_class for r in land.classify_pixels(pixels, lands).collect()}
        far = {r.candidate_id: r.distance_m for r in land.distance_to_land(cands, lands).collect()}
        assert len(classes) == copies * len(places) and len(far) == copies * len(outlines)
        assert all(classes[c, k] == classes[0, k] for c, k in classes) and all(far[i] == far["0-" + i.split("-")[1]] for i in far)
        found.append(({k: v for k, v in classes.items() if not k[0]}, {k: v for k, v in far.items() if k[0] == "0"}, list(met)))
        met.clear()
    assert found[0] == found[1]
