"""Components, outlines and moving means in tiles against plain Python."""

import math

import numpy as np
import pytest

from slickwatch.operators import raster as ra
from test_scenes import flood

KIND = "scene_id bigint, y bigint, x bigint"


def pixels(spark, mask, scene=1):
    return spark.createDataFrame([(scene, int(y), int(x)) for y, x in zip(*np.nonzero(mask))], KIND).repartition(3)


def spiral(n):
    """One pixel wide, winding inwards, with a blank line between the turns."""
    m = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = True
    seen = lambda a, b: 0 <= a < n and 0 <= b < n and m[a, b]
    turns = 0
    while turns < 2:
        a, b = y + dy, x + dx
        if 0 <= a < n and 0 <= b < n and not m[a, b] and not seen(a + dy, b + dx):
            y, x, turns = a, b, 0
            m[y, x] = True
        else:
            dy, dx, turns = dx, -dy, turns + 1
    return m


MASKS = {
    "noise": np.random.default_rng(5).random((40, 61)) < 0.42,
    "dense": np.random.default_rng(6).random((30, 30)) < 0.7,
    "spiral": spiral(41),
    "comb": np.indices((33, 34))[1] % 2 == 0,
    "ring": np.abs(np.hypot(*(np.indices((50, 50)) - 25)) - 15) < 3,
    "full": np.ones((23, 23), bool),
}
MASKS["comb"][0] = True  # a hub: one row that all teeth hang on


@pytest.mark.parametrize("tile", [5, 16, 256])
@pytest.mark.parametrize("name", MASKS)
def test_labels_in_tiles(spark, name, tile):
    mask = MASKS[name]
    lab = ra.label_components(pixels(spark, mask), tile)
    got, want = ra.labelled_pixels(lab).collect(), flood(mask)
    assert len(got) == mask.sum()
    pairs = {(r.label, want[r.y, r.x]) for r in got}
    assert len(pairs) == want.max() == len({a for a, _ in pairs})
    firsts = {want[y, x]: y * ra.ROW + x for y, x in reversed(list(zip(*np.nonzero(mask))))}
    assert {b: a for a, b in pairs} == firsts


def test_contraction_follows_borders(spark):
    """Four times the pixels in the same tiles: twice the pairs, as the borders."""
    counts = []
    for n in (64, 128):
        mask = np.ones((n, n), bool)
        mask[1::2, 1::3] = False
        runs = ra.tile_runs(pixels(spark, mask), n // 4)
        counts.append((runs.count(), ra.border_edges(runs, n // 4).count()))
    assert counts[1][0] > 3.5 * counts[0][0] and counts[1][1] <= 2 * counts[0][1]


def traced(mask, start):
    """Length and corners of the outer outline from the first pixel, walked side by side."""
    sides = [(-1, 0), (0, 1), (1, 0), (0, -1)]
    on = lambda y, x: 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x]
    y, x, s, steps = *start, 0, []
    while True:
        (ny, nx), (ay, ax) = sides[s], sides[(s + 1) % 4]
        if on(y + ny + ay, x + nx + ax):
            y, x, s, step = y + ny + ay, x + nx + ax, (s + 3) % 4, (ny + ay, nx + ax)
        elif on(y + ay, x + ax):
            y, x, step = y + ay, x + ax, (ay, ax)
        else:
            s, step = (s + 1) % 4, None
        if step:
            steps.append(step)
        if (y, x, s) == (*start, 0):
            break
    return sum(math.hypot(*p) for p in steps), max(1, sum(p != q for p, q in zip(steps, [*steps[-1:], *steps[:-1]])))


@pytest.mark.parametrize("tile", [4, 16, 256])
@pytest.mark.parametrize("name", MASKS)
def test_outlines_in_tiles(spark, name, tile):
    mask = MASKS[name]
    labels = flood(mask)
    got = {r.label: (r.perimeter_px, r.contour_points) for r in ra.outlines(pixels(spark, mask), tile).collect()}
    firsts = {labels[y, x]: (y, x) for y, x in reversed(list(zip(*np.nonzero(mask))))}
    want = {y * ra.ROW + x: traced(labels == k, (y, x)) for k, (y, x) in firsts.items()}
    # Inner outlines may begin with a top side too; only those of first pixels are asked for.
    assert {k: got[k][1] for k in want} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_known_outlines(spark):
    """A block, a line, a single pixel and a block with a hole."""
    mask = np.zeros((40, 40), bool)
    mask[2:8, 3:13] = mask[20, 5:25] = mask[30, 30] = True
    mask[25:35, 5:15], mask[28:31, 8:11] = True, False
    got = {(r.label // ra.ROW, r.label % ra.ROW): (r.perimeter_px, r.contour_points) for r in ra.outlines(pixels(spark, mask), 9).collect()}
    assert got[2, 3] == (28.0, 4) and got[20, 5] == (38.0, 2) and got[30, 30] == (0.0, 1) and got[25, 5] == (36.0, 4)


def test_geometry(spark):
    """An upright block falls back on its box; a tilted bar has its own axes; both from one labelling."""
    mask = np.zeros((60, 120), bool)
    mask[10:20, 20:100] = True
    y, x = np.indices(mask.shape) - np.array([25, 24])[:, None, None]
    mask |= (y + x >= 0) & (y + x <= 58) & (np.abs(y - x) <= 4) & (y <= 30)
    px = pixels(spark, mask)
    rows = {r.label // ra.ROW: r for r in ra.component_geometry(ra.label_components(px, 32), ra.outlines(px, 32)).collect()}
    block, bar = rows[10], rows[23]
    assert (block.major_px, block.minor_px, block.orientation_deg, block.hull_area, block.contour_points) == (80.0, 10.0, 0.0, 79 * 9, 4)
    assert bar.orientation_deg == 45.0 and abs(bar.minor_px - 8 * math.sqrt(0.5)) < 1e-6 and abs(bar.major_px - 58 * math.sqrt(0.5)) < 1e-6


def test_octagon_drops_no_corner():
    rng = np.random.default_rng(1)
    for pts in (rng.normal(size=(500, 2)), rng.integers(0, 9, (400, 2)).astype(float), np.column_stack([np.arange(50.0), np.arange(50.0)]), np.ones((40, 2))):
        from slickwatch.operators import ensembles as ens

        kept = ens._outer(pts)
        assert {tuple(p) for p in ens._hull(*pts[: len(pts)].T)} == {tuple(p) for p in ens._hull(*kept.T)}
    assert len(ens._outer(rng.normal(size=(5000, 2)))) < 1500


def test_means_share_their_passes(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 30))
    rows = [(1, y, x, float(v[y, x]), 20, 30) for y in range(20) for x in range(30)]
    df = spark.createDataFrame(rows, KIND + ", v double, height int, width int")
    out = ra.box_means(df, [("v", 3, "a"), ("v", 9, "b"), ("v", 41, "c")])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    for r in out.collect():
        for k, got in ((3, r.a), (9, r.b), (41, r.c)):
            at = lambda i, n: np.clip(np.arange(i - k // 2, i + k // 2 + 1), 0, n - 1)
            assert abs(got - v[np.ix_(at(r.y, 20), at(r.x, 30))].mean()) < 1e-9


def test_opening(spark):
    mask = np.random.default_rng(3).random((25, 25)) < 0.85
    df = spark.createDataFrame([(1, y, x, int(mask[y, x])) for y in range(25) for x in range(25)], KIND + ", m int")
    near = lambda m, y, x, f: f(m[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2])
    worn = np.array([[near(mask, y, x, np.min) for x in range(25)] for y in range(25)])
    for r in ra.open_mask(df, "m", "out").collect():
        assert r.out == near(worn, r.y, r.x, np.max)
