"""Radar scenes as pixel tables: masks, local contrast, components, tiles.

A scene is rows ``(scene_id, y, x, ...)``. Row and column passes partition by
one image line, whose length is the image width or height; nothing ever holds
a whole scene in one task.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators.ordered import grouped_percentiles
from slickwatch.session import cut_lineage

# Valid range, extraction limits and normalisation bounds in dB.
VALID_DB = (-100.0, 30.0)
MIN_CONTRAST_DB = 3.0
WINDOWS_PX = (51, 151)
MAX_CANDIDATE_FRACTION = 0.15
MIN_COMPONENT_PX = 50
NORM_DB = {"vv_db": (-30.0, 0.0), "vh_db": (-35.0, -5.0)}
# Fixed value: outline points below which the box stands for the rectangle.
FEW_POINTS = 5
#: Side of the tiles in which components are labelled, and the step between rows in a pixel's name.
TILE_PX, ROW = 256, 1 << 31
CHIP_PAD_PX, CHIP_PAD_RATIO, CHIP_MIN_PX = 50, 0.5, 256
MIN_BACKGROUND_PX = 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _in_range(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & F.col(c).between(*VALID_DB)


def with_usable(pixels: DataFrame, ocean: str | None = None) -> DataFrame:
    """Both bands finite and in range, and on water where a mask is given."""
    ok = _in_range("vv_db") & _in_range("vh_db")
    if ocean:
        ok = ok & (F.coalesce(ocean, F.lit(0)) > 0)
    return pixels.withColumn("usable", ok)


def scene_validity(pixels: DataFrame) -> DataFrame:
    return (
        pixels.groupBy("scene_id")
        .agg(
            F.count(F.lit(1)).alias("total_pixels"),
            F.count_if("usable").alias("valid_pixels"),
            (F.max("y") + 1).alias("height"),
            (F.max("x") + 1).alias("width"),
        )
        .withColumn("valid_fraction", F.col("valid_pixels") / F.col("total_pixels"))
    )


def normalise_fixed(pixels: DataFrame, bounds=NORM_DB, eps: float = 1e-6) -> DataFrame:
    """Clip to fixed bounds and scale to 0..1; non-finite reads 0."""
    out = pixels
    for c, (lo, hi) in bounds.items():
        finite = F.col(c).isNotNull() & ~F.isnan(c)
        scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - lo) / (hi - lo + eps)))
        out = out.withColumn(f"{c}_norm", F.when(finite, scaled).otherwise(0.0)).withColumn(
            f"{c}_clipped", F.when(finite, ~F.col(c).between(lo, hi))
        )
    return out


def normalise_robust(pixels: DataFrame, band: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Scale by each scene's own percentiles; scenes with flat bounds fail."""
    cuts = grouped_percentiles(pixels, ["scene_id"], band, {"lower": low, "upper": high}, 0.05)
    flat = F.assert_true(F.col("upper") > F.col("lower"), F.lit("percentile bounds are flat"))
    cuts = cuts.withColumn("_ok", flat).filter(F.col("_ok").isNull()).drop("_ok")
    scaled = (F.col(band) - F.col("lower")) / (F.col("upper") - F.col("lower"))
    return pixels.join(cuts, "scene_id").withColumn(
        f"{band}_norm", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    )


def _line_sums(df: DataFrame, wanted: list[tuple[str, int, str]], line: str, pos: str, size: str) -> DataFrame:
    """Sums over ``pos - r .. pos + r`` of one image line, ends replicated, for all (value, r, out) at once.

    All windows share one partitioning and order, so they are one exchange and
    one sort. Running sums by position make the cost independent of the window:
    the part inside the image is a difference of two running sums, the part
    beyond an end is that end's value as often as the window sticks out. A line
    that lacks a position fails the job.
    """
    line_w = Window.partitionBy("scene_id", line)
    along = line_w.orderBy(pos)
    whole = F.count(F.lit(1)).over(line_w) == F.col(size)
    totals = {}
    for value, r, out in wanted:
        upto = F.sum(value).over(along.rangeBetween(Window.unboundedPreceding, r))
        before = F.coalesce(F.sum(value).over(along.rangeBetween(Window.unboundedPreceding, -r - 1)), F.lit(0.0))
        first = F.max(F.when(F.col(pos) == 0, F.col(value))).over(line_w)
        last = F.max(F.when(F.col(pos) == F.col(size) - 1, F.col(value))).over(line_w)
        over_left = F.greatest(F.lit(0), F.lit(r) - F.col(pos))
        over_right = F.greatest(F.lit(0), F.col(pos) + r - (F.col(size) - 1))
        totals[out] = F.when(whole, upto - before + first * over_left + last * over_right).otherwise(
            F.raise_error(F.lit("a line of the scene lacks pixels")).cast("double")
        )
    return df.withColumns(totals)


def box_means(pixels: DataFrame, wanted: list[tuple[str, int, str]]) -> DataFrame:
    """k x k moving means with edge replication for all (value, k, out): one row pass and one column pass."""
    rows = [(value, k // 2, f"_h{i}") for i, (value, k, _) in enumerate(wanted)]
    df = _line_sums(pixels, rows, "y", "x", "width")
    df = _line_sums(df, [(h, r, f"_v{i}") for i, (_, r, h) in enumerate(rows)], "x", "y", "height")
    means = {out: F.col(f"_v{i}") / float((2 * (k // 2) + 1) ** 2) for i, (_, k, out) in enumerate(wanted)}
    return df.withColumns(means).drop(*[f"_{p}{i}" for i in range(len(wanted)) for p in "hv"])


def box_mean(pixels: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """k x k moving mean with edge replication, in two separable passes."""
    return box_means(pixels, [(value, k, out)])


def filled_scene(pixels: DataFrame) -> DataFrame:
    """Unusable pixels take the scene's median of each band (exact, where a
    strided sample would do for speed on one machine)."""
    names = {"vv_db": "_vv", "vh_db": "_vh"}
    med = long_medians(pixels.filter("usable"), ["scene_id"], names)
    df = pixels.join(med, "scene_id", "left")
    for band, m in names.items():
        df = df.withColumn(
            band.replace("_db", "_filled"), F.when(F.col("usable"), F.col(band)).otherwise(F.col(m))
        )
    return df.drop(*names.values())


def dark_seeds(filled: DataFrame, windows=WINDOWS_PX, min_contrast: float = MIN_CONTRAST_DB) -> DataFrame:
    """Seed where the local mean exceeds the pixel at any window size.

    The per-scale masks are OR-ed in place of a union of pixel sets.
    """
    df = box_means(filled, [("vv_filled", k, f"_bg{k}") for k in windows])
    gaps = [F.col(f"_bg{k}") - F.col("vv_filled") for k in windows]
    seed = F.lit(False)
    for gap in gaps:
        seed = seed | ((gap >= min_contrast) & F.col("usable"))
    contrast = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return df.withColumns({"seed": seed, "contrast": contrast}).drop(*[f"_bg{k}" for k in windows])


def scale_masks(filled: DataFrame, windows, min_contrast: float = MIN_CONTRAST_DB) -> DataFrame:
    """Long table of seeds per window size, for auditing a scale on its own."""
    df = box_means(filled, [("vv_filled", k, f"_bg{k}") for k in windows])
    scales = F.array_compact(F.array(*[F.when((F.col(f"_bg{k}") - F.col("vv_filled") >= min_contrast) & F.col("usable"), F.lit(k)) for k in windows]))
    return df.select("scene_id", "y", "x", F.explode(scales).alias("window_px"))


def saturation(seeds: DataFrame, limit: float = MAX_CANDIDATE_FRACTION) -> DataFrame:
    """Scene status: INSUFFICIENT_DATA without valid pixels or beyond the limit."""
    df = seeds.groupBy("scene_id").agg(
        F.count_if("usable").alias("valid_pixels"), F.count_if("seed").alias("seed_pixels")
    )
    frac = F.try_divide("seed_pixels", "valid_pixels")
    return df.withColumn("seed_fraction", F.coalesce(frac, F.lit(0.0))).withColumn(
        "saturated", F.col("seed_fraction") > limit
    ).withColumn(
        "status",
        F.when((F.col("valid_pixels") == 0) | F.col("saturated"), "INSUFFICIENT_DATA").otherwise("PASS"),
    )


def open_mask(df: DataFrame, mask: str, out: str) -> DataFrame:
    """3 x 3 erosion then dilation; neighbours that the table does not have are ignored.

    Both are separable, and the order of their passes is free: rows, then columns
    twice on one partitioning, then rows.
    """
    row = Window.partitionBy("scene_id", "y").orderBy("x").rangeBetween(-1, 1)
    col = Window.partitionBy("scene_id", "x").orderBy("y").rangeBetween(-1, 1)
    df = df.withColumn("_a", F.min(mask).over(row)).withColumn("_b", F.min("_a").over(col))
    df = df.withColumn("_c", F.max("_b").over(col)).withColumn(out, F.max("_c").over(row))
    return df.drop("_a", "_b", "_c")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of the set of each of n things, joined by the pairs (a, b)."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[a], at[b])
        new = at.copy()
        np.minimum.at(new, at[a], low)
        np.minimum.at(new, at[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == at).all():
            return at
        at = new


def _runs(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of some pixels, and each run's 8-connected label, the number of a run."""
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    first = np.append(True, (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1))
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(y)) - 1
    ry, x0, x1 = y[starts], x[starts], x[ends]
    wide = x.max() - x.min() + 4
    place = lambda row, col: (row - y[0]) * wide + (col - x.min() + 1)
    low = np.searchsorted(place(ry, x1), place(ry + 1, x0 - 1))
    high = np.searchsorted(place(ry, x0), place(ry + 1, x1 + 1), "right")
    count = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(ry)), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return ry, x0, x1, _joined(len(ry), a, b)


def tile_runs(mask_pixels: DataFrame, tile: int) -> DataFrame:
    """Horizontal runs cut at tile borders, labelled inside each tile by their component's first pixel there.

    A tile holds at most tile x tile pixels, whatever the scene.
    """

    def work(pixels: pa.Table) -> pa.Table:
        y, x = pixels.column("y").to_numpy(), pixels.column("x").to_numpy()
        ry, x0, x1, label = _runs(y, x)
        name = ry * ROW + x0
        return pa.table({"scene_id": pa.array(np.full(len(ry), pixels.column("scene_id")[0].as_py())), "y": ry, "x0": x0, "x1": x1, "run": name, "label": name[label]})

    at = lambda c: F.floor(F.col(c) / tile)
    px = mask_pixels.select(*[F.col(c).cast("bigint").alias(c) for c in ("scene_id", "y", "x")])
    return px.groupBy("scene_id", at("y").alias("_ty"), at("x").alias("_tx")).applyInArrow(
        lambda t: work(t), "scene_id bigint, y bigint, x0 bigint, x1 bigint, run bigint, label bigint"
    )


def border_edges(runs: DataFrame, tile: int) -> DataFrame:
    """Pairs of tile labels whose runs touch across a tile border (8-connected)."""
    a = runs.select("scene_id", "y", F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), F.col("label").alias("a"))
    b = runs.select("scene_id", "y", "x0", "x1", F.col("label").alias("b"))
    right = a.filter((F.col("ax1") + 1) % tile == 0).select("scene_id", "a", (F.col("ax1") + 1).alias("x0"), F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("y"))
    beside = right.join(b.filter(F.col("x0") % tile == 0), ["scene_id", "x0", "y"]).select("scene_id", "a", "b")
    strips = F.explode(F.sequence(F.floor((F.col("ax0") - 1) / tile), F.floor((F.col("ax1") + 1) / tile)))
    bottom = a.filter((F.col("y") + 1) % tile == 0).select("scene_id", "a", "ax0", "ax1", (F.col("y") + 1).alias("y"), strips.alias("_tx"))
    top = b.filter(F.col("y") % tile == 0).withColumn("_tx", F.floor(F.col("x0") / tile))
    touching = (F.col("x0") <= F.col("ax1") + 1) & (F.col("x1") >= F.col("ax0") - 1)
    below = bottom.join(top, ["scene_id", "y", "_tx"]).filter(touching).select("scene_id", "a", "b")
    return beside.unionByName(below).filter("a <> b").distinct()


def _each(df: DataFrame, pairs: list[tuple[str, str]], a: str, b: str) -> DataFrame:
    """Every row once per named column pair, in one pass."""
    both = F.array(*[F.struct(F.col(x).alias(a), F.col(y).alias(b)) for x, y in pairs])
    return df.select("scene_id", F.explode(both).alias("_e")).select("scene_id", f"_e.{a}", f"_e.{b}")


def contracted(edges: DataFrame) -> DataFrame | None:
    """scene_id, node, root: least name reachable over pairs (a, b), by alternating large- and small-star; None without pairs.

    Pairs join parts of tiles, so their number follows tile borders, and a part has no
    more neighbours than its tile's border has pixels. Every round is checkpointed
    to the shared folder; the loop only ever moves counts to the driver.
    """
    e = cut_lineage(edges.filter("a <> b"))
    if not e.limit(1).count():
        return None
    while True:
        # Large star: hang every larger neighbour on the least of the neighbourhood.
        both = _each(e, [("a", "b"), ("b", "a")], "a", "b")
        least = both.groupBy("scene_id", "a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (
            both.join(least, ["scene_id", "a"]).filter("b > a").select("scene_id", F.col("b").alias("u"), F.col("m").alias("v"))
        ).filter("u <> v").distinct()
        # Small star: hang the smaller neighbours and the node itself on the least.
        down = large.groupBy("scene_id", "u").agg(F.min("v").alias("m"))
        kept = large.join(down, ["scene_id", "u"])
        small = _each(kept, [("v", "m"), ("u", "m")], "a", "b").filter("a <> b").distinct()
        nxt = cut_lineage(small)
        before = e.select("scene_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        settled = nxt.count() == before.count() and not nxt.join(
            before, ["scene_id", "a", "b"], "left_anti"
        ).limit(1).count()
        e = nxt
        if settled:
            return e.select("scene_id", F.col("a").alias("node"), F.col("b").alias("root"))


def label_components(mask_pixels: DataFrame, tile: int = TILE_PX) -> DataFrame:
    """Runs of the mask with the component label of each, in two levels.

    Tiles label their own runs; only labels that touch across a tile border are
    contracted. A label is the run name of the component's first pixel.
    """
    runs = cut_lineage(tile_runs(mask_pixels, tile))
    roots = contracted(border_edges(runs, tile))
    if roots is None:
        return runs
    named = runs.join(roots.withColumnRenamed("node", "label"), ["scene_id", "label"], "left")
    return named.select("scene_id", "y", "x0", "x1", "run", F.coalesce("root", "label").alias("label"))


#: Normals of a pixel's top, right, bottom and left side as (dy, dx); along a side one travels by the next one's normal.
SIDES = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])


def _outline_parts(y: np.ndarray, x: np.ndarray, top: int, left: int, tile: int) -> dict[str, np.ndarray]:
    """Pieces of outlines inside one tile.

    ``y, x``: the set pixels of the tile and of the one-pixel frame around it. An
    outline goes clockwise along the open sides of pixels: at the end of a side to
    the pixel diagonally ahead, else to the one straight ahead, else round the
    corner. Going from pixel to pixel is a step of length 1 or root 2.
    """
    grid = np.zeros((tile + 4, tile + 4), bool)
    grid[y - top + 2, x - left + 2] = True
    own = np.zeros_like(grid)
    own[2:-2, 2:-2] = grid[2:-2, 2:-2]
    py, px = np.nonzero(own)
    sides, where = [], np.full((4, *grid.shape), -1, np.int64)
    for s, (ny, nx) in enumerate(SIDES):
        open_ = ~grid[py + ny, px + nx]
        sides.append((py[open_], px[open_], np.full(open_.sum(), s)))
    ey, ex, es = (np.concatenate(c) for c in zip(*sides))
    n = len(ey)
    where[es, ey, ex] = np.arange(n)
    normal, along = SIDES[es], SIDES[(es + 1) % 4]

    def look(off: np.ndarray) -> np.ndarray:
        return grid[ey + off[:, 0], ex + off[:, 1]]

    diagonal, straight = look(normal + along), look(along)
    straight &= ~diagonal
    to = np.where(diagonal[:, None], normal + along, np.where(straight[:, None], along, 0))
    side = np.where(diagonal, es + 3, np.where(straight, es, es + 1)) % 4
    ty, tx = ey + to[:, 0], ex + to[:, 1]
    inside = (ty >= 2) & (ty < tile + 2) & (tx >= 2) & (tx < tile + 2)
    target = np.where(inside, where[side, ty, tx], -1)
    back_diagonal, back = look(normal - along), look(-along)
    back &= ~back_diagonal
    source = np.where(back_diagonal[:, None], normal - along, np.where(back[:, None], -along, 0))
    sy, sx = ey + source[:, 0], ex + source[:, 1]
    entered = ~((sy >= 2) & (sy < tile + 2) & (sx >= 2) & (sx < tile + 2))
    # A corner of the outline: a pixel is left in another direction than it was entered.
    turns = np.zeros(n, bool)
    waiting, at = (back_diagonal | back), np.arange(n)
    for _ in range(4):
        moved = diagonal[at] | straight[at]
        turns |= waiting & moved & (to[at] != -source).any(1)
        waiting = waiting & ~moved
        at = np.where(moved, at, target[at])
    links = target >= 0
    part = _joined(n, np.flatnonzero(links), target[links])
    name = ((ey + top - 2) * ROW + (ex + left - 2)) * 4 + es
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, part, name)
    roots, number = np.unique(part, return_inverse=True)
    sums = [np.bincount(number, w, len(roots)).astype(np.int64) for w in (straight, diagonal, turns)]
    out, into = np.flatnonzero(~links), np.flatnonzero(entered)
    ends = np.concatenate([((ty[out] + top - 2) * ROW + (tx[out] + left - 2)) * 4 + side[out], name[into]])
    zeros = np.zeros(len(ends), np.int64)
    return {
        "part": np.concatenate([least[roots], least[part[out]], least[part[into]]]),
        "kind": np.concatenate([np.zeros(len(roots), np.int32), np.full(len(out), 1, np.int32), np.full(len(into), 2, np.int32)]),
        "name": np.concatenate([np.zeros(len(roots), np.int64), ends]),
        **{c: np.concatenate([v, zeros]) for c, v in zip(("straight", "diagonal", "turns"), sums)},
    }


def outlines(mask_pixels: DataFrame, tile: int = TILE_PX) -> DataFrame:
    """scene_id, label, perimeter_px, contour_points of each component's outer outline; holes do not count.

    The outline runs through pixel centres, as an 8-connected contour does; a point
    counts where it turns. Tiles chain their own sides, and only the ends at
    tile borders are joined. The outer outline holds the top side of the first pixel.
    """

    def work(pixels: pa.Table) -> pa.Table:
        scene, ty, tx = (pixels.column(c)[0].as_py() for c in ("scene_id", "_ty", "_tx"))
        found = _outline_parts(pixels.column("y").to_numpy(), pixels.column("x").to_numpy(), ty * tile, tx * tile, tile)
        return pa.table({"scene_id": pa.array(np.full(len(found["part"]), scene)), **found})

    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile)))
    px = mask_pixels.select(*[F.col(c).cast("bigint").alias(c) for c in ("scene_id", "y", "x")])
    px = px.withColumn("_ty", around("y")).withColumn("_tx", around("x"))
    parts = px.groupBy("scene_id", "_ty", "_tx").applyInArrow(
        lambda t: work(t), "scene_id bigint, part bigint, kind int, name bigint, straight bigint, diagonal bigint, turns bigint"
    )
    parts = cut_lineage(parts)
    out = parts.filter("kind = 1").select("scene_id", F.col("part").alias("a"), "name")
    into = parts.filter("kind = 2").select("scene_id", F.col("part").alias("b"), "name")
    roots = contracted(out.join(into, ["scene_id", "name"]).select("scene_id", "a", "b").distinct())
    own = parts.filter("kind = 0")
    if roots is not None:
        own = own.join(roots.withColumnRenamed("node", "part"), ["scene_id", "part"], "left").withColumn("part", F.coalesce("root", "part"))
    loops = own.groupBy("scene_id", "part").agg(*[F.sum(c).alias(c) for c in ("straight", "diagonal", "turns")])
    length = F.col("straight") + F.lit(2.0**0.5) * F.col("diagonal")
    return loops.filter("part % 4 = 0").select(
        "scene_id", F.floor(F.col("part") / 4).alias("label"), length.alias("perimeter_px"), F.greatest("turns", F.lit(1)).cast("bigint").alias("contour_points")
    )


def component_stats(labelled: DataFrame, scenes: DataFrame, min_px: int = MIN_COMPONENT_PX) -> DataFrame:
    """Size, box, centroid and edge contact, straight from the runs."""
    n = F.col("x1") - F.col("x0") + 1
    df = labelled.groupBy("scene_id", "label").agg(
        F.sum(n).cast("bigint").alias("pixels"),
        F.min("x0").alias("left"),
        F.min("y").alias("top"),
        F.max("x1").alias("right"),
        F.max("y").alias("bottom"),
        F.sum(n * F.col("y")).alias("_sy"),
        F.sum((F.col("x0") + F.col("x1")) * n / 2).alias("_sx"),
    )
    df = df.filter(F.col("pixels") >= min_px).join(scenes.select("scene_id", "height", "width"), "scene_id")
    return df.select(
        "scene_id",
        "label",
        "pixels",
        "left",
        "top",
        (F.col("right") - F.col("left") + 1).alias("box_w"),
        (F.col("bottom") - F.col("top") + 1).alias("box_h"),
        (F.col("_sx") / F.col("pixels")).alias("centroid_x"),
        (F.col("_sy") / F.col("pixels")).alias("centroid_y"),
        (
            (F.col("left") == 0)
            | (F.col("top") == 0)
            | (F.col("right") >= F.col("width") - 1)
            | (F.col("bottom") >= F.col("height") - 1)
        ).alias("edge_touching"),
    )


def labelled_pixels(labelled: DataFrame) -> DataFrame:
    return labelled.select(
        "scene_id", "label", "y", F.explode(F.sequence("x0", "x1")).alias("x")
    )


def _rectangle(hull: np.ndarray) -> tuple[float, float, float, float]:
    """Area of a hull, and long side, short side and angle of the least rectangle around it.

    All edges are tried at once. Of rectangles equal to six digits the one of least angle counts.
    """
    if len(hull) < 3:
        w, h = (float(v) for v in np.ptp(hull, axis=0))
        return 0.0, max(w, h), min(w, h), 0.0 if w >= h else 90.0
    x, y = hull[:, 0] - hull[0, 0], hull[:, 1] - hull[0, 1]
    area = abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2
    step = np.roll(hull, -1, axis=0) - hull
    ux, uy = (step / np.hypot(*step.T)[:, None]).T
    w, h = np.ptp(np.outer(x, ux) + np.outer(y, uy), axis=0), np.ptp(np.outer(y, ux) - np.outer(x, uy), axis=0)
    angle = np.degrees(np.arctan2(uy, ux))
    angle = np.round(np.where(np.round(w, 6) >= np.round(h, 6), angle, angle + 90.0) % 180.0, 6) % 180.0
    best = min(range(len(hull)), key=lambda i: (round(w[i] * h[i], 6), angle[i]))
    return area, float(max(w[best], h[best])), float(min(w[best], h[best])), float(angle[best])


def component_geometry(labelled: DataFrame, outline: DataFrame) -> DataFrame:
    """Hull area, axes, angle and outer outline of each component.

    Axes and angle are those of the least rectangle around the hull of pixel
    centres; with under ``FEW_POINTS`` outline points those of the box. Only run ends
    can be hull corners, and each task reduces its runs to hull corners before the
    shuffle, so a component of any size arrives as corners.
    """
    from slickwatch.operators.ensembles import convex_hulls

    keys = ["scene_id", "label"]
    ends = labelled.select(*keys, F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"), "y")
    rings = convex_hulls(ends, keys, "x", "y")

    def measure(batches):
        for batch in batches:
            rows = []
            for ring in batch.column(2):
                flat = ring.values
                hull = np.column_stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()])
                rows.append(_rectangle(hull[:-1] if len(hull) > 3 else hull))
            area, major, minor, angle = (pa.array(c, pa.float64()) for c in (zip(*rows) if rows else ([],) * 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), area, major, minor, angle], [*keys, "hull_area", "_w", "_h", "_angle"])

    shape = rings.select(*keys, "ring").mapInArrow(measure, "scene_id bigint, label bigint, hull_area double, _w double, _h double, _angle double")
    boxes = labelled.groupBy(*keys).agg(
        (F.max("x1") - F.min("x0") + 1.0).alias("_bw"), (F.max("y") - F.min("y") + 1.0).alias("_bh")
    )
    few = F.col("contour_points") < FEW_POINTS
    return shape.join(outline, keys).join(boxes, keys).select(
        *keys,
        "hull_area",
        F.when(few, F.greatest("_bw", "_bh")).otherwise(F.col("_w")).alias("major_px"),
        F.when(few, F.least("_bw", "_bh")).otherwise(F.col("_h")).alias("minor_px"),
        F.when(few, 0.0).otherwise(F.col("_angle")).alias("orientation_deg"),
        "perimeter_px",
        "contour_points",
    )


def component_backscatter(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Band statistics of each component against its local background.

    ``pixels`` carries vv, vh, backgrounds and ``usable`` per labelled pixel.
    """
    df = pixels.withColumn("vv_gap", F.col("vv_bg") - F.col("vv_db")).withColumn(
        "vh_gap", F.col("vh_bg") - F.col("vh_db")
    )
    totals = df.groupBy(*keys).agg(
        F.avg("vv_db").alias("mean_vv"),
        F.avg("vh_db").alias("mean_vh"),
        F.avg(F.col("vv_db") - F.col("vh_db")).alias("vv_vh_diff"),
        F.stddev_pop("vv_db").alias("std_vv"),
        F.avg(F.col("usable").cast("double")).alias("valid_fraction"),
    )
    names = {"vv_db": "median_vv", "vh_db": "median_vh", "vv_gap": "vv_contrast", "vh_gap": "vh_contrast"}
    return totals.join(long_medians(df, keys, names), keys)


def long_medians(df: DataFrame, keys: list[str], names: dict[str, str], bin_width: float = 0.05) -> DataFrame:
    """Exact medians of several columns in one distributed pass."""
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in names])).alias("_s"),
    ).select(*keys, F.col("_s.m").alias("m"), F.col("_s.v").alias("v"))
    med = grouped_percentiles(long, [*keys, "m"], "v", {"p": 0.5}, bin_width)
    return med.groupBy(*keys).agg(
        *[F.max(F.when(F.col("m") == c, F.col("p"))).alias(n) for c, n in names.items()]
    )


def chip_windows(boxes: DataFrame, height, width, min_px: int = CHIP_MIN_PX) -> DataFrame:
    """Chip bounds: padded box, at least ``min_px`` a side, clipped to the scene.

    ``boxes`` has fractional pixel edges ``l, r, t, b``.
    """
    side = F.greatest(F.col("r") - F.col("l"), F.col("b") - F.col("t"))
    pad = F.greatest(F.lit(CHIP_PAD_PX), F.floor(side * CHIP_PAD_RATIO))
    df = boxes.withColumn("_pad", pad)
    for lo, hi, limit, a, z in (("l", "r", width, "chip_left", "chip_right"), ("t", "b", height, "chip_top", "chip_bottom")):
        limit = geo.as_col(limit)
        start = F.greatest(F.lit(0), F.floor(F.col(lo) - F.col("_pad")))
        stop = F.least(limit, F.ceil(F.col(hi) + F.col("_pad")))
        df = df.withColumn("_a", start).withColumn("_z", stop)
        short = F.col("_z") - F.col("_a") < min_px
        moved = F.greatest(F.lit(0), F.col("_a") - F.floor((F.lit(min_px) - (F.col("_z") - F.col("_a"))) / 2))
        df = df.withColumn(a, F.when(short, moved).otherwise(F.col("_a")).cast("bigint"))
        df = df.withColumn(z, F.when(short, F.least(limit, F.col(a) + min_px)).otherwise(F.col("_z")).cast("bigint"))
    return df.drop("_pad", "_a", "_z")


def pixels_in_windows(pixels: DataFrame, windows: DataFrame, key: str, block: int = 64) -> DataFrame:
    """Pixels of each chip: both sides meet on image blocks, then exactly."""
    w = windows.select(
        "scene_id", key, "chip_left", "chip_right", "chip_top", "chip_bottom", "l", "r", "t", "b",
        F.explode(F.sequence(F.floor(F.col("chip_left") / block), F.floor((F.col("chip_right") - 1) / block))).alias("_bx"),
    ).withColumn(
        "_by", F.explode(F.sequence(F.floor(F.col("chip_top") / block), F.floor((F.col("chip_bottom") - 1) / block)))
    )
    p = pixels.withColumn("_bx", F.floor(F.col("x") / block)).withColumn("_by", F.floor(F.col("y") / block))
    inside = (
        (F.col("x") >= F.col("chip_left")) & (F.col("x") < F.col("chip_right"))
        & (F.col("y") >= F.col("chip_top")) & (F.col("y") < F.col("chip_bottom"))
    )
    return p.join(w, ["scene_id", "_bx", "_by"]).filter(inside).drop("_bx", "_by")


def candidate_vs_background(chip_pixels: DataFrame, keys: list[str], inside: str = "inside") -> DataFrame:
    """Band statistics inside the candidate and in the chip around it."""
    ok = F.col("usable")
    df = chip_pixels.withColumn("_c", F.col(inside) & ok).withColumn("_b", ~F.col(inside) & ok)
    aggs, medians = [F.count_if("_b").alias("background_pixels")], {}
    defaults = {}
    for band, (cand, back) in {"vv": (-15.0, -10.0), "vh": (-25.0, -20.0)}.items():
        for tag, mark, empty in (("", "_c", cand), ("bg_", "_b", back)):
            v = F.when(F.col(mark), F.col(f"{band}_db"))
            aggs += [F.avg(v).alias(f"{tag}mean_{band}"), F.stddev_pop(v).alias(f"{tag}std_{band}")]
            df = df.withColumn(f"_{tag}{band}", v)
            medians[f"_{tag}{band}"] = f"{tag}median_{band}"
            defaults |= {f"{tag}mean_{band}": empty, f"{tag}median_{band}": empty, f"{tag}std_{band}": 0.0}
    out = df.groupBy(*keys).agg(*aggs).join(long_medians(df, keys, medians), keys, "left")
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(c, F.lit(value)))
    for band in ("vv", "vh"):
        out = out.withColumn(f"{band}_contrast", F.col(f"bg_median_{band}") - F.col(f"median_{band}"))
    return out.withColumn(
        "quality_flag",
        F.when(F.col("background_pixels") < MIN_BACKGROUND_PX, "INSUFFICIENT_CONTEXT").otherwise("VALID"),
    )


def patch_grid(pixels: DataFrame, scenes: DataFrame, size: int, stride: int, positive: str, min_positive: int) -> DataFrame:
    """Patches with enough positive pixels; a pixel goes to the patches covering it."""
    def origins(c, limit):
        first = F.greatest(F.lit(0), F.ceil((F.col(c) - (size - 1)) / stride))
        last = F.least(F.floor(F.col(c) / stride), F.floor((F.col(limit) - size) / stride))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    df = pixels.join(scenes.select("scene_id", "height", "width"), "scene_id")
    df = df.withColumn("_py", F.explode(origins("y", "height"))).withColumn("_px", F.explode(origins("x", "width")))
    return (
        df.groupBy("scene_id", (F.col("_py") * stride).alias("patch_y"), (F.col("_px") * stride).alias("patch_x"))
        .agg(F.count_if(positive).alias("positives"), F.count(F.lit(1)).alias("pixels"))
        .filter(F.col("positives") >= min_positive)
    )


def tile_origins(limit: Column, size: int, stride: int) -> Column:
    """Tile starts along one side, the last one snapped to the edge."""
    last = F.greatest(F.lit(0), limit - size)
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint")), F.array(last.cast("bigint"))))


def hann(i: Column, size: int) -> Column:
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * np.pi / (size - 1)) * i)


def tile_blend(tiles: DataFrame, size: int, threshold: float = 0.5) -> DataFrame:
    """Blend overlapping tile probabilities, then threshold.

    ``tiles`` holds ``(scene_id, tile_y, tile_x, y, x, p)`` in scene pixels.
    """
    w = F.greatest(
        F.lit(1e-4), hann(F.col("y") - F.col("tile_y"), size) * hann(F.col("x") - F.col("tile_x"), size)
    )
    return (
        tiles.groupBy("scene_id", "y", "x")
        .agg((F.sum(w * F.col("p")) / F.greatest(F.sum(w), F.lit(1e-6))).alias("p"))
        .withColumn("mask", F.col("p") >= threshold)
    )


def alignment_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Do two rasters share shape, reference system, transform and bounds.

    Inputs are metadata tables keyed by scene, never pixels.
    """
    j = a.alias("a").join(b.alias("b"), "scene_id")

    def close(c, tol):
        return F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tol

    problems = F.array_compact(
        F.array(
            F.when(~(F.col("a.dtype").contains("float") & F.col("b.dtype").contains("float")), "dtype"),
            F.when((F.col("a.height") != F.col("b.height")) | (F.col("a.width") != F.col("b.width")), "shape"),
            F.when(F.col("a.crs") != F.col("b.crs"), "crs"),
            F.when(~(close("origin_x", 1e-9) & close("origin_y", 1e-9) & close("px", 1e-9)), "transform"),
            F.when(~close("max_x", 1e-6), "bounds"),
        )
    )
    return j.select("scene_id", problems.alias("problems")).withColumn("aligned", F.size("problems") == 0)


def spill_stats(labelled: DataFrame, scenes: DataFrame, min_px: int = 1) -> DataFrame:
    """Scene totals over a labelled mask; nulls for an empty mask."""
    n = F.col("x1") - F.col("x0") + 1
    comps = labelled.groupBy("scene_id", "label").agg(
        F.sum(n).cast("bigint").alias("px"),
        F.sum(n * F.col("y")).alias("sy"),
        F.sum((F.col("x0") + F.col("x1")) * n / 2).alias("sx"),
    )
    df = comps.groupBy("scene_id").agg(
        F.sum("px").cast("bigint").alias("oil_pixels"),
        F.count_if(F.col("px") >= min_px).alias("components"),
        F.max(F.when(F.col("px") >= min_px, F.col("px"))).alias("_largest"),
        F.sum("sx").alias("_sx"),
        F.sum("sy").alias("_sy"),
    )
    df = scenes.select("scene_id", "total_pixels").join(df, "scene_id", "left")
    oil, n_comp = F.coalesce("oil_pixels", F.lit(0)), F.coalesce("components", F.lit(0))
    some = (oil > 0) & (n_comp > 0)
    return df.select(
        "scene_id",
        oil.cast("bigint").alias("oil_pixels"),
        (oil / F.col("total_pixels")).alias("oil_fraction"),
        n_comp.cast("bigint").alias("components"),
        F.coalesce("_largest", F.lit(0)).cast("bigint").alias("largest_pixels"),
        F.when(some, F.col("_largest") / oil).alias("largest_fraction"),
        F.when(some, n_comp / oil).alias("fragmentation"),
        F.when(some, n_comp * 10000 / oil).alias("components_per_10k"),
        F.when(some, F.col("_sx") / oil).alias("centroid_x"),
        F.when(some, F.col("_sy") / oil).alias("centroid_y"),
    )
