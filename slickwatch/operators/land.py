"""Pixels and candidates against land polygons with holes, as edges on cells.

A polygon is a set of edges, those of its outer ring and of its holes alike. An
edge is a row in every cell it touches, so a continent is never one array and work
follows the length of a coastline. For each polygon and cell a mark says whether
the cell's reference point is inside; a point of the cell is inside if an odd
number of the cell's own edges lies on the path from there. Cells without edges
are wholly inside or outside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators.spatial import with_box_cells
from slickwatch.session import staged

# Coastal buffer in degrees, distance when there is no land.
BUFFER_DEG = 500.0 / 111320.0
NO_LAND_M = 999999.0
LAND, OCEAN, BUFFER = 0, 1, 2
#: Place of a cell's reference point, off any plausible lattice of vertices.
REFERENCE = 0.5123456789
#: Ratio of cell sizes, and levels below the mean spacing of edges.
WIDENED, FINER = 4.0, 3


def polygon_edges(polygons: DataFrame, keys: list[str], project: bool = False) -> DataFrame:
    """``keys``, x1, y1, x2, y2: edges of ``ring`` and, where there is such a column, of all ``holes``.

    Rows of equal keys are parts of one polygon. Edges of no length are left out.
    """
    shape = geo.equal_area_ring if project else (lambda r: r)
    every = geo.edges(shape(F.col("ring")))
    if "holes" in polygons.columns:
        inner = F.flatten(F.transform(F.coalesce("holes", F.array().cast(polygons.schema["holes"].dataType)), lambda h: geo.edges(shape(h))))
        every = F.concat(every, inner)
    each = polygons.select(*keys, F.explode(every).alias("_e")).select(*keys, "_e.*")
    return each.filter("x1 <> x2 OR y1 <> y2")


def _edge_cells(edges: DataFrame, size: float, reach: float) -> DataFrame:
    """Each edge once for every cell it touches or comes within ``reach`` of; cells follow its length, not its box."""
    low, high = F.least("y1", "y2") - reach, F.greatest("y1", "y2") + reach
    rows = edges.withColumn("_cy", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * ((y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    inside = lambda y: F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), y))
    flat = F.col("y1") == F.col("y2")
    a = F.when(flat, F.col("x1")).otherwise(at(inside(F.col("_cy") * size - reach)))
    b = F.when(flat, F.col("x2")).otherwise(at(inside((F.col("_cy") + 1) * size + reach)))
    room = reach + size * 1e-6
    return rows.withColumn("_cx", F.explode(F.sequence(F.floor((F.least(a, b) - room) / size), F.floor((F.greatest(a, b) + room) / size))))


def _marked_cells(edges: DataFrame, keys: list[str], size: float) -> DataFrame:
    """``keys``, _cx, _cy of the cells whose reference point is inside a polygon.

    The line through a row's reference points is cut by the polygon's edges; between
    an odd cut and the next lies the inside.
    """
    low, high = F.least("y1", "y2") / size - REFERENCE, F.greatest("y1", "y2") / size - REFERENCE
    rows = edges.withColumn("_cy", F.explode(F.filter(F.sequence(F.floor(low), F.ceil(high)), lambda k: (k >= low) & (k < high))))
    y = (F.col("_cy") + REFERENCE) * size
    cuts = rows.select(*keys, "_cy", ((F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("_cut"))
    along = Window.partitionBy(*keys, "_cy").orderBy("_cut")
    spans = cuts.withColumn("_n", F.row_number().over(along)).withColumn("_to", F.lead("_cut").over(along)).filter("_n % 2 = 1")
    first, last = F.ceil(F.col("_cut") / size - REFERENCE), F.ceil(F.col("_to") / size - REFERENCE) - 1
    return spans.filter(first <= last).select(*keys, F.explode(F.sequence(first, last)).alias("_cx"), "_cy")


def memberships(
    points: DataFrame, edges: DataFrame, size: float, x: str, y: str, key: list[str], polygon: str, also: list[str] | None = None, reach: float = 0.0
) -> DataFrame:
    """Points inside a polygon or within ``reach`` of its outline: ``key``, ``polygon``, inside, near.

    ``key`` identifies a point, ``also`` are columns both sides must share. A
    point on an outline is not inside. Nothing that grows with the polygons is
    broadcast: its size packed says little of what the driver would hold.
    """
    also = also or []
    on = [*also, "_cx", "_cy"]
    p = points.select(*dict.fromkeys([*key, *also]), F.col(x).alias("_x"), F.col(y).alias("_y"))
    p = p.withColumn("_cx", F.floor(F.col("_x") / size)).withColumn("_cy", F.floor(F.col("_y") / size))
    own = [*also, polygon]
    local = _edge_cells(edges, size, reach)
    marks = _marked_cells(edges, own, size)
    with_edges = local.select(*own, "_cx", "_cy").distinct()
    whole = marks.join(with_edges.hint("merge"), [*own, "_cx", "_cy"], "left_anti")
    start = marks.withColumn("_in", F.lit(1))
    rx, ry = (F.col("_cx") + REFERENCE) * size, (F.col("_cy") + REFERENCE) * size
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    px, py = F.col("_x"), F.col("_y")
    cut_x = dx * (py - F.col("y1")) / F.when(dy != 0, dy) + F.col("x1")
    cut_y = dy * (rx - F.col("x1")) / F.when(dx != 0, dx) + F.col("y1")
    level = F.when(((F.col("y1") > py) != (F.col("y2") > py)) & ((px < cut_x) != (rx < cut_x)), 1).otherwise(0)
    plumb = F.when(((F.col("x1") > rx) != (F.col("x2") > rx)) & ((py < cut_y) != (ry < cut_y)), 1).otherwise(0)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / (dx * dx + dy * dy)))
    gap = F.sqrt(F.pow(F.col("x1") + share * dx - px, 2.0) + F.pow(F.col("y1") + share * dy - py, 2.0))
    touching = (
        (dx * (py - F.col("y1")) - dy * (px - F.col("x1")) == 0)
        & px.between(F.least("x1", "x2"), F.greatest("x1", "x2"))
        & py.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    )
    met = (
        p.join(local.hint("merge"), on)
        .select(*key, *own, "_cx", "_cy", (level + plumb).alias("_odd"), touching.alias("_on"), gap.alias("_gap"))
        .groupBy(*dict.fromkeys([*key, *own]), "_cx", "_cy")
        .agg(F.sum("_odd").alias("_odd"), F.max("_on").alias("_on"), F.min("_gap").alias("_gap"))
        .join(start.hint("merge"), [*own, "_cx", "_cy"], "left")
        .select(
            *dict.fromkeys([*key, *own]),
            (((F.col("_odd") + F.coalesce("_in", F.lit(0))) % 2 == 1) & ~F.col("_on")).alias("inside"),
            (F.col("_gap") <= reach).alias("near"),
        )
        .filter("inside OR near")
    )
    held = p.join(whole.hint("merge"), on).select(*dict.fromkeys([*key, *own]), F.lit(True).alias("inside"), F.lit(False).alias("near"))
    return met.unionByName(held)


def with_ids(polygons: DataFrame, name: str = "_polygon") -> DataFrame:
    """``ring`` and ``holes`` with a number for each shape, written once so that the numbers stay; equal rows are one shape."""
    columns = [c for c in ("ring", "holes") if c in polygons.columns]
    return staged(polygons.select(*columns).distinct().withColumn(name, F.monotonically_increasing_id()), "polygons")


def classify_pixels(pixels: DataFrame, land: DataFrame, size: float = 0.02) -> DataFrame:
    """Class of each pixel centre (lon, lat): 0 land, 1 ocean, 2 coastal buffer.

    ``land`` has ``ring`` and perhaps ``holes``; water in a hole is water, and its
    shore has a buffer. Polygons may overlap. Pixels of scenes on one grid share
    their centres, and a place is classified once.
    """
    edges = polygon_edges(with_ids(land), ["_polygon"])
    places = pixels.select("lon", "lat").distinct()
    found = memberships(places, edges, size, "lon", "lat", ["lon", "lat"], "_polygon", reach=BUFFER_DEG)
    classes = found.groupBy("lon", "lat").agg(F.max("inside").alias("_land"))
    df = pixels.join(classes, ["lon", "lat"], "left").select(*pixels.columns, "_land")
    return df.withColumn("land_class", F.when(F.col("_land"), LAND).when(F.col("_land").isNotNull(), BUFFER).otherwise(OCEAN)).drop("_land")


def candidate_overlap(candidates: DataFrame, classed: DataFrame, size: float = 0.02) -> DataFrame:
    """Share of each candidate's pixels on land and in the coastal buffer.

    The buffer is the grown land, so land pixels count in both.
    """
    edges = polygon_edges(candidates, ["scene_id", "candidate_id"])
    hits = memberships(classed, edges, size, "lon", "lat", ["scene_id", "y", "x", "land_class"], "candidate_id", also=["scene_id"]).filter("inside")
    counts = hits.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(F.col("land_class") == LAND).alias("land_pixels"),
        F.count_if(F.col("land_class") != OCEAN).alias("buffer_pixels"),
    )
    df = candidates.select("candidate_id").join(counts.hint("merge"), "candidate_id", "left")
    n = F.greatest(F.coalesce("pixels", F.lit(0)), F.lit(1))
    land, buf = F.coalesce("land_pixels", F.lit(0)) / n, F.coalesce("buffer_pixels", F.lit(0)) / n
    return df.select(
        "candidate_id",
        F.coalesce("pixels", F.lit(0)).cast("bigint").alias("pixels"),
        land.alias("land_fraction"),
        buf.alias("buffer_fraction"),
        F.greatest(F.lit(0.0), F.lit(1.0) - land - buf).alias("ocean_fraction"),
    )


def _levels(boxes: list, count: int) -> list[float]:
    """Cell sizes from below the mean spacing of edges up to one that covers both sides' extent."""
    wide = max(b.max_x for b in boxes) - min(b.min_x for b in boxes)
    high = max(b.max_y for b in boxes) - min(b.min_y for b in boxes)
    extent = max(wide, high, 1.0)
    sizes = [extent / math.sqrt(max(count, 1)) / WIDENED**FINER]
    while sizes[-1] <= extent:
        sizes.append(sizes[-1] * WIDENED)
    return sizes


def _gap(a: str, b: str) -> Column:
    """Distance of two boxes, whose columns carry the prefixes."""
    x = F.greatest(F.col(f"{b}min_x") - F.col(f"{a}max_x"), F.col(f"{a}min_x") - F.col(f"{b}max_x"), F.lit(0.0))
    y = F.greatest(F.col(f"{b}min_y") - F.col(f"{a}max_y"), F.col(f"{a}min_y") - F.col(f"{b}max_y"), F.lit(0.0))
    return F.sqrt(x * x + y * y)


def _first_bounds(todo: DataFrame, edges: DataFrame, sizes: list[float]) -> DataFrame:
    """candidate_id, ub: the distance of a candidate's first corner to some corner of land near it.

    Every level keeps one corner of land for each cell and the cells around it,
    so a candidate reads one row a level. The top level covers everything.
    """
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(sizes)])
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    own = edges.select("x1", "y1", F.explode(steps).alias("l"))
    own = own.groupBy(F.col("l.k").alias("k"), F.floor(F.col("x1") / F.col("l.s")).alias("cx"), F.floor(F.col("y1") / F.col("l.s")).alias("cy")).agg(
        F.min(F.struct("x1", "y1")).alias("p")
    )
    spread = own.select("k", "cx", "cy", "p", F.explode(moves).alias("m"))
    known = spread.groupBy("k", (F.col("cx") + F.col("m.i")).alias("cx"), (F.col("cy") + F.col("m.j")).alias("cy")).agg(F.min("p").alias("p"))
    asks = todo.select("candidate_id", "px", "py", F.explode(steps).alias("l")).select(
        "candidate_id", "px", "py", F.col("l.k").alias("k"), F.floor(F.col("px") / F.col("l.s")).alias("cx"), F.floor(F.col("py") / F.col("l.s")).alias("cy")
    )
    far = F.sqrt(F.pow(F.col("p.x1") - F.col("px"), 2.0) + F.pow(F.col("p.y1") - F.col("py"), 2.0))
    return asks.join(known, ["k", "cx", "cy"]).groupBy("candidate_id").agg(F.min(far).alias("ub"))


def near_edges(todo: DataFrame, edges: DataFrame, sizes: list[float]) -> DataFrame:
    """Pairs of a candidate and a land edge whose boxes are no further apart than the candidate's bound, each once.

    An edge lies on all levels from that of its own size upwards. A candidate looks
    on the level of its bound, and above it for the edges of those levels' own size.
    A pair counts in the cell of the lower left corner of the two boxes' overlap.
    """
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(sizes)])
    level = lambda extent: F.size(F.filter(steps, lambda l: l["s"] < extent))
    top = len(sizes) - 1
    long = F.greatest(F.col("e_max_x") - F.col("e_min_x"), F.col("e_max_y") - F.col("e_min_y"))
    e = edges.withColumn("_own", F.least(level(long), F.lit(top)))
    e = e.withColumn("_l", F.explode(F.filter(steps, lambda l: l["k"] >= F.col("_own")))).withColumn("_k", F.col("_l.k")).withColumn("_s", F.col("_l.s"))
    e = _cells(e, "e_min_x", "e_min_y", "e_max_x", "e_max_y").withColumn("_native", F.col("_own") == F.col("_k")).drop("_l", "_own", "_s")
    c = todo
    for side, sign in (("min", -1), ("max", 1)):
        for axis in "xy":
            c = c.withColumn(f"w_{side}_{axis}", F.col(f"c_{side}_{axis}") + sign * F.col("ub"))
    wide = F.greatest(F.col("w_max_x") - F.col("w_min_x"), F.col("w_max_y") - F.col("w_min_y"))
    c = c.withColumn("_own", F.least(level(wide), F.lit(top)))
    c = c.withColumn("_l", F.explode(F.filter(steps, lambda l: l["k"] >= F.col("_own")))).withColumn("_k", F.col("_l.k")).withColumn("_s", F.col("_l.s"))
    c = _cells(c, "w_min_x", "w_min_y", "w_max_x", "w_max_y").withColumn("_base", F.col("_own") == F.col("_k")).drop("_l", "_own")
    owner = (F.floor(F.greatest("w_min_x", "e_min_x") / F.col("_s")) == F.col("_cx")) & (F.floor(F.greatest("w_min_y", "e_min_y") / F.col("_s")) == F.col("_cy"))
    pairs = c.join(e, ["_k", "_cx", "_cy"]).filter((F.col("_base") | F.col("_native")) & owner).withColumn("lb", _gap("c_", "e_"))
    return pairs.filter("lb <= ub").select("candidate_id", "px", "py", "x1", "y1", "x2", "y2", "lb")


def _cells(df: DataFrame, min_x: str, min_y: str, max_x: str, max_y: str) -> DataFrame:
    """Each box once for every cell of its own row's size ``_s``."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.col("_s")), F.floor(F.col(b) / F.col("_s"))))
    return df.withColumn("_cx", span(min_x, max_x)).withColumn("_cy", span(min_y, max_y))


def _distances(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """candidate_id, distance_m: least distance of the paired edges; 0 where an edge crosses or starts inside."""
    s = sides.select("candidate_id", *[F.col(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")])
    rows = pairs.join(s, "candidate_id")
    a, b = ("s_x1", "s_y1", "s_x2", "s_y2"), ("x1", "y1", "x2", "y2")

    def side(e, x, y):
        return (F.col(e[2]) - F.col(e[0])) * (F.col(y) - F.col(e[1])) - (F.col(e[3]) - F.col(e[1])) * (F.col(x) - F.col(e[0]))

    def squared(e, x, y):
        dx, dy = F.col(e[2]) - F.col(e[0]), F.col(e[3]) - F.col(e[1])
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(x) - F.col(e[0])) * dx + (F.col(y) - F.col(e[1])) * dy) / (dx * dx + dy * dy)))
        return F.pow(F.col(e[0]) + t * dx - F.col(x), 2.0) + F.pow(F.col(e[1]) + t * dy - F.col(y), 2.0)

    crossing = (side(a, b[0], b[1]) * side(a, b[2], b[3]) < 0) & (side(b, a[0], a[1]) * side(b, a[2], a[3]) < 0)
    d2 = F.least(squared(a, b[0], b[1]), squared(a, b[2], b[3]), squared(b, a[0], a[1]), squared(b, a[2], a[3]))
    cut = (F.col("s_x2") - F.col("s_x1")) * (F.col("y1") - F.col("s_y1")) / F.when(F.col("s_y2") != F.col("s_y1"), F.col("s_y2") - F.col("s_y1")) + F.col("s_x1")
    odd = F.when(((F.col("s_y1") > F.col("y1")) != (F.col("s_y2") > F.col("y1"))) & (F.col("x1") < cut), 1).otherwise(0)
    each = rows.select("candidate_id", *b, F.when(crossing, 0.0).otherwise(d2).alias("_d2"), odd.alias("_odd"))
    by_edge = each.groupBy("candidate_id", *b).agg(F.min("_d2").alias("_d2"), F.sum("_odd").alias("_odd"))
    d = F.when(F.col("_odd") % 2 == 1, 0.0).otherwise(F.sqrt("_d2"))
    return by_edge.groupBy("candidate_id").agg(F.min(d).alias("distance_m"))


def distance_to_land(candidates: DataFrame, land: DataFrame) -> DataFrame:
    """Least distance from each candidate polygon to land, equal-area metres; 0 where they meet.

    Filter and refine: an upper bound from one corner of land near each candidate;
    the edges whose box is not beyond it; a tighter bound from those edges' ends;
    and only what is left is measured. A candidate whose first corner is on land has
    distance 0; one in a lake is measured to its shore. Without any land all
    candidates get NO_LAND_M. Equal outlines, of land or of candidates, are measured once.
    """
    lands = with_ids(land)
    edges = polygon_edges(lands, ["_polygon"], project=True)
    for side, pick in (("min", F.least), ("max", F.greatest)):
        for axis in "xy":
            edges = edges.withColumn(f"e_{side}_{axis}", pick(f"{axis}1", f"{axis}2"))
    edges = staged(edges, "land-edges")
    shapes = with_ids(candidates.select("ring"), "_shape")
    ring = geo.equal_area_ring(F.col("ring"))
    todo = shapes.select(F.col("_shape").alias("candidate_id"), ring.alias("ring")).withColumn("_b", geo.ring_bbox(F.col("ring")))
    boxes = [F.col(f"_b.{side}_{axis}").alias(f"c_{side}_{axis}") for side in ("min", "max") for axis in "xy"]
    todo = staged(todo.select("candidate_id", "ring", F.col("ring")[0]["x"].alias("px"), F.col("ring")[0]["y"].alias("py"), *boxes), "candidates")
    spans = [
        df.agg(*[f(f"{p}_{s}_{x}").alias(f"{s}_{x}") for s, f in (("min", F.min), ("max", F.max)) for x in "xy"], F.count("*").alias("n")).first()
        for df, p in ((todo, "c"), (edges, "e"))
    ]
    if any(x.min_x is None for x in spans):
        return candidates.select("candidate_id", F.lit(NO_LAND_M).alias("distance_m"))
    sizes = _levels(spans, spans[1].n)
    bounded = todo.join(_first_bounds(todo, edges, sizes), "candidate_id").drop("ring")
    pairs = staged(near_edges(bounded, edges, sizes), "near-edges")
    far = F.sqrt(F.pow(F.col("x1") - F.col("px"), 2.0) + F.pow(F.col("y1") - F.col("py"), 2.0))
    tight = pairs.groupBy("candidate_id").agg(F.min(far).alias("_ub"))
    left = pairs.join(tight, "candidate_id").filter("lb <= _ub").select("candidate_id", "x1", "y1", "x2", "y2")
    sides = polygon_edges(todo.select("candidate_id", "ring"), ["candidate_id"])
    measured = _distances(left, sides)
    spot = math.sqrt((spans[1].max_x - spans[1].min_x + 1.0) * (spans[1].max_y - spans[1].min_y + 1.0) / max(spans[1].n, 1))
    ashore = memberships(todo, edges.select("_polygon", "x1", "y1", "x2", "y2"), spot, "px", "py", ["candidate_id"], "_polygon").filter("inside")
    on_land = ashore.select("candidate_id").distinct().withColumn("_in", F.lit(True))
    measured = measured.join(on_land, "candidate_id", "left").select(
        F.col("candidate_id").alias("_shape"), F.when(F.col("_in"), 0.0).otherwise(F.col("distance_m")).alias("distance_m")
    )
    known = shapes.select("_shape", "ring").join(measured, "_shape")
    return candidates.select("candidate_id", "ring").join(known.hint("merge"), "ring").select("candidate_id", "distance_m")
