"""Exact area of the intersection of two polygons, in columns.

Cut at the x of every corner and of every crossing of the two outlines, the
polygons have straight sides within a slab, so the length that a vertical line
has in common with both changes evenly: the slab's share is its width times that
length at its middle. Concave rings and holes need nothing else, as a line is
inside where an odd number of sides lies below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.session import cut_lineage


def _sides(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, b (second polygon), x1 < x2, y1, y2, area2: sides of both polygons but the upright ones; area2 is signed."""
    each = []
    for rings, second in (("a", False), ("b", True)):
        ring = pairs.select(*keys, F.explode(rings).alias("_r")).filter(F.size("_r") > 3)
        side = ring.select(*keys, F.col("_r")[0].alias("_o"), F.explode(geo.edges(F.col("_r"))).alias("e"))
        each.append(side.select(*keys, F.lit(second).alias("second"), "e.*", "_o"))
    both = each[0].unionByName(each[1])
    ox, oy = F.col("_o.x"), F.col("_o.y")
    area2 = (F.col("x1") - ox) * (F.col("y2") - oy) - (F.col("x2") - ox) * (F.col("y1") - oy)
    flip = F.col("x1") > F.col("x2")
    ends = {f"{c}{k}": F.when(flip, F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")) for c in "xy" for k in (1, 2)}
    return both.select(*keys, "second", area2.alias("area2"), *[v.alias(k) for k, v in ends.items()])


def intersection(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, area_a, area_b, area_both of the polygons in columns ``a`` and ``b``.

    Each is an array of closed rings: an outer ring, and holes that turn the other
    way. ``keys`` name a pair. A null, an empty array or a ring under three corners
    has area 0; every pair gets a row.
    """
    sides = cut_lineage(_sides(pairs, keys))
    p, q = sides.filter("NOT second").drop("area2", "second"), sides.filter("second").drop("area2", "second")
    other = q.select(*keys, *[F.col(f"{c}{k}").alias(f"o{c}{k}") for c in "xy" for k in (1, 2)])
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    turn = dx * ey - dy * ex
    gx, gy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    t, u = (gx * ey - gy * ex) / F.when(turn != 0, turn), (gx * dy - gy * dx) / F.when(turn != 0, turn)
    crossing = p.join(other, keys).filter((F.col("x1") < F.col("ox2")) & (F.col("ox1") < F.col("x2")))
    crossing = crossing.filter(t.between(0, 1) & u.between(0, 1)).select(*keys, (F.col("x1") + t * dx).alias("x"))
    corners = sides.select(*keys, F.explode(F.array("x1", "x2")).alias("x"))
    cuts = corners.unionByName(crossing).distinct()
    slab = cuts.withColumn("_to", F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))).filter("_to IS NOT NULL")
    slab = slab.select(*keys, F.col("x").alias("_x"), (F.col("_to") - F.col("x")).alias("_w"), ((F.col("x") + F.col("_to")) / 2).alias("_m"))
    met = slab.join(sides, keys).filter((F.col("x1") < F.col("_m")) & (F.col("_m") < F.col("x2")))
    y = F.col("y1") + (F.col("y2") - F.col("y1")) * ((F.col("_m") - F.col("x1")) / (F.col("x2") - F.col("x1")))
    met = met.select(*keys, "_x", "_w", "second", y.alias("_y"))
    up = Window.partitionBy(*keys, "_x").orderBy("_y", "second")
    below = {name: F.count_if(mark).over(up.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1 for name, mark in (("_a", ~F.col("second")), ("_b", F.col("second")))}
    spans = met.withColumns({**below, "_h": F.lead("_y").over(up) - F.col("_y")}).filter("_a AND _b")
    both = spans.groupBy(*keys).agg(F.sum(F.col("_w") * F.col("_h")).alias("area_both"))
    areas = sides.groupBy(*keys).agg(
        *[(F.abs(F.sum(F.when(F.col("second") == s, F.col("area2")))) / 2).alias(n) for n, s in (("area_a", False), ("area_b", True))]
    )
    found = areas.join(both, keys, "left")
    return pairs.select(*keys).join(found, keys, "left").select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("area_a", "area_b", "area_both")])


def overlap_ratio(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, iou: intersection over union; 0 where either polygon is empty."""
    df = intersection(pairs, keys)
    union = F.col("area_a") + F.col("area_b") - F.col("area_both")
    some = (F.col("area_a") > 0) & (F.col("area_b") > 0) & (union > 0)
    return df.select(*keys, F.when(some, F.col("area_both") / union).otherwise(0.0).alias("iou"))
