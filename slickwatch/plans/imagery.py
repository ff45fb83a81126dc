"""Queries on pixel tables, land and fragment groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.functions.shape import pixel_to_map
from slickwatch.operators import candidates as cand
from slickwatch.operators import grouping
from slickwatch.operators import land as ld
from slickwatch.operators import raster as ra
from slickwatch.plans.registry import Tables, query, rnd
from slickwatch.plans.scene import located, prioritised, triaged
from slickwatch.plans.vessel import RINGS, TEMPLATE_ROWS, add_ring
from slickwatch.plans.views import ORACLE_VIEWS
from slickwatch.session import cut_lineage, spread

WINDOWS = (9, 21)
LIMIT = 0.15
MIN_PX = 12


def usable(t: Tables) -> DataFrame:
    return ra.with_usable(t.view("v_pixels"), "ocean")


def sized(t: Tables) -> DataFrame:
    """Usable pixels with their scene's height and width."""
    px = usable(t)
    return px.join(ra.scene_validity(px).select("scene_id", "height", "width"), "scene_id")


def seeds(t: Tables, filled: DataFrame | None = None) -> DataFrame:
    return ra.dark_seeds(filled or ra.filled_scene(sized(t)), WINDOWS)


def cleaned(t: Tables, filled: DataFrame | None = None) -> DataFrame:
    """Seeds of unsaturated scenes after opening."""
    s = cut_lineage(seeds(t, filled))
    good = ra.saturation(s, LIMIT).filter("status = 'PASS'").select("scene_id")
    return ra.open_mask(s.join(good, "scene_id", "left_semi"), "seed", "mask")


def first_pixel():
    """Number of a component's first pixel; a label is its run's name, y * 2^31 + x."""
    return F.floor(F.col("label") / ra.ROW) * 100000 + F.col("label") % ra.ROW


def components(t: Tables, filled: DataFrame | None = None) -> DataFrame:
    return ra.label_components(cleaned(t, filled).filter("mask"))


def placed_pixels(t: Tables) -> DataFrame:
    """Pixel centres on the map: 0.004 degrees a pixel."""
    lon, lat = pixel_to_map(F.col("x") + 0.5, F.col("y") + 0.5, {"a": 0.004, "c": 0.0, "e": -0.004, "f": 0.0})
    s = F.col("scene_id")
    return t.view("v_pixels").select(
        "scene_id", "y", "x", (F.lit(57.1) + (s * 11 % 20) / 10 + lon).alias("lon"), (F.lit(-21.3) + (s * 7 % 20) / 10 + lat).alias("lat")
    )


def land(t: Tables) -> DataFrame:
    """Islands, one row a part; some have a lake."""
    df = add_ring(t.view("v_land"), F.col("half_width") / 0.04)
    lake = geo.ring_from_offsets("c_lon", "c_lat", RINGS[0], F.col("half_width") / 0.04 * 0.3)
    has = (F.col("land_id") % 4 == 1) & (F.col("shape") != 1)
    return df.withColumn("holes", F.when(has, F.array(lake)).otherwise(F.slice(F.array(lake), 1, 0)))


def candidate_rings(t: Tables) -> DataFrame:
    df = spread(t.view("v_candidates"), "ordinal")
    ring = geo.ring_from_offsets("c_lon", "c_lat", RINGS[0], F.col("half_width") / 0.04)
    return df.withColumn("ring", ring)


ORACLE_VIEWS["v_usable"] = """
    SELECT *, coalesce(vv_db BETWEEN -100 AND 30 AND vh_db BETWEEN -100 AND 30 AND ocean > 0, false) AS usable FROM v_pixels
"""
ORACLE_VIEWS["v_scene"] = """
    SELECT scene_id, count(*) AS total_pixels, count(*) FILTER (usable) AS valid_pixels, max(y)+1 AS height, max(x)+1 AS width
    FROM v_usable GROUP BY scene_id
"""
ORACLE_VIEWS["v_filled"] = """
    SELECT u.*, CASE WHEN usable THEN vv_db ELSE m.vv END AS vv, CASE WHEN usable THEN vh_db ELSE m.vh END AS vh, s.height, s.width
    FROM v_usable u JOIN (SELECT scene_id, median(vv_db) AS vv, median(vh_db) AS vh FROM v_usable WHERE usable GROUP BY scene_id) m
    ON m.scene_id=u.scene_id JOIN v_scene s ON s.scene_id=u.scene_id
"""


def box_sql(col: str, k: int) -> str:
    """Clamped k x k mean, rows first and then columns."""
    r = k // 2
    steps = f"(SELECT range AS d FROM range({-r},{r + 1})) a"
    rows = f"""(SELECT f.scene_id, f.y, f.x, f.height, avg(g.{col}) AS m FROM v_filled f JOIN {steps} ON true
      JOIN v_filled g ON g.scene_id=f.scene_id AND g.y=f.y AND g.x=least(greatest(f.x+a.d,0),f.width-1)
      GROUP BY f.scene_id, f.y, f.x, f.height)"""
    return f"""(SELECT f.scene_id, f.y, f.x, avg(g.m) AS m FROM {rows} f JOIN {steps} ON true
      JOIN {rows} g ON g.scene_id=f.scene_id AND g.x=f.x AND g.y=least(greatest(f.y+a.d,0),f.height-1)
      GROUP BY f.scene_id, f.y, f.x)"""


ORACLE_VIEWS["v_seeds"] = f"""
    SELECT f.*, usable AND (a.m - f.vv >= 3 OR b.m - f.vv >= 3) AS seed, greatest(a.m, b.m) - f.vv AS contrast
    FROM v_filled f JOIN {box_sql('vv', 9)} a ON a.scene_id=f.scene_id AND a.y=f.y AND a.x=f.x
    JOIN {box_sql('vv', 21)} b ON b.scene_id=f.scene_id AND b.y=f.y AND b.x=f.x
"""
ORACLE_VIEWS["v_saturation"] = """
    SELECT *, seed_fraction > 0.15e0 AS saturated,
      CASE WHEN valid_pixels = 0 OR seed_fraction > 0.15e0 THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS status
    FROM (SELECT scene_id, count(*) FILTER (usable) AS valid_pixels, count(*) FILTER (seed) AS seed_pixels,
          coalesce(count(*) FILTER (seed)/CAST(nullif(count(*) FILTER (usable),0) AS DOUBLE), 0e0) AS seed_fraction FROM v_seeds GROUP BY scene_id) q
"""
ORACLE_VIEWS["v_eroded"] = """
    SELECT a.scene_id, a.y, a.x, bool_and(b.seed) AS e FROM v_seeds a JOIN v_seeds b ON b.scene_id=a.scene_id
      AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 JOIN v_saturation s ON s.scene_id=a.scene_id AND s.status='PASS'
    GROUP BY a.scene_id, a.y, a.x
"""
ORACLE_VIEWS["v_mask"] = """
    SELECT a.scene_id, a.y, a.x, bool_or(b.e) AS mask FROM v_eroded a JOIN v_eroded b ON b.scene_id=a.scene_id
      AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY a.scene_id, a.y, a.x
"""


# Components in SQL: every mask pixel reaches every later pixel of its component,
# so the least pixel reaching a pixel names its component.
LABELS = """WITH RECURSIVE px AS MATERIALIZED (SELECT scene_id, y, x, y*100000+x AS id FROM v_mask WHERE mask),
    reach AS (SELECT scene_id, y, x, id AS root FROM px UNION
      SELECT s.scene_id, s.y, s.x, r.root FROM reach r JOIN px s ON s.scene_id=r.scene_id
        AND s.y BETWEEN r.y-1 AND r.y+1 AND s.x BETWEEN r.x-1 AND r.x+1),
    lab AS (SELECT scene_id, y, x, min(root) AS label FROM reach GROUP BY scene_id, y, x),
    comp AS (SELECT l.scene_id, label, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, avg(x) AS cx, avg(y) AS cy,
       sum(x) AS sx, sum(y) AS sy, max(s.height) AS height, max(s.width) AS width FROM lab l JOIN v_scene s ON s.scene_id=l.scene_id GROUP BY l.scene_id, label)
"""


@query(
    "valid_pixel_mask",
    f"""SELECT scene_id, total_pixels, valid_pixels, {rnd('valid_pixels/CAST(total_pixels AS DOUBLE)')} AS valid_fraction FROM v_scene""",
)
def valid_pixel_mask(t):
    return ra.scene_validity(usable(t)).select(
        "scene_id", "total_pixels", "valid_pixels", geo.rnd("valid_fraction", 6).alias("valid_fraction")
    )


@query("src_pixel_table", f"SELECT scene_id, y, x, {rnd('vv_db')} AS vv_db, {rnd('vh_db')} AS vh_db FROM v_pixels")
def src_pixel_table(t):
    return t.view("v_pixels").select(
        "scene_id", "y", "x", geo.rnd("vv_db", 6).alias("vv_db"), geo.rnd("vh_db", 6).alias("vh_db")
    )


@query(
    "norm_db",
    f"""SELECT p.scene_id, y, x, {rnd('CASE WHEN vv_db IS NULL THEN 0e0 ELSE greatest(0e0,least(1e0,(vv_db+30)/(30+1e-6))) END')} AS vv_norm,
        {rnd('CASE WHEN vh_db IS NULL THEN 0e0 ELSE greatest(0e0,least(1e0,(vh_db+35)/(30+1e-6))) END')} AS vh_norm,
        {rnd('greatest(0e0,least(1e0,(vv_db-lo)/(hi-lo)))')} AS vv_robust, NOT (vv_db BETWEEN -30 AND 0) AS vv_clipped
        FROM v_pixels p JOIN (SELECT scene_id, quantile_cont(vv_db,0.01) AS lo, quantile_cont(vv_db,0.99) AS hi FROM v_pixels GROUP BY scene_id) c
        ON c.scene_id=p.scene_id""",
)
def norm_db(t):
    df = ra.normalise_fixed(t.view("v_pixels")).withColumnRenamed("vv_db_norm", "_fixed")
    df = ra.normalise_robust(df, "vv_db")
    return df.select(
        "scene_id", "y", "x",
        geo.rnd("_fixed", 6).alias("vv_norm"),
        geo.rnd("vh_db_norm", 6).alias("vh_norm"),
        geo.rnd("vv_db_norm", 6).alias("vv_robust"),
        F.col("vv_db_clipped").alias("vv_clipped"),
    )


@query(
    "box_filter",
    f"SELECT f.scene_id, f.y, f.x, {rnd('a.m')} AS mean_9 FROM v_filled f JOIN {box_sql('vv', 9)} a ON a.scene_id=f.scene_id AND a.y=f.y AND a.x=f.x",
)
def box_filter(t):
    df = ra.box_mean(ra.filled_scene(sized(t)), "vv_filled", 9, "_m")
    return df.select("scene_id", "y", "x", geo.rnd("_m", 6).alias("mean_9"))


@query("dark_seed", f"SELECT scene_id, y, x, seed, {rnd('contrast')} AS contrast FROM v_seeds")
def dark_seed(t):
    return seeds(t).select("scene_id", "y", "x", "seed", geo.rnd("contrast", 6).alias("contrast"))


@query(
    "seed_mask_union",
    "SELECT scene_id, count(*) FILTER (seed) AS union_pixels FROM v_seeds GROUP BY scene_id HAVING count(*) FILTER (seed) > 0",
)
def seed_mask_union(t):
    """Pixels seeded at any window size, each counted once."""
    scales = ra.scale_masks(ra.filled_scene(sized(t)), WINDOWS)
    once = scales.groupBy("scene_id", "y", "x").agg(F.count(F.lit(1)).alias("scales"))
    return once.groupBy("scene_id").agg(F.count(F.lit(1)).alias("union_pixels"))


@query(
    "saturation_guard",
    f"SELECT scene_id, valid_pixels, seed_pixels, {rnd('seed_fraction')} AS seed_fraction, saturated, status FROM v_saturation",
)
def saturation_guard(t):
    return ra.saturation(seeds(t), LIMIT).withColumn("seed_fraction", geo.rnd("seed_fraction", 6))


@query("morph_open", "SELECT scene_id, y, x, mask FROM v_mask")
def morph_open(t):
    return cleaned(t).select("scene_id", "y", "x", "mask")


@query(
    "connected_components",
    LABELS + """SELECT scene_id, y, x, min(y*100000+x) OVER (PARTITION BY scene_id, label) AS first_pixel FROM lab""",
)
def connected_components(t):
    """Component label of every mask pixel; checked by flood fill in the tests."""
    return ra.labelled_pixels(components(t)).select("scene_id", "y", "x", first_pixel().alias("first_pixel"))


def stats(t: Tables) -> DataFrame:
    scenes = ra.scene_validity(usable(t))
    return ra.component_stats(components(t), scenes, MIN_PX)


@query(
    "component_stats",
    LABELS + f"""SELECT scene_id, pixels, x0 AS "left", y0 AS top, x1-x0+1 AS box_w, y1-y0+1 AS box_h, {rnd('cx')} AS centroid_x,
       {rnd('cy')} AS centroid_y, x0=0 OR y0=0 OR x1>=width-1 OR y1>=height-1 AS edge_touching FROM comp WHERE pixels >= 12""",
)
def component_stats(t):
    return stats(t).select(
        "scene_id", "pixels", "left", "top", "box_w", "box_h",
        geo.rnd("centroid_x", 6).alias("centroid_x"), geo.rnd("centroid_y", 6).alias("centroid_y"), "edge_touching",
    )


# The outline is walked side by side from the first pixel, the hull is every pair of
# points with all others on its left: no tiles, no chains.
OUTLINE = """
    sd AS (SELECT * FROM (VALUES (0,-1,0,0,1),(1,0,1,1,0),(2,1,0,0,-1),(3,0,-1,-1,0)) v(s,ny,nx,ay,ax)),
    walk AS (SELECT scene_id, label, label//100000 AS y, label%100000 AS x, 0 AS s, 0 AS k, 0::BIGINT AS my, 0::BIGINT AS mx FROM comp WHERE pixels >= 12
      UNION ALL
      SELECT w.scene_id, w.label, w.y + CASE WHEN q.y IS NOT NULL THEN ny+ay WHEN r.y IS NOT NULL THEN ay ELSE 0 END,
             w.x + CASE WHEN q.y IS NOT NULL THEN nx+ax WHEN r.y IS NOT NULL THEN ax ELSE 0 END,
             CASE WHEN q.y IS NOT NULL THEN (w.s+3)%4 WHEN r.y IS NOT NULL THEN w.s ELSE (w.s+1)%4 END, k+1,
             CASE WHEN q.y IS NOT NULL THEN ny+ay WHEN r.y IS NOT NULL THEN ay ELSE 0 END,
             CASE WHEN q.y IS NOT NULL THEN nx+ax WHEN r.y IS NOT NULL THEN ax ELSE 0 END
      FROM walk w JOIN sd ON sd.s=w.s LEFT JOIN px q ON q.scene_id=w.scene_id AND q.y=w.y+ny+ay AND q.x=w.x+nx+ax
      LEFT JOIN px r ON r.scene_id=w.scene_id AND r.y=w.y+ay AND r.x=w.x+ax
      WHERE w.k=0 OR w.s<>0 OR w.y<>w.label//100000 OR w.x<>w.label%100000),
    moves AS (SELECT scene_id, label, k, my, mx, coalesce(lag(my*3+mx) OVER w, last_value(my*3+mx) OVER (PARTITION BY scene_id, label ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM walk WHERE my<>0 OR mx<>0 WINDOW w AS (PARTITION BY scene_id, label ORDER BY k)),
    outline AS (SELECT scene_id, label, count(*) FILTER (abs(my)+abs(mx)=1) + sqrt(2e0)*count(*) FILTER (abs(my)+abs(mx)=2) AS perimeter,
        greatest(1, count(*) FILTER (my*3+mx <> before)) AS points FROM moves GROUP BY scene_id, label),
    pts AS (SELECT DISTINCT scene_id, label, y, unnest([lo, hi]) AS x FROM (SELECT l.scene_id, l.label, y, min(x) AS lo, max(x) AS hi
        FROM lab l JOIN comp c ON c.scene_id=l.scene_id AND c.label=l.label AND c.pixels >= 12 GROUP BY l.scene_id, l.label, y) e),
    edge AS (SELECT a.scene_id, a.label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pts a JOIN pts b ON a.scene_id=b.scene_id AND a.label=b.label
        AND (a.x<>b.x OR a.y<>b.y) JOIN pts c ON c.scene_id=a.scene_id AND c.label=a.label GROUP BY ALL
        HAVING min((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) >= 0 AND bool_and((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) > 0
          OR (b.x-a.x)*(c.x-a.x)+(b.y-a.y)*(c.y-a.y) BETWEEN 0 AND (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))),
    box AS (SELECT e.*, max(p.x*ux+p.y*uy)-min(p.x*ux+p.y*uy) AS w, max(p.y*ux-p.x*uy)-min(p.y*ux-p.x*uy) AS h FROM (
        SELECT *, (x2-x1)/sqrt(pow(x2-x1,2)+pow(y2-y1,2)) AS ux, (y2-y1)/sqrt(pow(x2-x1,2)+pow(y2-y1,2)) AS uy FROM edge) e
        JOIN pts p ON p.scene_id=e.scene_id AND p.label=e.label GROUP BY ALL),
    rect AS (SELECT scene_id, label, min({'a': floor(w*h*1e6+0.5e0), 'turn': floor(turn*1e6+0.5e0)/1e6, 'w': w, 'h': h}) AS r FROM (
        SELECT *, CASE WHEN round(w,6) >= round(h,6) THEN d - 180e0*floor(d/180e0) ELSE d+90e0 - 180e0*floor((d+90e0)/180e0) END AS turn
        FROM (SELECT *, floor(degrees(atan2(uy,ux))*1e6+0.5e0)/1e6 AS d FROM box) z) z GROUP BY scene_id, label),
    hull AS (SELECT scene_id, label, abs(sum(x1*y2-x2*y1))/2e0 AS area FROM edge GROUP BY scene_id, label),
    shape AS (SELECT c.scene_id, c.label, c.pixels, h.area AS hull_area, o.perimeter AS perimeter_px, o.points AS contour_points,
        CASE WHEN o.points < 5 THEN greatest(x1-x0, y1-y0)+1e0 ELSE greatest(r.w, r.h) END AS major_px,
        CASE WHEN o.points < 5 THEN least(x1-x0, y1-y0)+1e0 ELSE least(r.w, r.h) END AS minor_px,
        CASE WHEN o.points < 5 THEN 0e0 ELSE r.turn END AS orientation_deg
      FROM comp c JOIN outline o ON o.scene_id=c.scene_id AND o.label=c.label JOIN hull h ON h.scene_id=c.scene_id AND h.label=c.label
      JOIN rect ON rect.scene_id=c.scene_id AND rect.label=c.label)
"""


@query(
    "component_geometry",
    LABELS + "," + OUTLINE + f"""SELECT scene_id, label AS first_pixel, pixels, hull_area, {rnd('major_px')} AS major_px, {rnd('minor_px')} AS minor_px,
       {rnd('orientation_deg', 3)} AS orientation_deg, {rnd('perimeter_px')} AS perimeter_px, contour_points,
       {rnd('CASE WHEN perimeter_px = 0 THEN 1e0 ELSE 4*pi()*pixels/(perimeter_px*perimeter_px) END')} AS compactness,
       {rnd('major_px/greatest(minor_px, 1e-6)')} AS elongation, {rnd('2*sqrt(pixels/pi())')} AS equivalent_diameter,
       {rnd('pixels/greatest(hull_area, 1e0)')} AS solidity FROM shape""",
)
def component_geometry(t):
    """Outline, hull area, axes and angle, with the descriptors built on them; everything from one labelling."""
    from slickwatch.functions.shape import descriptors

    mask = cut_lineage(cleaned(t).filter("mask").select("scene_id", "y", "x"))
    lab = cut_lineage(ra.label_components(mask))
    shape = ra.component_geometry(lab, ra.outlines(mask))
    sizes = ra.component_stats(lab, ra.scene_validity(usable(t)), MIN_PX).select("scene_id", "label", "pixels")
    df = sizes.join(shape, ["scene_id", "label"])
    d = descriptors(F.col("pixels") * F.lit(1.0), "perimeter_px", "major_px", "minor_px", "hull_area")
    return df.select(
        "scene_id", first_pixel().alias("first_pixel"), "pixels", "hull_area", geo.rnd("major_px", 6).alias("major_px"), geo.rnd("minor_px", 6).alias("minor_px"),
        geo.rnd("orientation_deg", 3).alias("orientation_deg"), geo.rnd("perimeter_px", 6).alias("perimeter_px"), "contour_points",
        *[geo.rnd(v, 6).alias(k) for k, v in d.items()],
    )


@query(
    "component_backscatter",
    LABELS + f"""SELECT q.scene_id, {rnd("avg(vv_db)", 9)} AS mean_vv, {rnd("avg(vh_db)", 9)} AS mean_vh, {rnd("avg(vv_db-vh_db)", 9)} AS vv_vh_diff,
       {rnd("stddev_pop(vv_db)", 9)} AS std_vv, {rnd("avg(CASE WHEN usable THEN 1e0 ELSE 0e0 END)", 9)} AS valid_fraction, {rnd("median(vv_db)", 9)} AS median_vv,
       {rnd("median(vh_db)", 9)} AS median_vh, {rnd("median(a.m-vv_db)", 9)} AS vv_contrast, {rnd("median(b.m-vh_db)", 9)} AS vh_contrast
       FROM lab q JOIN v_filled f ON f.scene_id=q.scene_id AND f.y=q.y AND f.x=q.x JOIN {box_sql('vv', 9)} a ON a.scene_id=q.scene_id AND a.y=q.y AND a.x=q.x
       JOIN {box_sql('vh', 9)} b ON b.scene_id=q.scene_id AND b.y=q.y AND b.x=q.x GROUP BY q.scene_id, q.label""",
)
def component_backscatter(t):
    filled = cut_lineage(ra.filled_scene(sized(t)))
    df = ra.box_means(filled, [("vv_filled", 9, "vv_bg"), ("vh_filled", 9, "vh_bg")])
    px = ra.labelled_pixels(components(t, filled)).join(
        df.select("scene_id", "y", "x", "vv_db", "vh_db", "vv_bg", "vh_bg", "usable"), ["scene_id", "y", "x"]
    )
    out = ra.component_backscatter(px, ["scene_id", "label"])
    return out.select("scene_id", *[geo.rnd(c, 9).alias(c) for c in out.columns if c not in ("scene_id", "label")])


@query(
    "scene_spill_stats",
    LABELS + f"""SELECT s.scene_id, coalesce(oil, 0) AS oil_pixels, {rnd('coalesce(oil,0)/CAST(total_pixels AS DOUBLE)')} AS oil_fraction,
       coalesce(n, 0) AS components, coalesce(largest, 0) AS largest_pixels, {rnd('CASE WHEN n > 0 THEN largest/CAST(oil AS DOUBLE) END')} AS largest_fraction,
       {rnd('CASE WHEN n > 0 THEN n/CAST(oil AS DOUBLE) END')} AS fragmentation, {rnd('CASE WHEN n > 0 THEN n*10000/CAST(oil AS DOUBLE) END')} AS components_per_10k,
       {rnd('CASE WHEN n > 0 THEN sx/oil END')} AS centroid_x, {rnd('CASE WHEN n > 0 THEN sy/oil END')} AS centroid_y
       FROM v_scene s LEFT JOIN (SELECT scene_id, CAST(sum(pixels) AS BIGINT) AS oil, count(*) FILTER (pixels >= 12) AS n,
         max(pixels) FILTER (pixels >= 12) AS largest, CAST(sum(sx) AS DOUBLE) AS sx, CAST(sum(sy) AS DOUBLE) AS sy FROM comp GROUP BY scene_id) c ON c.scene_id=s.scene_id""",
)
def scene_spill_stats(t):
    scenes = ra.scene_validity(usable(t))
    df = ra.spill_stats(components(t), scenes, MIN_PX)
    keep = ("scene_id", "oil_pixels", "components", "largest_pixels")
    return df.select(*[F.col(c) if c in keep else geo.rnd(c, 6).alias(c) for c in df.columns])


# --- chips, patches, tiles ---------------------------------------------------


def chip_boxes(t: Tables) -> DataFrame:
    """One candidate box per scene quarter."""
    px = t.view("v_pixels")
    key = (F.col("scene_id") * 4 + F.floor(F.col("y") / 25) * 2 + F.floor(F.col("x") / 25)).alias("chip_id")
    return (
        px.groupBy("scene_id", key)
        .agg(
            (F.min("x") + 8.5).alias("l"), (F.min("x") + 14.25).alias("r"),
            (F.min("y") + 9.25).alias("t"), (F.min("y") + 13.5).alias("b"),
        )
    )


def chips(t: Tables) -> DataFrame:
    return ra.chip_windows(chip_boxes(t), F.lit(50), F.lit(50), min_px=32)


ORACLE_VIEWS["v_chips"] = """
    SELECT scene_id, chip_id, l, r, t, b, cl AS chip_left, CASE WHEN w < 32 THEN least(50, cl+32) ELSE z END AS chip_right,
           ct AS chip_top, CASE WHEN h < 32 THEN least(50, ct+32) ELSE zz END AS chip_bottom
    FROM (SELECT *, z-a AS w, zz-aa AS h, CASE WHEN z-a < 32 THEN greatest(0, a-CAST(floor((32-(z-a))/2e0) AS BIGINT)) ELSE a END AS cl,
                 CASE WHEN zz-aa < 32 THEN greatest(0, aa-CAST(floor((32-(zz-aa))/2e0) AS BIGINT)) ELSE aa END AS ct
    FROM (SELECT *, CAST(greatest(0, floor(l-pad)) AS BIGINT) AS a, CAST(least(50, ceil(r+pad)) AS BIGINT) AS z,
                 CAST(greatest(0, floor(t-pad)) AS BIGINT) AS aa, CAST(least(50, ceil(b+pad)) AS BIGINT) AS zz
    FROM (SELECT *, greatest(50, floor(greatest(r-l, b-t)*0.5e0)) AS pad FROM (
          SELECT scene_id, scene_id*4+CAST(floor(y/25e0) AS BIGINT)*2+CAST(floor(x/25e0) AS BIGINT) AS chip_id, min(x)+8.5e0 AS l, min(x)+14.25e0 AS r,
                 min(y)+9.25e0 AS t, min(y)+13.5e0 AS b FROM v_pixels GROUP BY ALL) q) q) q) q
"""


@query("chip_window", "SELECT chip_id, scene_id, chip_left, chip_right, chip_top, chip_bottom FROM v_chips")
def chip_window(t):
    return chips(t).select("chip_id", "scene_id", "chip_left", "chip_right", "chip_top", "chip_bottom")


def _side(c):
    return f"""{rnd(f"coalesce(avg({c}) FILTER (ins AND usable), {-15 if 'vv' in c else -25}e0)")} AS mean_{c[:2]},
      {rnd(f"coalesce(median({c}) FILTER (ins AND usable), {-15 if 'vv' in c else -25}e0)")} AS median_{c[:2]},
      {rnd(f"coalesce(stddev_pop({c}) FILTER (ins AND usable), 0e0)")} AS std_{c[:2]},
      {rnd(f"coalesce(avg({c}) FILTER (NOT ins AND usable), {-10 if 'vv' in c else -20}e0)")} AS bg_mean_{c[:2]},
      {rnd(f"coalesce(median({c}) FILTER (NOT ins AND usable), {-10 if 'vv' in c else -20}e0)")} AS bg_median_{c[:2]},
      {rnd(f"coalesce(median({c}) FILTER (NOT ins AND usable), {-10 if 'vv' in c else -20}e0)-coalesce(median({c}) FILTER (ins AND usable), {-15 if 'vv' in c else -25}e0)")} AS {c[:2]}_contrast"""


@query(
    "candidate_vs_background",
    f"""SELECT chip_id, count(*) FILTER (NOT ins AND usable) AS background_pixels, {_side('vv_db')}, {_side('vh_db')},
        CASE WHEN count(*) FILTER (NOT ins AND usable) < 20 THEN 'INSUFFICIENT_CONTEXT' ELSE 'VALID' END AS quality_flag
        FROM (SELECT c.chip_id, p.*, x BETWEEN l AND r AND y BETWEEN t AND b AS ins FROM v_chips c JOIN v_usable p ON p.scene_id=c.scene_id
              AND x >= chip_left AND x < chip_right AND y >= chip_top AND y < chip_bottom) q GROUP BY chip_id""",
)
def candidate_vs_background(t):
    px = ra.pixels_in_windows(usable(t), chips(t), "chip_id")
    inside = F.col("x").between(F.col("l"), F.col("r")) & F.col("y").between(F.col("t"), F.col("b"))
    df = ra.candidate_vs_background(px.withColumn("inside", inside), ["chip_id"])
    cols = [f"{p}{s}_{b}" for b in ("vv", "vh") for p, s in (("", "mean"), ("", "median"), ("", "std"), ("bg_", "mean"), ("bg_", "median"))]
    return df.select(
        "chip_id", "background_pixels", *[geo.rnd(c, 6).alias(c) for c in [*cols, "vv_contrast", "vh_contrast"]], "quality_flag"
    )


@query(
    "patch_grid",
    """SELECT p.scene_id, py AS patch_y, px AS patch_x, count(*) FILTER (p.vv_db < -18) AS positives, count(*) AS pixels
       FROM v_pixels p JOIN (SELECT range AS py FROM range(0,35,8)) a ON true JOIN (SELECT range AS px FROM range(0,35,8)) b ON true
       WHERE p.y >= py AND p.y < py+16 AND p.x >= px AND p.x < px+16 GROUP BY ALL HAVING count(*) FILTER (p.vv_db < -18) >= 3""",
)
def patch_grid(t):
    scenes = ra.scene_validity(usable(t))
    px = t.view("v_pixels").withColumn("pos", F.coalesce(F.col("vv_db") < -18, F.lit(False)))
    return ra.patch_grid(px, scenes, 16, 8, "pos", 3)


@query(
    "tile_blend",
    f"""SELECT scene_id, y, x, {rnd('p')} AS p, p >= 0.5 AS mask FROM (
        SELECT scene_id, y, x, sum(w*p)/greatest(sum(w),1e-6) AS p FROM (SELECT q.scene_id, q.y, q.x,
          least(1e0, q.p + ((ty*7+tx*3) % 5)/20e0) AS p,
          greatest(1e-4, (0.5e0-0.5e0*cos(2*3.141592653589793e0/9*(q.y-ty)))*(0.5e0-0.5e0*cos(2*3.141592653589793e0/9*(q.x-tx)))) AS w
        FROM v_predictions q JOIN (VALUES (0),(6)) a(ty0) ON true JOIN (VALUES (0),(6),(12),(15)) b(tx) ON true
        JOIN (SELECT unnest([0,6,10]) AS ty) c ON c.ty >= a.ty0 AND (a.ty0=0 AND c.ty=0 OR a.ty0=6 AND c.ty>0)
        WHERE q.y >= ty AND q.y < ty+10 AND q.x >= tx AND q.x < tx+10) z GROUP BY scene_id, y, x) y2""",
)
def tile_blend(t):
    """Tiles of 10 px at stride 6 over 20 x 25 px scenes, last tile snapped."""
    px = t.view("v_predictions")

    def covering(limit, pos):
        return F.filter(ra.tile_origins(F.lit(limit), 10, 6), lambda o: (F.col(pos) >= o) & (F.col(pos) < o + 10))

    tiles = px.withColumn("tile_y", F.explode(covering(20, "y"))).withColumn("tile_x", F.explode(covering(25, "x")))
    tiles = tiles.withColumn(
        "p", F.least(F.lit(1.0), F.col("p") + ((F.col("tile_y") * 7 + F.col("tile_x") * 3) % 5) / 20)
    )
    return ra.tile_blend(tiles, 10).withColumn("p", geo.rnd("p", 6))


@query(
    "mask_align_check",
    """SELECT s_suppkey AS scene_id, concat_ws('|', CASE WHEN s_suppkey % 11 = 3 THEN 'dtype' END, CASE WHEN s_suppkey % 7 = 1 THEN 'shape' END,
       CASE WHEN s_suppkey % 13 = 5 THEN 'crs' END, CASE WHEN s_suppkey % 5 = 2 THEN 'transform' END,
       CASE WHEN s_suppkey % 9 = 4 THEN 'bounds' END) AS problems, NOT (s_suppkey % 11 = 3 OR s_suppkey % 7 = 1 OR s_suppkey % 13 = 5 OR s_suppkey % 5 = 2
       OR s_suppkey % 9 = 4) AS aligned FROM supplier""",
)
def mask_align_check(t):
    k = F.col("s_suppkey")
    base = t.table("supplier").select(
        k.alias("scene_id"), F.lit("float32").alias("dtype"), F.lit(100).alias("height"), F.lit(200).alias("width"),
        F.lit("EPSG:4326").alias("crs"), F.lit(57.0).alias("origin_x"), F.lit(-20.0).alias("origin_y"), F.lit(0.001).alias("px"),
        F.lit(57.2).alias("max_x"),
    )
    s = F.col("scene_id")
    other = (
        base.withColumn("dtype", F.when(s % 11 == 3, "uint8").otherwise(F.col("dtype")))
        .withColumn("width", F.when(s % 7 == 1, 199).otherwise(200))
        .withColumn("crs", F.when(s % 13 == 5, "EPSG:3857").otherwise(F.col("crs")))
        .withColumn("px", F.when(s % 5 == 2, 0.00101).otherwise(F.when(s % 5 == 3, 0.001 + 5e-10).otherwise(0.001)))
        .withColumn("max_x", F.when(s % 9 == 4, 57.21).otherwise(57.2))
    )
    return ra.alignment_check(base, other).withColumn("problems", F.concat_ws("|", "problems"))


# --- land and groups -----------------------------------------------------------

ORACLE_VIEWS["v_land_points"] = f"""
    SELECT l.land_id, l.part, 0 AS hole, t.i, l.c_lon+t.dx*(l.half_width/0.04e0) AS x, l.c_lat+t.dy*(l.half_width/0.04e0) AS y
    FROM v_land l JOIN (VALUES {TEMPLATE_ROWS}) t(shape,i,dx,dy) ON t.shape=l.shape
    UNION ALL
    SELECT l.land_id, l.part, 1, t.i, l.c_lon+t.dx*(l.half_width/0.04e0*0.3e0), l.c_lat+t.dy*(l.half_width/0.04e0*0.3e0)
    FROM v_land l JOIN (VALUES {TEMPLATE_ROWS}) t(shape,i,dx,dy) ON t.shape=0 WHERE l.land_id % 4 = 1 AND l.shape <> 1
"""
ORACLE_VIEWS["v_land_edges"] = """
    SELECT a.land_id, a.part*100+a.hole*50+a.i AS edge, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v_land_points a
    JOIN v_land_points b ON a.land_id=b.land_id AND a.part=b.part AND a.hole=b.hole AND b.i=a.i+1
"""
ORACLE_VIEWS["v_map_pixels"] = """
    SELECT scene_id, y, x, 57.1e0+(scene_id*11 % 20)/10e0+(0e0+0.004e0*(x+0.5e0)) AS lon, -21.3e0+(scene_id*7 % 20)/10e0+(0e0-0.004e0*(y+0.5e0)) AS lat FROM v_pixels
"""
ORACLE_VIEWS["v_land_class"] = """
    SELECT p.scene_id, p.y, p.x, p.lon, p.lat, coalesce(min(CASE WHEN h.ins THEN 0 WHEN h.near THEN 2 END), 1) AS land_class
    FROM v_map_pixels p LEFT JOIN (
      SELECT p.scene_id, p.y, p.x, e.land_id,
        sum(CASE WHEN (y1>lat) <> (y2>lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END) % 2 = 1
          AND NOT bool_or((x2-x1)*(lat-y1)-(y2-y1)*(lon-x1) = 0 AND lon BETWEEN least(x1,x2) AND greatest(x1,x2)
            AND lat BETWEEN least(y1,y2) AND greatest(y1,y2)) AS ins,
        min(sqrt(pow(x1+tt*(x2-x1)-lon,2)+pow(y1+tt*(y2-y1)-lat,2))) <= 500e0/111320e0 AS near
      FROM (SELECT p.*, e.*, greatest(0e0, least(1e0, ((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS tt
            FROM v_map_pixels p JOIN (SELECT land_id, min(x1) AS bx0, max(x1) AS bx1, min(y1) AS by0, max(y1) AS by1 FROM v_land_edges GROUP BY land_id) b
              ON p.lon BETWEEN bx0-0.006e0 AND bx1+0.006e0 AND p.lat BETWEEN by0-0.006e0 AND by1+0.006e0
            JOIN v_land_edges e ON e.land_id=b.land_id) p JOIN (SELECT 1) one ON true CROSS JOIN (SELECT 1) two
      , LATERAL (SELECT p.land_id) e(land_id) GROUP BY p.scene_id, p.y, p.x, e.land_id) h
    ON h.scene_id=p.scene_id AND h.y=p.y AND h.x=p.x GROUP BY p.scene_id, p.y, p.x, p.lon, p.lat
""".replace("JOIN (SELECT 1) one ON true CROSS JOIN (SELECT 1) two\n      , LATERAL (SELECT p.land_id) e(land_id) ", "").replace(
    "p.y, p.x, e.land_id) h", "p.y, p.x, p.land_id) h"
).replace("SELECT p.scene_id, p.y, p.x, e.land_id,", "SELECT p.scene_id, p.y, p.x, p.land_id,")


@query("land_mask", "SELECT scene_id, y, x, land_class FROM v_land_class")
def land_mask(t):
    return ld.classify_pixels(placed_pixels(t), land(t)).select("scene_id", "y", "x", "land_class")


ORACLE_VIEWS["v_cand_points"] = f"""
    SELECT c.candidate_id, c.ordinal, c.scene_id, t.i, c.c_lon+t.dx*(c.half_width/0.04e0) AS x, c.c_lat+t.dy*(c.half_width/0.04e0) AS y
    FROM v_candidates c JOIN (VALUES {TEMPLATE_ROWS}) t(shape,i,dx,dy) ON t.shape=0
"""
ORACLE_VIEWS["v_cand_edges"] = """
    SELECT a.candidate_id, a.ordinal, a.scene_id, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v_cand_points a JOIN v_cand_points b
    ON a.candidate_id=b.candidate_id AND b.i=a.i+1
"""
OVERLAP_SCALE = "/20"


def overlap_shapes(t: Tables) -> DataFrame:
    """Candidate boxes on the scene grid for the pixel overlap query."""
    c = t.view("v_candidates")
    scenes = placed_pixels(t).agg(F.max("scene_id")).first()[0]
    s = F.col("scene_id") % ((scenes or 0) + 1)
    lon = F.lit(57.1) + (s * 11 % 20) / 10 + 0.02 + (F.col("ordinal") * 13 % 40) * 0.004
    lat = F.lit(-21.3) + (s * 7 % 20) / 10 - 0.02 - (F.col("ordinal") * 29 % 40) * 0.004
    df = c.select("candidate_id", s.alias("scene_id"), lon.alias("c_lon"), lat.alias("c_lat"))
    return df.withColumn("ring", geo.ring_from_offsets("c_lon", "c_lat", RINGS[1], 0.25))


@query(
    "pixel_polygon_overlap",
    f"""WITH m AS (SELECT max(scene_id) + 1 AS n FROM v_land_class),
        s AS (SELECT candidate_id, scene_id % n AS scene_id, 57.1e0+((scene_id % n)*11 % 20)/10e0+0.02e0+(ordinal*13 % 40)*0.004e0 AS c_lon,
          -21.3e0+((scene_id % n)*7 % 20)/10e0-0.02e0-(ordinal*29 % 40)*0.004e0 AS c_lat FROM v_candidates, m),
        pt AS (SELECT s.*, t.i, c_lon+t.dx*0.25e0 AS x, c_lat+t.dy*0.25e0 AS y FROM s JOIN (VALUES {TEMPLATE_ROWS}) t(shape,i,dx,dy) ON t.shape=1),
        eg AS (SELECT a.candidate_id, a.scene_id, a.c_lon, a.c_lat, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b ON a.candidate_id=b.candidate_id AND b.i=a.i+1),
        hit AS (SELECT e.candidate_id, p.y, p.x, max(p.land_class) AS land_class FROM eg e JOIN v_land_class p ON p.scene_id=e.scene_id
                AND p.lon BETWEEN e.c_lon-0.0101e0 AND e.c_lon+0.0101e0 AND p.lat BETWEEN e.c_lat-0.0101e0 AND e.c_lat+0.0101e0
                GROUP BY e.candidate_id, p.y, p.x HAVING sum(CASE WHEN (y1>lat) <> (y2>lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END) % 2 = 1
                  AND NOT bool_or((x2-x1)*(lat-y1)-(y2-y1)*(lon-x1) = 0 AND lon BETWEEN least(x1,x2) AND greatest(x1,x2)
                            AND lat BETWEEN least(y1,y2) AND greatest(y1,y2)))
       SELECT s.candidate_id, count(h.candidate_id) AS pixels,
         {rnd('count(*) FILTER (h.land_class=0)/CAST(greatest(1,count(h.candidate_id)) AS DOUBLE)')} AS land_fraction,
         {rnd('count(*) FILTER (h.land_class<>1)/CAST(greatest(1,count(h.candidate_id)) AS DOUBLE)')} AS buffer_fraction,
         {rnd('greatest(0e0, 1e0-count(*) FILTER (h.land_class=0)/CAST(greatest(1,count(h.candidate_id)) AS DOUBLE)-count(*) FILTER (h.land_class<>1)/CAST(greatest(1,count(h.candidate_id)) AS DOUBLE))')} AS ocean_fraction
       FROM s LEFT JOIN hit h ON h.candidate_id=s.candidate_id GROUP BY s.candidate_id""",
)
def pixel_polygon_overlap(t):
    classed = ld.classify_pixels(placed_pixels(t), land(t))
    df = ld.candidate_overlap(overlap_shapes(t), classed)
    for c in ("land_fraction", "buffer_fraction", "ocean_fraction"):
        df = df.withColumn(c, geo.rnd(c, 6))
    return df


Q_SQL = "(0.9933056200098587e0*(sin(radians({y}))/(1-0.0066943799901413165e0*pow(sin(radians({y})),2))-ln((1-0.08181919084262149e0*sin(radians({y})))/(1+0.08181919084262149e0*sin(radians({y}))))/(2*0.08181919084262149e0)))"


def projected(table: str, columns: str) -> str:
    """Edges in equal-area metres, as SQL text."""
    x, y = ("6378137e0*radians({})".format, lambda c: "6378137e0/2*" + Q_SQL.format(y=c))
    return f"SELECT {columns}, {x('x1')} AS x1, {x('x2')} AS x2, {y('y1')} AS y1, {y('y2')} AS y2 FROM {table}"


def apart_sql(p: str, q: str, k: int) -> str:
    """Squared distance of end k of edge p to edge q, as SQL text."""
    x, y, dx, dy = f"{p}.x{k}", f"{p}.y{k}", f"({q}.x2-{q}.x1)", f"({q}.y2-{q}.y1)"
    t = f"greatest(0e0,least(1e0,(({x}-{q}.x1)*{dx}+({y}-{q}.y1)*{dy})/({dx}*{dx}+{dy}*{dy})))"
    return f"pow({q}.x1+{t}*{dx}-{x},2)+pow({q}.y1+{t}*{dy}-{y},2)"


def side_sql(e: str, p: str, k: int) -> str:
    return f"(({e}.x2-{e}.x1)*({p}.y{k}-{e}.y1)-({e}.y2-{e}.y1)*({p}.x{k}-{e}.x1))"


def odd_sql(p: str, e: str) -> str:
    """1 if the ray from the start of p crosses edge e, as SQL text."""
    return f"CASE WHEN ({e}.y1>{p}.y1) <> ({e}.y2>{p}.y1) AND {p}.x1 < ({e}.x2-{e}.x1)*({p}.y1-{e}.y1)/({e}.y2-{e}.y1)+{e}.x1 THEN 1 ELSE 0 END"


# Every candidate edge with every land edge: no cells, no bounds.
@query(
    "distance_to_land",
    f"""WITH c AS ({projected('v_cand_edges', 'candidate_id, i')}), l AS ({projected('v_land_edges', 'land_id, edge')}),
        w AS (SELECT c.candidate_id, l.land_id, l.edge, min(least({apart_sql('c','l',1)}, {apart_sql('c','l',2)}, {apart_sql('l','c',1)}, {apart_sql('l','c',2)})) AS d2,
                bool_or({side_sql('c','l',1)}*{side_sql('c','l',2)} < 0 AND {side_sql('l','c',1)}*{side_sql('l','c',2)} < 0) AS crosses,
                sum({odd_sql('l','c')}) % 2 = 1 AS holds, sum(CASE WHEN c.i = 0 THEN {odd_sql('c','l')} ELSE 0 END) AS odd
              FROM c JOIN l ON true GROUP BY c.candidate_id, l.land_id, l.edge),
        z AS (SELECT candidate_id, land_id, min(d2) AS d2, bool_or(crosses OR holds) OR sum(odd) % 2 = 1 AS meets FROM w GROUP BY candidate_id, land_id)
       SELECT candidate_id, {rnd('CASE WHEN bool_or(meets) THEN 0e0 ELSE sqrt(min(d2)) END', 3)} AS distance_m FROM z GROUP BY candidate_id""",
)
def distance_to_land(t):
    df = ld.distance_to_land(candidate_rings(t), land(t))
    return df.withColumn("distance_m", geo.rnd("distance_m", 3))




@query(
    "equal_area",
    f"""SELECT candidate_id, {rnd('6378137e0*radians(c_lon)',3)} AS x_m, {rnd('6378137e0/2*'+Q_SQL.format(y='c_lat'),3)} AS y_m, {rnd('a.area/1e6')} AS area_km2
        FROM v_candidates c JOIN (SELECT candidate_id AS id, abs(sum((x1-x0)*(y2-y0)-(x2-x0)*(y1-y0)))/2 AS area FROM (
          SELECT e.candidate_id, 6378137e0*radians(x1) AS x1, 6378137e0*radians(x2) AS x2, 6378137e0/2*{Q_SQL.format(y='y1')} AS y1,
                 6378137e0/2*{Q_SQL.format(y='y2')} AS y2, 6378137e0*radians(p.x) AS x0, 6378137e0/2*{Q_SQL.format(y='p.y')} AS y0
          FROM v_cand_edges e JOIN v_cand_points p ON p.candidate_id=e.candidate_id AND p.i=0) z GROUP BY candidate_id) a ON a.id=c.candidate_id""",
)
def equal_area(t):
    x, y = geo.equal_area_xy("c_lon", "c_lat")
    area = geo.ring_area(geo.equal_area_ring(F.col("ring"))) / 1e6
    return candidate_rings(t).select(
        "candidate_id", geo.rnd(x, 3).alias("x_m"), geo.rnd(y, 3).alias("y_m"), geo.rnd(area, 6).alias("area_km2")
    )


def grouping_input(t: Tables) -> DataFrame:
    df = triaged(t).withColumn("ring", geo.ring_from_offsets("c_lon", "c_lat", RINGS[0], F.col("half_width") / 0.04))
    return df.select(
        "scene_id", "candidate_id", "ordinal", "ring", "orientation_deg", "contrast_db",
        F.col("revised_score").alias("score"), (F.col("tier") != "BACKGROUND").alias("in_review"),
    )


@query(
    "closest_pair_within",
    f"""WITH lead AS (SELECT scene_id, candidate_id, ordinal, orientation_deg, contrast_db FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, group_id
             ORDER BY evidence_priority DESC, ordinal) AS r FROM v_prioritised) q WHERE r=1),
          ea AS (SELECT candidate_id, scene_id, i, 6378137e0*radians(x1) AS x1, 6378137e0*radians(x2) AS x2, 6378137e0/2*{Q_SQL.format(y='y1')} AS y1,
                 6378137e0/2*{Q_SQL.format(y='y2')} AS y2 FROM v_cand_edges),
          pr AS (SELECT l.candidate_id AS leader_id, c.candidate_id AS other_id,
                   CASE WHEN abs(l.orientation_deg-c.orientation_deg) > 90 THEN 180-abs(l.orientation_deg-c.orientation_deg) ELSE abs(l.orientation_deg-c.orientation_deg) END AS hd,
                   abs(l.contrast_db-c.contrast_db) AS cd FROM lead l JOIN v_candidates c ON c.scene_id=l.scene_id AND c.ordinal<>l.ordinal),
          ok AS (SELECT * FROM pr WHERE hd <= 35 AND cd <= 4),
          ds AS (SELECT leader_id, other_id, min(d) AS d FROM (
             SELECT o.leader_id, o.other_id, sqrt(pow(b.x1+tt*(b.x2-b.x1)-px,2)+pow(b.y1+tt*(b.y2-b.y1)-py,2)) AS d FROM (
               SELECT o.leader_id, o.other_id, a.x1 AS px, a.y1 AS py, b.x1, b.y1, b.x2, b.y2,
                 greatest(0e0,least(1e0,((a.x1-b.x1)*(b.x2-b.x1)+(a.y1-b.y1)*(b.y2-b.y1))/(pow(b.x2-b.x1,2)+pow(b.y2-b.y1,2)))) AS tt
               FROM ok o JOIN ea a ON a.candidate_id=o.leader_id JOIN ea b ON b.candidate_id=o.other_id
               UNION ALL SELECT o.leader_id, o.other_id, a.x1, a.y1, b.x1, b.y1, b.x2, b.y2,
                 greatest(0e0,least(1e0,((a.x1-b.x1)*(b.x2-b.x1)+(a.y1-b.y1)*(b.y2-b.y1))/(pow(b.x2-b.x1,2)+pow(b.y2-b.y1,2))))
               FROM ok o JOIN ea a ON a.candidate_id=o.other_id JOIN ea b ON b.candidate_id=o.leader_id) b JOIN (SELECT 1) o2 ON true JOIN (SELECT 0) o3 ON true) z
             GROUP BY leader_id, other_id)
       SELECT o.leader_id, o.other_id, {rnd('hd')} AS heading_gap_deg, {rnd('cd')} AS contrast_gap_db FROM ok o JOIN ds ON ds.leader_id=o.leader_id
         AND ds.other_id=o.other_id WHERE ds.d <= 2000""".replace("SELECT o.leader_id, o.other_id, sqrt(", "SELECT b.leader_id, b.other_id, sqrt(").replace(
        " JOIN (SELECT 1) o2 ON true JOIN (SELECT 0) o3 ON true", ""
    ),
)
def closest_pair_within(t):
    """Best candidate of each group against the fragments near it."""
    base = candidate_rings(t).withColumn("score", F.col("orig_score"))
    ready = grouping.prepared(base)
    lead = cand.best_per_group(prioritised(t), ["scene_id", "group_id"]).select("scene_id", "ordinal")
    pairs = grouping.close_pairs(ready.join(lead, ["scene_id", "ordinal"], "left_semi"), ready)
    return pairs.select(
        F.col("l_candidate_id").alias("leader_id"),
        F.col("candidate_id").alias("other_id"),
        geo.rnd(grouping.heading_gap("orientation_deg", "l_orientation_deg"), 6).alias("heading_gap_deg"),
        geo.rnd(F.abs(F.col("contrast_db") - F.col("l_contrast_db")), 6).alias("contrast_gap_db"),
    )


# A sequential pass: in order of score each candidate goes to the best leader close to it, or leads.
@query(
    "greedy_groups",
    f"""WITH RECURSIVE o AS (SELECT scene_id, candidate_id, orientation_deg, contrast_db, row_number() OVER (PARTITION BY scene_id ORDER BY revised_score DESC, ordinal) AS r
          FROM v_triaged WHERE tier <> 'BACKGROUND'),
        ea AS ({projected('v_cand_edges', 'candidate_id')}),
        ok AS (SELECT a.scene_id, a.r AS ra, b.r AS rb, a.candidate_id AS ca, b.candidate_id AS cb FROM o a JOIN o b ON a.scene_id=b.scene_id AND a.r < b.r
          WHERE abs(a.contrast_db-b.contrast_db) <= 4 AND CASE WHEN abs(a.orientation_deg-b.orientation_deg) > 90 THEN 180-abs(a.orientation_deg-b.orientation_deg)
            ELSE abs(a.orientation_deg-b.orientation_deg) END <= 35),
        near AS (SELECT scene_id, rb, list(ra) AS close FROM (SELECT ok.scene_id, ra, rb FROM ok JOIN ea p ON p.candidate_id=ca JOIN ea q ON q.candidate_id=cb
          GROUP BY ok.scene_id, ra, rb HAVING min(least({apart_sql('p','q',1)}, {apart_sql('p','q',2)}, {apart_sql('q','p',1)}, {apart_sql('q','p',2)})) <= 4e6) n GROUP BY scene_id, rb),
        pass AS (SELECT DISTINCT scene_id, 0::BIGINT AS r, []::BIGINT[] AS leaders, NULL::BIGINT AS pick FROM o
          UNION ALL
          SELECT scene_id, r, CASE WHEN pick IS NULL THEN list_append(leaders, r) ELSE leaders END, pick FROM (
            SELECT pass.scene_id, o.r, leaders, list_min(list_intersect(leaders, close)) AS pick FROM pass JOIN o ON o.scene_id=pass.scene_id AND o.r=pass.r+1
            LEFT JOIN near ON near.scene_id=o.scene_id AND near.rb=o.r) z),
        done AS (SELECT scene_id, max_by(leaders, r) AS leaders FROM pass GROUP BY scene_id)
       SELECT c.scene_id, c.candidate_id, coalesce('GRP' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END, 'GRP_UNASSIGNED') AS assigned_group, leader_id
       FROM v_triaged c LEFT JOIN (SELECT o.candidate_id, l.candidate_id AS leader_id, list_position(done.leaders, coalesce(pick, pass.r)) AS n
         FROM pass JOIN o ON o.scene_id=pass.scene_id AND o.r=pass.r JOIN done ON done.scene_id=pass.scene_id
         JOIN o l ON l.scene_id=pass.scene_id AND l.r=coalesce(pick, pass.r)) g ON g.candidate_id=c.candidate_id""",
)
def greedy_groups(t):
    """Leader groups: what a pass in order of score would give."""
    return grouping.leader_groups(grouping_input(t)).select("scene_id", "candidate_id", "assigned_group", "leader_id")
