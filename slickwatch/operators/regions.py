"""Tracks against source regions, bounded by the case they belong to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators.spatial import salted_join, with_box_cells, with_point_cell
from slickwatch.session import cut_lineage, spread

# Fixed values.
BUFFER_KM = 10.0
NO_RING_KM = 999.0
AOI_HALF_DEG = 0.6
HOURS_BEFORE, HOURS_AFTER = 120, 10
#: Cells for bounds of a track's reports, and room for rounding.
CELL_DEG = 0.1
ROOM, EVEN = 1.01, 1e-12
#: Reports of a case up to which each of its tracks may be one row.
HELD = 100_000
#: Points of a ring up to which its corners are written out as columns.
PLAIN = 16
#: Reports of a track measured as columns.
EARLY = 4
#: What an intersection row tells of its region.
FACTS = ["candidate_id", "horizon_hours", "c_lat", "c_lon"]


def case_positions(positions: DataFrame, cases: DataFrame, half_deg: float = AOI_HALF_DEG) -> DataFrame:
    """Positions retrieved for each case: inside its box and its time window.

    Cases are bucketed by half-degree cell and day; a position sits in exactly
    one bucket, so the join is an equi join and a pair appears once. A case lies in
    some seventy buckets, which size estimates do not see: the merge join keeps those
    rows from being broadcast, at any size of the tables.
    """
    size, day = 0.5, 86400
    c = cases.select(
        "case_id",
        "obs_ts",
        (F.col("aoi_lat") - half_deg).alias("lat_lo"),
        (F.col("aoi_lat") + half_deg).alias("lat_hi"),
        (F.col("aoi_lon") - half_deg).alias("lon_lo"),
        (F.col("aoi_lon") + half_deg).alias("lon_hi"),
        (F.col("obs_ts") - F.expr(f"INTERVAL {HOURS_BEFORE} HOURS")).alias("t_lo"),
        (F.col("obs_ts") + F.expr(f"INTERVAL {HOURS_AFTER} HOURS")).alias("t_hi"),
    )
    c = with_box_cells(c, "lon_lo", "lat_lo", "lon_hi", "lat_hi", size)
    c = c.withColumn(
        "_ct",
        F.explode(
            F.sequence(F.floor(F.unix_seconds("t_lo") / day), F.floor(F.unix_seconds("t_hi") / day))
        ),
    )
    p = with_point_cell(positions, "lon", "lat", size).withColumn(
        "_ct", F.floor(F.unix_seconds("ts") / day)
    )
    inside = (
        F.col("lat").between(F.col("lat_lo"), F.col("lat_hi"))
        & F.col("lon").between(F.col("lon_lo"), F.col("lon_hi"))
        & F.col("ts").between(F.col("t_lo"), F.col("t_hi"))
    )
    return (
        p.join(c.hint("merge"), ["_cx", "_cy", "_ct"])
        .filter(inside)
        .drop("_cx", "_cy", "_ct", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "t_lo", "t_hi")
    )


def _vertices(live: DataFrame) -> DataFrame:
    """Corners of each region as points of the unit sphere, one row each."""
    corner = F.explode(F.slice("ring", 1, F.size("ring") - 1))
    at = live.select("case_id", "region_id", corner.alias("_p")).select("case_id", "region_id", geo.unit_vector("_p.y", "_p.x").alias("v"))
    return at.select("case_id", "region_id", F.col("v.ux").alias("vx"), F.col("v.uy").alias("vy"), F.col("v.uz").alias("vz"))


def surviving_cells(p: DataFrame, live: DataFrame) -> DataFrame:
    """case_id, mmsi, _cx, _cy, region_id: the cells of a track that may hold its closest report to a region.

    A track's reports in a cell lie in a cap of the sphere. The distance of the
    cap's middle to the region's nearest corner, less or plus the cap's radius,
    bounds theirs; a cell goes if another of the track is surely closer.
    """
    box = p.groupBy("case_id", "mmsi", "_cx", "_cy").agg(
        *[f(x).alias(f"{n}_{x}") for n, f in (("lo", F.min), ("hi", F.max)) for x in ("lat", "lon")]
    )
    middle = geo.unit_vector((F.col("lo_lat") + F.col("hi_lat")) / 2, (F.col("lo_lon") + F.col("hi_lon")) / 2)
    ends = [geo.unit_vector(f"{y}_lat", f"{x}_lon") for x in ("lo", "hi") for y in ("lo", "hi")]
    caps = box.select("case_id", "mmsi", "_cx", "_cy", middle.alias("_m"), F.array(*ends).alias("_e"))
    far = F.sqrt(F.array_max(F.transform("_e", lambda e: geo.chord_sq(F.col("_m"), e))))
    caps = caps.select("case_id", "mmsi", "_cx", "_cy", "_m", (far * ROOM + EVEN).alias("_r"))
    points = F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda c: geo.unit_vector(c["y"], c["x"]))
    areas = live.select("case_id", "region_id", points.alias("_v"))
    pairs = salted_join(caps, areas, ["case_id"], ["mmsi", "_cx", "_cy"])
    apart = F.sqrt(F.array_min(F.transform("_v", lambda v: geo.chord_sq(F.col("_m"), v))))
    pairs = pairs.select("case_id", "mmsi", "_cx", "_cy", "region_id", apart.alias("_d"), "_r")
    pairs = pairs.select("case_id", "mmsi", "_cx", "_cy", "region_id", (F.col("_d") - F.col("_r")).alias("_lb"), (F.col("_d") + F.col("_r")).alias("_ub"))
    least = F.min("_ub").over(Window.partitionBy("case_id", "mmsi", "region_id"))
    return pairs.withColumn("_least", least).filter("_lb <= _least").drop("_lb", "_ub", "_least")


def _closest_vertices(p: DataFrame, live: DataFrame) -> DataFrame:
    """Least vertex distance per track and region: bounds of whole cells first, then corners for the cells left.

    Distances are squared chords in generated code; the minimum over reports and
    vertices is one partial aggregate.
    """
    u = p.select("case_id", "mmsi", "_cx", "_cy", "sec", geo.unit_vector("lat", "lon").alias("u")).select(
        "case_id", "mmsi", "_cx", "_cy", "sec", "u.ux", "u.uy", "u.uz"
    )
    left = u.join(surviving_cells(p, live), ["case_id", "mmsi", "_cx", "_cy"])
    dx, dy, dz = F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"), F.col("uz") - F.col("vz")
    near = salted_join(left, _vertices(live), ["case_id", "region_id"], ["mmsi", "sec"]).select(
        "case_id", "mmsi", "region_id", "sec", (geo.chord_to_m(dx * dx + dy * dy + dz * dz) / 1000).alias("d")
    )
    return near.groupBy("case_id", "mmsi", "region_id").agg(_closest("d", "sec").alias("_at"))


def _closest_segments(p: DataFrame, live: DataFrame) -> DataFrame:
    """Least distance to the boundary segments per track and region."""
    d = geo.segment_distance_m(F.col("ring"), "lat", "lon") / 1000
    near = salted_join(p, live.select("case_id", "region_id", "ring"), ["case_id"], ["mmsi", "sec"]).select(
        "case_id", "mmsi", "region_id", "sec", d.alias("d")
    )
    return near.groupBy("case_id", "mmsi", "region_id").agg(_closest("d", "sec").alias("_at"))


def _closest(km: str, seconds: str):
    """Least distance and the earliest report at exactly that distance."""
    return F.min(F.struct(F.col(km).alias("km"), F.col(seconds).alias("sec")))


def split_cases(points: DataFrame, held: int = HELD) -> tuple[DataFrame, DataFrame | None]:
    """Points of the cases with at most ``held`` reports, and those of larger cases, None without any."""
    sizes = points.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    large = cut_lineage(sizes.filter(F.col("_n") > held).select("case_id"))
    if not large.limit(1).count():
        return points, None
    large = F.broadcast(large)  # one in ``held`` rows at most
    return points.join(large, "case_id", "left_anti"), points.join(large, "case_id", "left_semi")


def report() -> Column:
    """What :func:`track_region_distance` needs of a report, for the ``reports`` of a track."""
    u = geo.unit_vector("lat", "lon")
    return F.struct(F.unix_seconds("ts").alias("sec"), "lat", "lon", *[u[k].alias(k) for k in ("ux", "uy", "uz")])


def _met_whole(tracks: DataFrame, live: DataFrame, boundary: str) -> DataFrame:
    """Tracks, each one row with its ``reports``, against the regions of the case.

    A pair is measured where the two rows meet; nothing of it is shuffled. The merge join
    keeps the regions, rows of a small packed file with corners, from being broadcast.
    Lambdas run outside generated code, so the first reports, mostly all there are, are measured
    without any where rings are short, and looked for inside a region only if one lies in its box.
    """
    corners = F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda c: geo.unit_vector(c["y"], c["x"]))
    areas = spread(live, "case_id").select("case_id", "region_id", *FACTS, "ring", geo.ring_bbox(F.col("ring")).alias("_b"), corners.alias("_v"))
    if boundary != "segment":
        areas = areas.filter(F.size("_v") > 0)
    most = live.agg(F.max(F.size("ring"))).first()[0] or 0
    plain = boundary != "segment" and most <= PLAIN
    pairs = tracks.join(areas.hint("merge"), "case_id")

    def at(km, r):
        return F.struct(km.alias("km"), r["sec"].alias("sec"))

    def least(r):
        if boundary == "segment":
            return at(geo.segment_distance_m(F.col("ring"), r["lat"], r["lon"]) / 1000, r)
        return at(geo.chord_to_m(F.array_min(F.transform("_v", lambda v: geo.chord_sq(r, v)))) / 1000, r)

    def in_box(r):
        return r["lon"].between(F.col("_b.min_x"), F.col("_b.max_x")) & r["lat"].between(F.col("_b.min_y"), F.col("_b.max_y"))

    def inside(r):
        return in_box(r) & geo.point_in_ring(F.col("ring"), r["lon"], r["lat"])

    def written_out(i):
        r = F.get("reports", F.lit(i))
        each = [geo.chord_sq(r, F.get("_v", F.lit(c))) for c in range(max(most - 1, 2))]  # null beyond the last corner
        return F.when(F.size("reports") > i, at(geo.chord_to_m(F.least(*each)) / 1000, r))

    longer = F.size("reports") > EARLY
    if plain:
        more = F.array_min(F.transform(F.slice("reports", EARLY + 1, F.size("reports")), least))
        closest = F.least(*[written_out(i) for i in range(EARLY)], F.when(longer, more))
    else:
        closest = F.array_min(F.transform("reports", least))
    near = reduce(or_, [in_box(F.get("reports", F.lit(i))) for i in range(EARLY)], longer)
    found = F.transform(F.filter("reports", inside), lambda r: r["sec"])
    hits = F.when(near, found).otherwise(F.array().cast("array<bigint>"))
    rest = [c for c in tracks.columns if c != "reports"]
    pairs = pairs.select(*rest, "region_id", *FACTS, closest.alias("_at"), hits.alias("_hits"))
    return pairs.withColumn("_n", F.size("_hits").cast("bigint")).withColumn("_first", F.array_min("_hits")).drop("_hits")


def _met_by_cells(points: DataFrame, live: DataFrame, tracks: DataFrame, boundary: str) -> DataFrame:
    """Tracks of any length against regions: as :func:`_met_whole`.

    No join has the case alone as its key: the region side is copied and the
    reports dealt, or both meet on cells. Containment is tested only for reports in a
    cell of a region's box.
    """
    p = with_point_cell(points, "lon", "lat", CELL_DEG)
    closest = _closest_segments(p, live) if boundary == "segment" else _closest_vertices(p, live)
    boxes = live.select("case_id", "region_id", "ring", geo.ring_bbox(F.col("ring")).alias("b")).select(
        "case_id", "region_id", "ring", "b.min_x", "b.max_x", "b.min_y", "b.max_y"
    )
    boxes = with_box_cells(boxes, "min_x", "min_y", "max_x", "max_y", CELL_DEG)
    in_box = F.col("lon").between(F.col("min_x"), F.col("max_x")) & F.col("lat").between(
        F.col("min_y"), F.col("max_y")
    )
    within = (
        p.join(boxes, ["case_id", "_cx", "_cy"])
        .filter(in_box)
        .filter(geo.point_in_ring(F.col("ring"), "lon", "lat"))
        .groupBy("case_id", "mmsi", "region_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("sec").alias("_first"))
    )
    met = closest.join(within, ["case_id", "mmsi", "region_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)).cast("bigint"))
    facts = live.select("case_id", "region_id", *FACTS)
    return salted_join(met.join(tracks, ["case_id", "mmsi"]), facts, ["case_id", "region_id"], ["mmsi"])


def track_region_distance(
    points: DataFrame | None, regions: DataFrame, profiles: DataFrame, boundary: str = "vertex", carry: Sequence[str] = ()
) -> DataFrame:
    """Closest approach of every track of a case to every eligible region of it.

    A case has at most a few dozen regions (at most ten hypotheses times four
    horizons). Profiles that hold ``reports`` (an array of :func:`report`) meet the regions as
    one row each; the others, or all if there is no such column, go report by report through
    ``points``. ``boundary='segment'`` measures to the edges instead of the vertices. ``carry``
    names more columns of the profiles to go with each row.
    """
    live = regions.filter("eligible")
    tracks = profiles.select(
        "case_id", "mmsi", "vessel_name", "vessel_type", "median_gap_minutes", "first_lat", "first_lon", *carry
    )
    parts = []
    if "reports" in profiles.columns:
        whole = profiles.filter("reports IS NOT NULL").select(*tracks.columns, "reports")
        parts.append(_met_whole(whole, live, boundary))
    if points is not None:
        p = points.select("case_id", "mmsi", "lat", "lon", F.unix_seconds("ts").alias("sec"))
        parts.append(_met_by_cells(p, live, tracks, boundary))
    met = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    n = F.col("inside_points")
    met = met.withColumnRenamed("_n", "inside_points").withColumn(
        "min_km", F.when(n > 0, 0.0).otherwise(F.coalesce("_at.km", F.lit(NO_RING_KM)))
    )
    return met.select(
        "case_id",
        "mmsi",
        "vessel_name",
        "vessel_type",
        "region_id",
        "candidate_id",
        "horizon_hours",
        geo.rnd("min_km", 3).alias("min_distance_km"),
        ((n > 0) | (F.col("min_km") <= BUFFER_KM)).alias("intersects"),
        "inside_points",
        F.timestamp_seconds(F.when(n > 0, F.col("_first")).otherwise(F.col("_at.sec"))).alias("closest_ts"),
        geo.rnd(n * F.col("median_gap_minutes"), 1).alias("dwell_minutes"),
        geo.rnd(geo.haversine_m("first_lat", "first_lon", "c_lat", "c_lon") / 1000, 3).alias("centroid_distance_km"),
        *carry,
    )


def window_overlap(df: DataFrame, start="start_ts", end="end_ts", obs="obs_ts", hours="horizon_hours"):
    """Overlap of a track with the window of ``hours`` before the observation."""
    micros = F.unix_micros
    w_end = micros(F.col(obs))
    w_start = w_end - F.col(hours).cast("bigint") * F.lit(3600000000)
    lo = F.greatest(w_start, micros(F.col(start)))
    hi = F.least(w_end, micros(F.col(end)))
    raw = F.when(lo < hi, (hi - lo) / F.lit(3.6e9)).otherwise(0.0)
    return df.withColumn("overlap_hours", raw).withColumn(
        "temporal_status",
        F.when(raw <= 0, "NOT_COMPATIBLE")
        .when(raw / F.col(hours) >= 0.5, "TEMPORALLY_COMPATIBLE")
        .otherwise("PARTIALLY_COMPATIBLE"),
    )


def truth_compatibility(regions: DataFrame) -> DataFrame:
    """Each region against its case's reference point (``t_lat``, ``t_lon``)."""
    ring = F.col("ring")
    inside = geo.point_in_ring(ring, "t_lon", "t_lat", boundary=True)
    centre = geo.ring_centroid(ring)
    area = geo.bbox_ratio_area_km2(ring)
    df = (
        regions.withColumn("inside", inside)
        .withColumn("_c", centre)
        .withColumn("area_km2", area)
        .withColumn("_cd", geo.haversine_m("_c.y", "_c.x", "t_lat", "t_lon") / 1000)
        .withColumn("_bd", geo.vertex_distance_m(ring, "t_lat", "t_lon") / 1000)
    )
    radius = F.sqrt(F.col("area_km2") / F.lit(3.141592653589793))
    return df.select(
        *regions.columns,
        "inside",
        geo.rnd("_cd", 3).alias("centroid_km"),
        geo.rnd(F.when(F.col("inside"), 0.0).otherwise(F.coalesce("_bd", "_cd")), 3).alias("boundary_km"),
        "area_km2",
        geo.rnd(radius, 3).alias("equivalent_radius_km"),
        geo.rnd(F.when(radius > 0, F.col("_cd") / radius).otherwise(999.0), 3).alias("normalized_error"),
    )
