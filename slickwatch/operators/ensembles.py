"""Particle ensembles given as tables: counts, envelopes, spread, closure.

Rows are particles keyed by hypothesis, scenario and horizon. All statistics
are aggregates over those keys; percentiles and hulls work in two levels so
one ensemble holding most rows still spreads over many tasks.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators.ordered import grouped_percentiles, sorted_percentile
from slickwatch.operators.overlap import overlap_ratio
from slickwatch.operators.spatial import SALTS, salted_join
from slickwatch.session import cut_lineage, staged
from slickwatch.session import spread as dealt

# Status codes, quality limits and labels.
STATUS_CODES = {"active": 0, "stranded": 1, "deactivated": 2, "out_of_domain": 3, "missing_forcing": 4}
HORIZONS = (24, 48, 72, 96)
DIVERGENCE_LIMIT_KM = {24: 20.0, 48: 35.0, 72: 50.0, 96: 65.0}
MIN_ACTIVE, SUPPORTED_ACTIVE, SUPPORTED_FRACTION = 200, 400, 0.80
CENTRAL_SHARE = 95.0
ABSENT = 999.0
ATTEMPTS = 20
#: Part of the extent's square below which the corner of three points counts as none.
LEVEL = 1e-12
KM_PER_DEG_CLOSURE = 111.0
#: Active particles up to which the distances of a cloud may be one row.
HELD = 100_000

KEYS = ["hypothesis", "scenario", "horizon"]

# Executors need not have this package: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def status_counts(particles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and fractions by status, and whether they add up."""
    keys = keys or KEYS
    s = F.col("status")
    counts = [F.count_if(s == code).alias(f"{name}_count") for name, code in STATUS_CODES.items()]
    counts.append(F.count_if(s > 4).alias("other_count"))
    df = particles.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts)
    names = [*STATUS_CODES, "other"]
    for name in names:
        df = df.withColumn(f"{name}_fraction", F.col(f"{name}_count") / F.col("total"))
    whole = sum((F.col(f"{n}_count") for n in names[1:]), F.col("active_count"))
    return df.withColumn("reconciled", whole == F.col("total"))


def active(particles: DataFrame) -> DataFrame:
    return particles.filter("status = 0")


def nearest_snapshot(trajectory: DataFrame, horizons=HORIZONS, step_h: float = 1.0) -> DataFrame:
    """Rows within half a step of each horizon; the horizon list is fixed."""
    hit = F.filter(
        F.array(*[F.lit(h) for h in horizons]), lambda h: F.abs(F.col("elapsed_h") - h) < step_h / 2
    )
    return trajectory.withColumn("snapshot_h", F.explode(hit))


def trimmed(particles: DataFrame, keys: list[str]) -> DataFrame:
    """Active particles inside the central share on both axes; all of them when
    fewer than three remain."""
    live = active(particles)
    tail = (100.0 - CENTRAL_SHARE) / 200.0
    axis = live.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("lat").alias("a"), F.col("lat").alias("v")),
                F.struct(F.lit("lon").alias("a"), F.col("lon").alias("v")),
            )
        ).alias("_s"),
    ).select(*keys, F.col("_s.a").alias("a"), F.col("_s.v").alias("v"))
    cuts = grouped_percentiles(axis, [*keys, "a"], "v", {"lo": tail, "hi": 1 - tail}, 0.01)
    cuts = cuts.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("a") == a, F.col(c))).alias(f"{a}_{c}")
            for a in ("lat", "lon")
            for c in ("lo", "hi")
        ]
    )
    inside = F.col("lat").between(F.col("lat_lo"), F.col("lat_hi")) & F.col("lon").between(
        F.col("lon_lo"), F.col("lon_hi")
    )
    marked = live.join(cuts, keys).withColumn("_in", inside)
    kept = marked.groupBy(*keys).agg(F.count_if("_in").alias("_kept"))
    return marked.join(kept, keys).filter("_in OR _kept < 3").drop("_in")


def _outer(pts: np.ndarray) -> np.ndarray:
    """The points but for those strictly inside the octagon of the extremes in eight directions, which are no corners."""
    x, y = pts[:, 0], pts[:, 1]
    ways = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    ring = pts[[int(np.argmax(a * x + b * y)) for a, b in ways]]
    inside = np.ones(len(pts), bool)
    for p, q in zip(ring, np.roll(ring, -1, axis=0)):
        if (p != q).any():
            inside &= (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) > 0
    return pts[~inside]


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corner points of the convex hull, counter-clockwise (monotone chain)."""
    pts = np.column_stack([x, y])
    if len(pts) > 24:
        pts = _outer(pts)
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return pts
    least = LEVEL * float(np.prod(np.ptp(pts, axis=0)))  # three points count as in line below it

    def chain(order):
        out: list[np.ndarray] = []
        for p in order:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > least:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    corners = chain(pts) + chain(pts[::-1])
    return np.array(corners) if len(corners) > 2 else np.array([pts[0], pts[-1]])


def convex_hulls(points: DataFrame, keys: list[str], x: str = "lon", y: str = "lat", held: int = 50000) -> DataFrame:
    """Closed hull ring of each group, in two levels.

    The hull of a union is the hull of the partial hulls. Each input task first
    reduces its rows to hull corners per group (a map-side combine, flushed when
    it holds ``held`` groups), so the shuffle and the task that finishes a group
    see a few dozen corners per input task, however many rows the group has.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema)

    def merge(batches):
        """Fold batches into {group: corners}, yielding full tables."""
        found: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            xs, ys = pdf["_x"].to_numpy(), pdf["_y"].to_numpy()
            for group, at in pdf.groupby(keys, dropna=False, sort=False).indices.items():
                group = group if isinstance(group, tuple) else (group,)
                px, py = xs[at], ys[at]
                if group in found:
                    px = np.concatenate([found[group][:, 0], px])
                    py = np.concatenate([found[group][:, 1], py])
                found[group] = _hull(px, py)
            if len(found) > held:
                yield found
                found = {}
        yield found

    def corners(batches):
        for found in merge(batches):
            rows = [(*g, float(a), float(b)) for g, hull in found.items() for a, b in hull]
            yield pd.DataFrame(rows, columns=[*keys, "_x", "_y"])

    def rings(batches):
        """One group after the other, as they come sorted; only an open group is kept between batches."""

        def closed(group, hull):
            hull = _hull(hull[:, 0], hull[:, 1])
            ring = np.vstack([hull, hull[:1]]) if len(hull) > 2 else hull
            return (*group, [{"x": float(a), "y": float(b)} for a, b in ring])

        open_, held = None, None
        for pdf in batches:
            rows = []
            pts = pdf[["_x", "_y"]].to_numpy()
            groups = pdf.groupby(keys, dropna=False, sort=False).indices  # in no order to rely on
            for group, at in sorted(groups.items(), key=lambda g: g[1][0]):
                group = group if isinstance(group, tuple) else (group,)
                if open_ is not None and group != open_:
                    rows.append(closed(open_, held))
                    held = None
                own = pts[at]
                held = own if held is None else _hull(*np.vstack([held, own]).T)
                open_ = group
            yield pd.DataFrame(rows, columns=[*keys, "ring"])
        if open_ is not None:
            yield pd.DataFrame([closed(open_, held)], columns=[*keys, "ring"])

    xy = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    partial = xy.mapInPandas(corners, f"{fields}, _x double, _y double")
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(rings, f"{fields}, ring array<struct<x:double,y:double>>")


def source_envelopes(particles: DataFrame, keys: list[str] | None = None, kept: DataFrame | None = None) -> DataFrame:
    """Envelope ring, kind and particle count per group; a group without active
    particles has count 0 and neither ring nor kind. ``kept``: the trimmed
    particles, if the caller has them."""
    keys = keys or ["hypothesis", "horizon"]
    hulls = convex_hulls(trimmed(particles, keys) if kept is None else kept, keys)
    counts = particles.groupBy(*keys).agg(F.count_if(F.col("status") == 0).alias("particle_count"))
    kind = F.when(F.col("ring").isNull(), F.lit(None)).when(F.size("ring") >= 4, "Polygon").when(F.size("ring") == 2, "LineString").otherwise("Point")
    return counts.join(hulls, keys, "left").withColumn("geometry_type", kind)


def centers(particles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return active(particles).groupBy(*(keys or KEYS)).agg(
        F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"), F.count(F.lit(1)).alias("active_count")
    )


def displacement(centre: DataFrame, origins: DataFrame, hours: float = 96.0) -> DataFrame:
    """Net displacement from the origin and mean speed over the horizon."""
    df = origins.join(centre, "hypothesis", "left")
    lat, lon = F.coalesce("c_lat", "o_lat"), F.coalesce("c_lon", "o_lon")
    km = geo.haversine_m("o_lat", "o_lon", lat, lon) / 1000
    return df.select(
        "hypothesis",
        lat.alias("end_lat"),
        lon.alias("end_lon"),
        km.alias("displacement_km"),
        (km * 1000 / (hours * 3600)).alias("mean_speed_mps"),
        F.coalesce("active_count", F.lit(0)).cast("bigint").alias("active_count"),
    )


def _scenario_centres(centre: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with a centre per scenario; absent reads 0, 0."""

    def pick(s, c):
        return F.coalesce(F.max(F.when(F.col("scenario") == s, F.col(c))), F.lit(0.0))

    return centre.groupBy(*keys).agg(
        *[pick(s, c).alias(f"{c}_{s.lower()}") for s in "ABC" for c in ("c_lat", "c_lon")]
    )


def _apart(a: str, b: str) -> Column:
    here = (F.col(f"c_lat_{a}") != 0) & (F.col(f"c_lat_{b}") != 0)
    km = geo.haversine_m(f"c_lat_{a}", f"c_lon_{a}", f"c_lat_{b}", f"c_lon_{b}") / 1000
    return F.when(here, km).otherwise(0.0)


def scenario_sensitivity(centre: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["hypothesis", "horizon"]
    df = _scenario_centres(centre, keys)
    for a, b in ("ab", "bc", "ac"):
        df = df.withColumn(f"{a}{b}_km", _apart(a, b))
    worst = F.greatest("ab_km", "bc_km", "ac_km")
    return df.withColumn("max_divergence_km", worst).withColumn(
        "sensitivity",
        F.when(worst < 10.0, "LOW_SENSITIVITY").when(worst < 30.0, "MODERATE_SENSITIVITY").otherwise("HIGH_SENSITIVITY"),
    )


def forward_sensitivity(centre: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["hypothesis", "horizon"]
    df = _scenario_centres(centre, keys)
    worst = F.greatest(_apart("a", "b"), _apart("b", "c"))
    return df.withColumn("max_separation_km", worst).withColumn(
        "sensitivity",
        F.when(worst <= 10.0, "LOW_FORWARD_SCENARIO_SENSITIVITY")
        .when(worst <= 30.0, "MODERATE_FORWARD_SCENARIO_SENSITIVITY")
        .otherwise("HIGH_FORWARD_SCENARIO_SENSITIVITY"),
    )


def spread(particles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Population deviation of distances to the centre; 0 below two particles."""
    keys = keys or KEYS
    centre = centers(particles, keys).select(*keys, "c_lat", "c_lon")
    km = geo.haversine_m("c_lat", "c_lon", "lat", "lon") / 1000
    return (
        salted_join(active(particles), centre, keys, ["lat", "lon"])
        .groupBy(*keys)
        .agg(F.stddev_pop(km).alias("_s"), F.count(F.lit(1)).alias("active_count"))
        .select(*keys, "active_count", F.when(F.col("active_count") < 2, 0.0).otherwise(F.col("_s")).alias("spread_km"))
    )


def first_failure(particles: DataFrame, share: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """First time step whose active count falls below ``share`` of the step's
    particles; null when none does."""
    keys = keys or ["hypothesis", "scenario"]
    steps = particles.groupBy(*keys, "elapsed_h").agg(
        F.count(F.lit(1)).alias("seeded"), F.count_if(F.col("status") == 0).alias("live")
    )
    return steps.groupBy(*keys).agg(
        F.min(F.when(F.col("live") < F.col("seeded") * share, F.col("elapsed_h"))).alias("first_failure_h")
    )


def horizon_status(df: DataFrame) -> DataFrame:
    """Support of a horizon from active particles and scenario divergence."""
    limit = F.lit(None).cast("double")
    for h, km in DIVERGENCE_LIMIT_KM.items():
        limit = F.when(F.col("horizon") == h, km).otherwise(limit)
    return df.withColumn(
        "horizon_status",
        F.when(F.col("active_count") < MIN_ACTIVE, "INSUFFICIENT_DATA")
        .when(
            (F.col("active_fraction") >= SUPPORTED_FRACTION) & (F.col("max_divergence_km") <= limit), "SUPPORTED"
        )
        .otherwise("UNCERTAIN"),
    )


def horizon_matrix(df: DataFrame, by: str = "hypothesis") -> DataFrame:
    """One row per hypothesis, one column per horizon."""
    return (
        df.groupBy(by)
        .pivot("horizon", list(HORIZONS))
        .agg(F.max("horizon_status"))
        .withColumnsRenamed({str(h): f"horizon_{h}h_status" for h in HORIZONS})
    )


def physics_quality(active_count="active_count", sensitivity="sensitivity") -> Column:
    n, s = geo.as_col(active_count), geo.as_col(sensitivity)
    return (
        F.when((n >= SUPPORTED_ACTIVE) & (s != "HIGH_SENSITIVITY"), "SUPPORTED")
        .when(n >= MIN_ACTIVE, "UNCERTAIN")
        .otherwise("INSUFFICIENT_DATA")
    )


def audit_quality(active_count="active_count", sensitivity="sensitivity") -> Column:
    n, s = geo.as_col(active_count), geo.as_col(sensitivity)
    return (
        F.when(n < 50, "INSUFFICIENT_DATA").when(s == "HIGH_SENSITIVITY", "UNCERTAIN").otherwise("SUPPORTED")
    )


def uncertainty_reasons() -> Column:
    """Codes at the last horizon, ``NONE`` when nothing applies."""
    frac, lost = F.col("active_fraction"), F.lit(1.0) - F.col("active_fraction")
    near = F.col("nearshore_context")
    codes = F.concat_ws(
        "|",
        F.when(F.col("max_divergence_km") > DIVERGENCE_LIMIT_KM[96], "HIGH_SCENARIO_SENSITIVITY"),
        F.when(near, "NEARSHORE_CONTEXT"),
        F.when(near, "NEAREST_WET_CELL_SUPPORT"),
        F.when(F.col("spread_km") > 25.0, "LARGE_SOURCE_REGION_SPREAD"),
        F.when((frac < 0.80) & (frac >= 0.40), "PARTIAL_FORCING_SUPPORT"),
        F.when(lost > 0.20, "HIGH_LAND_STRANDING_FRACTION"),
    )
    return (
        F.when(codes != "", codes)
        .when(F.col("horizon_status") != "SUPPORTED", "CONSERVATIVE_DIVERGENCE_THRESHOLD")
        .otherwise("NONE")
    )


def region_validity(envelopes: DataFrame, forcing_fraction="forcing_fraction") -> DataFrame:
    """Validity of each envelope and whether it may be validated forward."""
    is_polygon = F.col("geometry_type") == "Polygon"
    area = F.when(is_polygon, geo.ring_area(F.col("ring")) * geo.KM_PER_DEG * geo.KM_PER_DEG).otherwise(0.0)
    df = envelopes.withColumn("area_km2", geo.rnd(area, 2))
    exists, n = F.col("ring").isNotNull(), F.coalesce("particle_count", F.lit(0))
    df = df.withColumn(
        "validity",
        F.when(exists & (n >= MIN_ACTIVE) & is_polygon & (F.col("area_km2") > 0), "VALID")
        .when(exists & (n > 0), "PARTIAL")
        .otherwise("INVALID"),
    )
    ok = F.col("validity").isin("VALID", "PARTIAL") & (n >= MIN_ACTIVE)
    return df.withColumn("eligible", ok & (geo.as_col(forcing_fraction) >= SUPPORTED_FRACTION))


def closure_class(df: DataFrame) -> Column:
    frac, km = F.col("active_fraction"), F.col("centroid_distance_km")
    near = (F.col("within_2km_fraction") >= 0.50) | (F.col("p90_distance_km") <= 20.0)
    return (
        F.when(frac < 0.40, "INSUFFICIENT_DATA")
        .when((frac >= 0.80) & (km <= 15.0) & near, "GOOD_CLOSURE")
        .when(km <= 35.0, "PARTIAL_CLOSURE")
        .otherwise("POOR_CLOSURE")
    )


CLOSURE_CLASSES = ("GOOD_CLOSURE", "PARTIAL_CLOSURE", "POOR_CLOSURE", "INSUFFICIENT_DATA")


def validation_class() -> Column:
    inside, edge = F.col("inside"), F.col("boundary_km")
    mid, err = F.col("centroid_km"), F.col("normalized_error")
    return (
        F.when(inside | (edge <= 5.0) | (mid <= 15.0) | (err <= 2.5), "STRONG_HISTORICAL_COMPATIBILITY")
        .when((edge <= 25.0) | (mid <= 35.0) | (err <= 5.0), "MODERATE_HISTORICAL_COMPATIBILITY")
        .when((edge <= 60.0) | (mid <= 75.0), "WEAK_HISTORICAL_COMPATIBILITY")
        .otherwise("INCOMPATIBLE")
    )


def horizon_temporal_class(horizon="horizon_hours", release="release_start") -> Column:
    h = geo.as_col(horizon)
    return (
        F.when(geo.as_col(release).isNull(), "TRUTH_TIME_INSUFFICIENT")
        .when(h.isin(72, 96), "TEMPORALLY_COMPATIBLE")
        .when(h == 48, "PARTIALLY_COMPATIBLE")
        .otherwise("NOT_COMPATIBLE")
    )


def _edge_distances(live: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Containment and boundary distance of each particle.

    Edges are plain rows of the small polygon side, so the arithmetic is code
    generated; particles are dealt once, and the edges of one meet again where they are.
    """
    e = targets.select("hypothesis", F.explode(geo.edges(F.col("ring"))).alias("e")).select("hypothesis", "e.*")
    e = e.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    p = live.select(*keys, "lat", "lon", F.monotonically_increasing_id().alias("_id"))
    p = p.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    x, y = F.col("lon"), F.col("lat")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (dx * dx + dy * dy)
    cross = dx * (y - F.col("y1")) - dy * (x - F.col("x1"))
    touch = (
        (cross == 0)
        & x.between(F.least("x1", "x2"), F.greatest("x1", "x2"))
        & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    )
    hit = F.when(
        (F.col("y1") > y) != (F.col("y2") > y), x < dx * (y - F.col("y1")) / dy + F.col("x1")
    ).otherwise(False)
    rows = p.join(e.hint("merge"), ["hypothesis", "_salt"])
    rows = rows.withColumn(
        "_t", F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    )
    rows = rows.withColumn("_nx", F.col("x1") + F.col("_t") * dx).withColumn("_ny", F.col("y1") + F.col("_t") * dy)
    d2 = (F.col("_nx") - x) * (F.col("_nx") - x) + (F.col("_ny") - y) * (F.col("_ny") - y)
    rows = rows.select(
        *keys, "_salt", "lat", "lon", "_id", hit.alias("_hit"), touch.alias("_touch"), d2.alias("_d2"),
        (geo.haversine_m("lat", "lon", "_ny", "_nx") / 1000).alias("_km"),
    )
    one = rows.groupBy(*keys, "_salt", "lat", "lon", "_id").agg(
        F.count_if("_hit").alias("_n"), F.count_if("_touch").alias("_on"), F.min_by("_km", "_d2").alias("_km")
    )
    inside = (F.col("_n") % 2 == 1) & (F.col("_on") == 0)
    return one.select(*keys, "lat", "lon", inside.alias("_in"), F.when(inside, 0.0).otherwise(F.col("_km")).alias("_km"))


def _percentiles(live: DataFrame, keys: list[str], sizes: DataFrame, held: int = HELD) -> DataFrame:
    """Median and 90th percentile of ``_km`` a cloud: clouds of at most ``held`` particles as sorted arrays, larger ones by bins."""
    probs = {"median_distance_km": 0.5, "p90_distance_km": 0.9}
    large = cut_lineage(sizes.filter(F.col("active_count") > held).select(*keys))
    some = large.limit(1).count() > 0
    small = live.join(F.broadcast(large), keys, "left_anti") if some else live  # one in ``held`` rows at most
    sorted_ = small.groupBy(*keys).agg(F.sort_array(F.collect_list("_km")).alias("_v"))
    found = sorted_.select(*keys, *[sorted_percentile(F.col("_v"), p).alias(n) for n, p in probs.items()])
    if some:
        rest = live.join(F.broadcast(large), keys, "left_semi")
        found = found.unionByName(grouped_percentiles(rest, keys, "_km", probs, 0.1))
    return found


def arrival_metrics(particles: DataFrame, targets: DataFrame, keys: list[str], shape: bool = True) -> DataFrame:
    """Closure of each arrival cloud on its candidate polygon.

    ``targets`` holds one ring per hypothesis, which may be concave. Whatever is not
    active counts as stranded. Fractions divide by all seeded
    particles, not by the active ones. A cloud without active particles keeps
    the sentinels. ``shape=False`` leaves out what needs the cloud's hull:
    convex_hull_area_km2 and iou.
    """
    shapes = targets.select(
        "hypothesis",
        "ring",
        geo.ring_centroid(F.col("ring")).alias("_tc"),
        geo.ring_area(F.col("ring")).alias("_ta"),
    )
    live = staged(_edge_distances(active(particles), targets, keys), "arrivals")
    seeded = particles.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    agg = cut_lineage(live.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("active_count"),
        F.avg("lat").alias("centroid_lat"),
        F.avg("lon").alias("centroid_lon"),
        F.count_if("_in").alias("_n_in"),
        F.count_if(F.col("_km") <= 0.5).alias("_n_500"),
        F.count_if(F.col("_km") <= 2.0).alias("_n_2k"),
    ))
    df = seeded.join(agg, keys, "left").join(_percentiles(live, keys, agg), keys, "left").join(shapes.drop("ring"), "hypothesis", "left")
    if shape:
        hulls = cut_lineage(convex_hulls(active(particles), keys))
        hull_area = F.when(F.size("ring") > 3, geo.ring_area(F.col("ring"))).otherwise(0.0)
        pairs = hulls.join(shapes.select("hypothesis", F.array("ring").alias("b")), "hypothesis")
        iou = overlap_ratio(pairs.select(*keys, F.array("ring").alias("a"), "b"), keys)
        df = df.join(hulls.select(*keys, hull_area.alias("_hull")).join(iou, keys, "left"), keys, "left")
    n = F.coalesce("active_count", F.lit(0))
    cent = geo.haversine_m("centroid_lat", "centroid_lon", "_tc.y", "_tc.x") / 1000
    square_km = F.lit(KM_PER_DEG_CLOSURE) * KM_PER_DEG_CLOSURE * F.cos(F.radians("_tc.y"))
    area = F.col("_ta") * square_km
    radius = F.when(area > 0, F.sqrt(area / F.lit(np.pi))).otherwise(0.5)

    def or_else(value, default):
        return F.when(n == 0, default).otherwise(value)

    of_shape = [
        or_else(F.coalesce(F.col("_hull") * square_km, F.lit(0.0)), 0.0).alias("convex_hull_area_km2"),
        or_else(geo.rnd(F.coalesce("iou", F.lit(0.0)), 4), 0.0).alias("iou"),
    ]
    return df.select(
        *keys,
        "total",
        n.cast("bigint").alias("active_count"),
        (n / F.col("total")).alias("active_fraction"),
        (F.col("total") - n).cast("bigint").alias("stranded_count"),
        ((F.col("total") - n) / F.col("total")).alias("stranded_fraction"),
        or_else(F.col("centroid_lat"), 0.0).alias("centroid_lat"),
        or_else(F.col("centroid_lon"), 0.0).alias("centroid_lon"),
        or_else(cent, ABSENT).alias("centroid_distance_km"),
        or_else(F.col("_n_in") / F.col("total"), 0.0).alias("inside_fraction"),
        or_else(F.col("_n_500") / F.col("total"), 0.0).alias("within_500m_fraction"),
        or_else(F.col("_n_2k") / F.col("total"), 0.0).alias("within_2km_fraction"),
        or_else(F.col("median_distance_km"), ABSENT).alias("median_distance_km"),
        or_else(F.col("p90_distance_km"), ABSENT).alias("p90_distance_km"),
        or_else(area, 0.0).alias("candidate_area_km2"),
        or_else(radius, 0.0).alias("equivalent_radius_km"),
        or_else(geo.rnd(cent / radius, 3), ABSENT).alias("normalized_error"),
        *(of_shape if shape else []),
    )


def scenario_overlap(envelopes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise overlap of the scenario hulls of each group; 0 where either is missing or no polygon."""

    def of(s):
        return F.max_by("ring", F.when(F.col("scenario") == s, F.lit(1)))

    wide = envelopes.groupBy(*keys).agg(*[of(s).alias(s) for s in "ABC"])
    pairs = F.array(*[F.struct(F.lit(f"overlap_{p.lower()}").alias("n"), F.array_compact(F.array(p[0])).alias("a"), F.array_compact(F.array(p[1])).alias("b")) for p in ("AB", "BC", "AC")])
    each = cut_lineage(wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.n").alias("_n"), "p.a", "p.b"))
    iou = overlap_ratio(each, [*keys, "_n"])
    return iou.groupBy(*keys).agg(*[F.max(F.when(F.col("_n") == n, geo.rnd("iou", 4))).alias(n) for n in ("overlap_ab", "overlap_bc", "overlap_ac")])


def _uniform(key: str, number: str, seed: int, tag: str) -> Column:
    """Even number in [0, 1) that depends on the four values alone: 40 bits of their MD5."""
    text = F.concat_ws("|", F.col(key).cast("string"), F.col(number).cast("string"), F.lit(str(seed)), F.lit(tag))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("double") / F.lit(float(1 << 40))


def seed_particles(polygons: DataFrame, n: int, seed: int = 314159, key: str = "candidate_id") -> DataFrame:
    """``n`` uniform points inside each ring, the same for every partitioning: key, seq, lat, lon.

    Coordinates come from hashes of (key, attempt, seed), not from ``rand``. A round
    draws ``2 n`` attempts, and only polygons that still lack points go into the
    next, up to 20 attempts a point in all; what is missing then is topped up
    around the centroid from a normal deviate. Keys are unique.
    """
    box = geo.ring_bbox(F.col("ring"))
    todo = cut_lineage(dealt(polygons.select(key, "ring"), key).select(key, "ring", box.alias("_b"), F.lit(0).cast("bigint").alias("_have")))
    parts, last = [], n * ATTEMPTS
    for start in range(1, last + 1, 2 * n):
        drawn = todo.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(min(start + 2 * n - 1, last)))))
        drawn = (
            drawn.withColumn("lon", F.col("_b.min_x") + _uniform(key, "attempt", seed, "x") * (F.col("_b.max_x") - F.col("_b.min_x")))
            .withColumn("lat", F.col("_b.min_y") + _uniform(key, "attempt", seed, "y") * (F.col("_b.max_y") - F.col("_b.min_y")))
            .filter(geo.point_in_ring(F.col("ring"), "lon", "lat"))
        )
        order = Window.partitionBy(key).orderBy("attempt")  # at most 2 n rows a key
        hits = drawn.withColumn("seq", F.row_number().over(order) + F.col("_have")).filter(F.col("seq") <= n)
        hits = cut_lineage(hits.select(key, F.col("seq").cast("int").alias("seq"), "lat", "lon"))
        parts.append(hits)
        found = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_new"))
        todo = todo.join(found, key, "left").withColumn("_have", F.col("_have") + F.coalesce("_new", F.lit(0))).drop("_new")
        todo = cut_lineage(todo.filter(F.col("_have") < n))
        if not todo.limit(1).count():
            break
    missing = todo.select(key, geo.ring_centroid(F.col("ring")).alias("_c"), "_have")
    missing = missing.withColumn("seq", F.explode(F.sequence((F.col("_have") + 1).cast("int"), F.lit(n))))
    gauss = F.sqrt(F.lit(-2.0) * F.ln(F.greatest(_uniform(key, "seq", seed, "g"), F.lit(1e-12))))
    turn = F.lit(2 * np.pi) * _uniform(key, "seq", seed, "h")
    out = missing.select(key, "seq", (F.col("_c.y") + gauss * F.cos(turn) * 0.005).alias("lat"), (F.col("_c.x") + gauss * F.sin(turn) * 0.005).alias("lon"))
    for hits in parts:
        out = out.unionByName(hits)
    return out
