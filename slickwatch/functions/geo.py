"""Geographic column expressions. Angles in degrees, rings in lon/lat.

A ring is a closed ``array<struct<x: double, y: double>>``. Everything here is
a JVM-side expression; nothing collects and nothing calls Python per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in metres, and the WGS84 spheroid.
EARTH_RADIUS_M = 6371000.0
WGS84_A = 6378137.0
WGS84_E2 = 0.0066943799901413165
# Fixed value: kilometres per degree of latitude used for plain degree areas.
KM_PER_DEG = 111.32


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else (
        value if isinstance(value, Column) else F.lit(value)
    )


def rnd(value, digits: int) -> Column:
    """Half-up decimal rounding in plain double arithmetic.

    ``F.round`` goes through a decimal rendering, other engines through a
    scaled ``floor``; the latter is used so results are the same everywhere.
    """
    scale = float(10**digits)
    return F.floor(as_col(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Lambdas and conditional branches get no common-subexpression elimination,
    so a value used several times there would be computed several times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres, null where a coordinate is; every term appears once."""
    lat1, lon1, lat2, lon2 = map(as_col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(2 * EARTH_RADIUS_M) * F.nanvl(F.asin(F.sqrt(a)), F.lit(math.pi / 2))


def unit_vector(lat, lon) -> Column:
    """Point on the unit sphere, for comparing many distances without trig."""
    lat, lon = F.radians(as_col(lat)), F.radians(as_col(lon))
    return F.struct(
        (F.cos(lat) * F.cos(lon)).alias("ux"),
        (F.cos(lat) * F.sin(lon)).alias("uy"),
        F.sin(lat).alias("uz"),
    )


def chord_sq(u: Column, v: Column) -> Column:
    dx, dy, dz = (u[k] - v[k] for k in ("ux", "uy", "uz"))
    return dx * dx + dy * dy + dz * dz


def chord_to_m(chord2: Column) -> Column:
    """Arc length of a squared chord, null for null; a quarter of it is haversine's ``a``."""
    return F.lit(2 * EARTH_RADIUS_M) * F.nanvl(F.asin(F.sqrt(chord2) / 2), F.lit(math.pi / 2))


def circular_diff(a, b, period: float = 360.0) -> Column:
    """Smallest absolute difference of two angles; 180 for axial headings."""
    half = period / 2
    return F.abs(F.pmod(as_col(a) - as_col(b) + F.lit(half), F.lit(period)) - F.lit(half))


def normalize_lon(lon) -> Column:
    """0..360 to -180..180, keeping +180, rounded to 6 places."""
    lon = as_col(lon)
    shifted = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.when((shifted == -180.0) & (lon > 0), F.lit(180.0)).otherwise(rnd(shifted, 6))


def bearing_to(u, v) -> Column:
    """Direction a current flows to, degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(as_col(u), as_col(v))), F.lit(360.0))


def bearing_from(u, v) -> Column:
    """Direction a wind comes from, degrees clockwise from north.

    Calm (both components 0) reads 180, the value of atan2 on negative zeros,
    which Spark's ``atan2`` would turn into positive ones.
    """
    u, v = as_col(u), as_col(v)
    return F.when((u == 0) & (v == 0), 180.0).otherwise(
        F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))
    )


def vector_features(u_wind, v_wind, u_cur, v_cur) -> dict[str, Column]:
    """Wind and current described relative to each other."""
    uw, vw, uc, vc = map(as_col, (u_wind, v_wind, u_cur, v_cur))
    wind = F.sqrt(uw * uw + vw * vw)
    cur = F.sqrt(uc * uc + vc * vc)
    dot = uw * uc + vw * vc
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (wind * cur + 1e-9)))
    return {
        "wind_speed_mps": wind,
        "wind_direction_deg": bearing_from(uw, vw),
        "current_speed_mps": cur,
        "current_direction_deg": bearing_to(uc, vc),
        "wind_current_angle_deg": F.degrees(F.acos(cosine)),
        "current_wind_speed_ratio": cur / (wind + 1e-6),
        "current_component_along_wind_mps": dot / (wind + 1e-6),
        "current_component_across_wind_mps": (uw * vc - vw * uc) / (wind + 1e-6),
    }


def equal_area_xy(lon, lat) -> tuple[Column, Column]:
    """World cylindrical equal-area metres on the WGS84 spheroid."""
    lon, lat = as_col(lon), as_col(lat)
    e = math.sqrt(WGS84_E2)
    s = F.sin(F.radians(lat))
    q = F.lit(1 - WGS84_E2) * (
        s / (F.lit(1.0) - F.lit(WGS84_E2) * s * s)
        - F.ln((F.lit(1.0) - F.lit(e) * s) / (F.lit(1.0) + F.lit(e) * s)) / F.lit(2 * e)
    )
    return F.lit(WGS84_A) * F.radians(lon), F.lit(WGS84_A / 2) * q


def equal_area_ring(ring: Column) -> Column:
    def project(p):
        x, y = equal_area_xy(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, project)


def ring_from_offsets(lon, lat, offsets, scale=1.0) -> Column:
    """Closed ring: centre plus fixed (dx, dy) offsets."""
    lon, lat, scale = as_col(lon), as_col(lat), as_col(scale)
    points = [
        F.struct(
            (lon + F.lit(float(dx)) * scale).alias("x"),
            (lat + F.lit(float(dy)) * scale).alias("y"),
        )
        for dx, dy in [*offsets, offsets[0]]
    ]
    return F.array(*points)


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring."""
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, 1, n - 1),
        F.slice(ring, 2, n - 1),
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def _crosses(e: Column, px: Column, py: Column) -> Column:
    cut = (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    return F.when((e["y1"] > py) != (e["y2"] > py), px < cut).otherwise(F.lit(False))


def _on_edge(e: Column, px: Column, py: Column) -> Column:
    cross = (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    return (
        (cross == 0)
        & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def point_in_ring(ring: Column, px, py, boundary: bool = False) -> Column:
    """Even-odd test. A point on the boundary is outside unless ``boundary``."""
    px, py = as_col(px), as_col(py)

    def test(es):
        odd = F.size(F.filter(es, lambda e: _crosses(e, px, py))) % 2 == 1
        touching = F.exists(es, lambda e: _on_edge(e, px, py))
        return (odd | touching) if boundary else (odd & ~touching)

    return let(edges(ring), test)


def point_in_polygon(outer: Column, holes: Column, px, py) -> Column:
    """Inside the outer ring and in (or on) none of the holes."""
    return point_in_ring(outer, px, py) & ~F.exists(
        holes, lambda h: point_in_ring(h, px, py, boundary=True)
    )


def vertex_distance_m(ring: Column, lat, lon) -> Column:
    """Least great-circle distance to the ring's vertices."""
    return F.array_min(
        F.transform(ring, lambda p: haversine_m(as_col(lat), as_col(lon), p["y"], p["x"]))
    )


def _nearest_on_edge(e: Column, px: Column, py: Column) -> Column:
    """Point of an edge nearest to (px, py), with its squared planar distance."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    share = ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / (dx * dx + dy * dy)
    t = F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    point = let(t, lambda t: F.struct((e["x1"] + t * dx).alias("x"), (e["y1"] + t * dy).alias("y")))
    return let(
        point,
        lambda p: F.struct(
            (F.pow(p["x"] - px, 2.0) + F.pow(p["y"] - py, 2.0)).alias("d2"),
            p["x"].alias("x"),
            p["y"].alias("y"),
        ),
    )


def segment_distance_m(ring: Column, lat, lon) -> Column:
    """Distance to the boundary point nearest in degree space."""
    lat, lon = as_col(lat), as_col(lon)
    best = F.array_min(F.transform(edges(ring), lambda e: _nearest_on_edge(e, lon, lat)))
    return let(best, lambda b: haversine_m(lat, lon, b["y"], b["x"]))


def point_edge_distance(e: Column, px: Column, py: Column) -> Column:
    """Planar distance from a point to one edge (projected rings)."""
    return F.sqrt(_nearest_on_edge(e, px, py)["d2"])


def _segments_cross(a: Column, b: Column) -> Column:
    def side(e, x, y):
        return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])

    return (side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) < 0) & (
        side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) < 0
    )


def ring_distance(a: Column, b: Column) -> Column:
    """Planar distance of two polygons: 0 when they overlap, else the least
    vertex-to-edge distance either way."""

    def towards(points, es):
        return F.array_min(
            F.transform(
                points,
                lambda p: F.array_min(F.transform(es, lambda e: _nearest_on_edge(e, p["x"], p["y"])["d2"])),
            )
        )

    def apart(both):
        ea, eb = both["a"], both["b"]
        overlap = (
            point_in_ring(a, b[0]["x"], b[0]["y"])
            | point_in_ring(b, a[0]["x"], a[0]["y"])
            | F.exists(ea, lambda e: F.exists(eb, lambda f: _segments_cross(e, f)))
        )
        return F.when(overlap, F.lit(0.0)).otherwise(
            F.sqrt(F.least(towards(a, eb), towards(b, ea)))
        )

    return let(F.struct(edges(a).alias("a"), edges(b).alias("b")), apart)


def ring_bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"),
        F.array_max(ys).alias("max_y"),
    )


def ring_moments(ring: Column) -> Column:
    """Signed area and first moments about the ring's first vertex."""

    def moments(r):
        x0, y0 = r[0]["x"], r[0]["y"]

        def step(acc, e):
            ax, ay, bx, by = e["x1"] - x0, e["y1"] - y0, e["x2"] - x0, e["y2"] - y0
            return let(
                ax * by - bx * ay,
                lambda c: F.struct(
                    (acc["a"] + c).alias("a"),
                    (acc["mx"] + (ax + bx) * c).alias("mx"),
                    (acc["my"] + (ay + by) * c).alias("my"),
                ),
            )

        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
        return F.aggregate(edges(r), zero, step)

    return let(ring, moments)  # a ring that is itself computed is computed once, not once an edge


def ring_area(ring: Column) -> Column:
    return F.abs(ring_moments(ring)["a"]) / 2


def ring_centroid(ring: Column) -> Column:
    return let(
        ring_moments(ring),
        lambda m: F.struct(
            (ring[0]["x"] + m["mx"] / (m["a"] * 3)).alias("x"),
            (ring[0]["y"] + m["my"] / (m["a"] * 3)).alias("y"),
        ),
    )


def perimeter(ring: Column) -> Column:
    return F.aggregate(
        edges(ring),
        F.lit(0.0),
        lambda acc, e: acc
        + F.sqrt((e["x2"] - e["x1"]) * (e["x2"] - e["x1"]) + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"])),
    )


def bbox_ratio_area_km2(ring: Column) -> Column:
    """Area as the bounding box in km² times the ring's share of the box in
    degrees, at least 0.1, 3 places."""
    box = ring_bbox(ring)
    height = haversine_m(box["min_y"], box["min_x"], box["max_y"], box["min_x"]) / 1000
    width = haversine_m(box["min_y"], box["min_x"], box["min_y"], box["max_x"]) / 1000
    degrees = (box["max_x"] - box["min_x"]) * (box["max_y"] - box["min_y"])
    share = ring_area(ring) / F.when(degrees > 0, degrees).otherwise(1.0)
    return F.greatest(F.lit(0.1), rnd(height * width * share, 3))


def degree_area_km2(ring: Column, at_lat: float = -20.0) -> Column:
    """Fallback area: square degrees scaled at a fixed latitude."""
    return ring_area(ring) * F.lit(KM_PER_DEG * KM_PER_DEG * math.cos(math.radians(at_lat)))
