"""Queries on particle ensembles and their regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators import ensembles as ens
from slickwatch.plans.registry import Tables, query, rnd
from slickwatch.plans.vessel import RINGS, TEMPLATE_ROWS, hav, truth_rows
from slickwatch.plans.views import ORACLE_VIEWS
from slickwatch.session import cut_lineage

HC = "hypothesis, scenario, horizon"


def particles(t: Tables) -> DataFrame:
    return t.view("v_particles")


def diagnosis(t: Tables) -> DataFrame:
    """Scenario-B counts with the divergence of the three scenarios."""
    p = particles(t)
    counts = ens.status_counts(p).filter("scenario = 'B'")
    sens = ens.scenario_sensitivity(ens.centers(p))
    return ens.horizon_status(
        counts.join(sens.select("hypothesis", "horizon", "max_divergence_km", "sensitivity"), ["hypothesis", "horizon"])
    )


def last_horizon(t: Tables) -> DataFrame:
    sp = ens.spread(particles(t)).filter("scenario = 'B' AND horizon = 96").select("hypothesis", "spread_km")
    return (
        diagnosis(t)
        .filter("horizon = 96")
        .join(sp, "hypothesis", "left")
        .withColumn("nearshore_context", F.col("hypothesis") % 3 == 0)
    )


ORACLE_VIEWS["v_counts"] = f"""
    SELECT {HC}, count(*) AS total, count(*) FILTER (status=0) AS active_count, count(*) FILTER (status=1) AS stranded_count,
           count(*) FILTER (status=2) AS deactivated_count, count(*) FILTER (status=3) AS out_of_domain_count,
           count(*) FILTER (status=4) AS missing_forcing_count, count(*) FILTER (status>4) AS other_count
    FROM v_particles GROUP BY {HC}
"""
ORACLE_VIEWS["v_centers"] = f"""
    SELECT {HC}, avg(lat) AS c_lat, avg(lon) AS c_lon, count(*) AS n FROM v_particles WHERE status=0 GROUP BY {HC}
"""
ORACLE_VIEWS["v_wide_centers"] = """
    SELECT hypothesis, horizon, max(c_lat) FILTER (scenario='A') AS la, max(c_lon) FILTER (scenario='A') AS oa,
           max(c_lat) FILTER (scenario='B') AS lb, max(c_lon) FILTER (scenario='B') AS ob,
           max(c_lat) FILTER (scenario='C') AS lc, max(c_lon) FILTER (scenario='C') AS oc
    FROM v_centers GROUP BY hypothesis, horizon
"""
ORACLE_VIEWS["v_div"] = f"""
    SELECT *, greatest(ab, bc, ac) AS mx, CASE WHEN greatest(ab,bc,ac) < 10 THEN 'LOW_SENSITIVITY'
        WHEN greatest(ab,bc,ac) < 30 THEN 'MODERATE_SENSITIVITY' ELSE 'HIGH_SENSITIVITY' END AS sensitivity
    FROM (SELECT hypothesis, horizon, coalesce({hav('la','oa','lb','ob')}/1000, 0e0) AS ab,
                 coalesce({hav('lb','ob','lc','oc')}/1000, 0e0) AS bc, coalesce({hav('la','oa','lc','oc')}/1000, 0e0) AS ac
          FROM v_wide_centers) q
"""
ORACLE_VIEWS["v_spread"] = f"""
    SELECT p.hypothesis, p.scenario, p.horizon, count(*) AS active_count,
           CASE WHEN count(*) < 2 THEN 0e0 ELSE stddev_pop({hav('c.c_lat','c.c_lon','p.lat','p.lon')}/1000) END AS spread_km
    FROM v_particles p JOIN v_centers c ON c.hypothesis=p.hypothesis AND c.scenario=p.scenario AND c.horizon=p.horizon
    WHERE p.status=0 GROUP BY p.hypothesis, p.scenario, p.horizon
"""
ORACLE_VIEWS["v_diag"] = """
    SELECT c.hypothesis, c.horizon, c.active_count, c.active_count/CAST(c.total AS DOUBLE) AS active_fraction, d.mx, d.sensitivity,
           CASE WHEN c.active_count < 200 THEN 'INSUFFICIENT_DATA'
                WHEN c.active_count/CAST(c.total AS DOUBLE) >= 0.8e0 AND d.mx <= CASE c.horizon WHEN 24 THEN 20e0 WHEN 48 THEN 35e0
                     WHEN 72 THEN 50e0 ELSE 65e0 END THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS horizon_status
    FROM v_counts c JOIN v_div d ON d.hypothesis=c.hypothesis AND d.horizon=c.horizon WHERE c.scenario='B'
"""
STATUSES = ("active", "stranded", "deactivated", "out_of_domain", "missing_forcing", "other")


@query(
    "particle_status",
    f"SELECT {HC}, total, "
    + ", ".join(f"{s}_count, {rnd(f'{s}_count/CAST(total AS DOUBLE)')} AS {s}_fraction" for s in STATUSES)
    + " FROM v_counts",
)
def particle_status(t):
    df = ens.status_counts(particles(t)).drop("reconciled")
    for s in STATUSES:
        df = df.withColumn(f"{s}_fraction", geo.rnd(f"{s}_fraction", 6))
    return df


@query(
    "accounting_check",
    f"""SELECT {HC}, total, active_count+stranded_count+deactivated_count+out_of_domain_count+missing_forcing_count+other_count
        = total AS reconciled FROM v_counts""",
)
def accounting_check(t):
    return ens.status_counts(particles(t)).select("hypothesis", "scenario", "horizon", "total", "reconciled")


@query(
    "ensemble_center",
    f"""SELECT o.hypothesis, {rnd('coalesce(c_lat,o_lat)')} AS end_lat, {rnd('coalesce(c_lon,o_lon)')} AS end_lon,
        {rnd(hav('o_lat','o_lon','coalesce(c_lat,o_lat)','coalesce(c_lon,o_lon)')+'/1000')} AS displacement_km,
        {rnd(hav('o_lat','o_lon','coalesce(c_lat,o_lat)','coalesce(c_lon,o_lon)')+'/1000*1000/(96e0*3600)')} AS mean_speed_mps,
        coalesce(n, 0) AS active_count
        FROM (SELECT DISTINCT hypothesis, -20.3e0-(hypothesis % 7)/20e0 AS o_lat, 57.7e0 AS o_lon FROM v_particles) o
        LEFT JOIN v_centers c ON c.hypothesis=o.hypothesis AND c.scenario='B' AND c.horizon=96""",
)
def ensemble_center(t):
    p = particles(t)
    origins = p.select(
        "hypothesis", (F.lit(-20.3) - (F.col("hypothesis") % 7) / 20).alias("o_lat"), F.lit(57.7).alias("o_lon")
    ).distinct()
    centre = ens.centers(p.filter("scenario = 'B' AND horizon = 96"), ["hypothesis"])
    df = ens.displacement(centre, origins)
    for c in ("end_lat", "end_lon", "displacement_km", "mean_speed_mps"):
        df = df.withColumn(c, geo.rnd(c, 6))
    return df


@query(
    "scenario_sensitivity",
    f"""SELECT hypothesis, horizon, {rnd('ab')} AS ab_km, {rnd('bc')} AS bc_km, {rnd('ac')} AS ac_km, {rnd('mx')} AS max_divergence_km,
        sensitivity FROM v_div""",
)
def scenario_sensitivity(t):
    df = ens.scenario_sensitivity(ens.centers(particles(t)))
    return df.select(
        "hypothesis",
        "horizon",
        *[geo.rnd(c, 6).alias(c) for c in ("ab_km", "bc_km", "ac_km", "max_divergence_km")],
        "sensitivity",
    )


@query(
    "forward_sensitivity",
    f"""SELECT hypothesis, horizon, {rnd('greatest(ab,bc)')} AS max_separation_km,
        CASE WHEN greatest(ab,bc) <= 10 THEN 'LOW_FORWARD_SCENARIO_SENSITIVITY' WHEN greatest(ab,bc) <= 30
        THEN 'MODERATE_FORWARD_SCENARIO_SENSITIVITY' ELSE 'HIGH_FORWARD_SCENARIO_SENSITIVITY' END AS sensitivity FROM v_div""",
)
def forward_sensitivity(t):
    df = ens.forward_sensitivity(ens.centers(particles(t)))
    return df.select("hypothesis", "horizon", geo.rnd("max_separation_km", 6).alias("max_separation_km"), "sensitivity")


@query("ensemble_spread", f"SELECT {HC}, active_count, {rnd('spread_km')} AS spread_km FROM v_spread")
def ensemble_spread(t):
    return ens.spread(particles(t)).withColumn("spread_km", geo.rnd("spread_km", 6))


@query(
    "first_failure_step",
    """SELECT hypothesis, scenario, min(elapsed_h) FILTER (live < seeded*0.5e0) AS first_failure_h FROM (
       SELECT hypothesis, scenario, elapsed_h, count(*) AS seeded, count(*) FILTER (status=0) AS live FROM v_particles
       GROUP BY ALL) q GROUP BY hypothesis, scenario""",
)
def first_failure_step(t):
    return ens.first_failure(particles(t))


@query(
    "horizon_snapshot",
    f"""SELECT hypothesis, scenario, particle_id, h.h AS snapshot_h, {rnd('lat')} AS lat, {rnd('lon')} AS lon FROM v_particles
        JOIN (VALUES (24),(48),(72),(96)) h(h) ON abs(elapsed_h - h.h) < 1.5e0 WHERE status=0""",
)
def horizon_snapshot(t):
    df = ens.active(ens.nearest_snapshot(particles(t), step_h=3.0))
    return df.select(
        "hypothesis", "scenario", "particle_id", "snapshot_h", geo.rnd("lat", 6).alias("lat"), geo.rnd("lon", 6).alias("lon")
    )


@query(
    "horizon_status",
    f"""SELECT hypothesis, horizon, active_count, {rnd('active_fraction')} AS active_fraction, {rnd('mx')} AS max_divergence_km,
        horizon_status FROM v_diag""",
)
def horizon_status(t):
    return diagnosis(t).select(
        "hypothesis",
        "horizon",
        "active_count",
        geo.rnd("active_fraction", 6).alias("active_fraction"),
        geo.rnd("max_divergence_km", 6).alias("max_divergence_km"),
        "horizon_status",
    )


@query(
    "horizon_matrix",
    "SELECT hypothesis, "
    + ", ".join(f"max(horizon_status) FILTER (horizon={h}) AS horizon_{h}h_status" for h in ens.HORIZONS)
    + " FROM v_diag GROUP BY hypothesis",
)
def horizon_matrix(t):
    return ens.horizon_matrix(diagnosis(t))


@query(
    "physics_quality",
    """SELECT hypothesis, CASE WHEN active_count >= 400 AND sensitivity <> 'HIGH_SENSITIVITY' THEN 'SUPPORTED'
       WHEN active_count >= 200 THEN 'UNCERTAIN' ELSE 'INSUFFICIENT_DATA' END AS physics_quality FROM v_diag WHERE horizon=96""",
)
def physics_quality(t):
    return diagnosis(t).filter("horizon = 96").select("hypothesis", ens.physics_quality().alias("physics_quality"))


@query(
    "audit_quality",
    """SELECT q, count(*) AS hypotheses, CAST(sum(greatest(0, 100-active_count)) AS BIGINT) AS lost_particles FROM (
       SELECT *, CASE WHEN active_count < 50 THEN 'INSUFFICIENT_DATA' WHEN sensitivity='HIGH_SENSITIVITY' THEN 'UNCERTAIN'
       ELSE 'SUPPORTED' END AS q FROM v_diag) z GROUP BY q""",
)
def audit_quality(t):
    df = diagnosis(t).withColumn("q", ens.audit_quality())
    return df.groupBy("q").agg(
        F.count(F.lit(1)).alias("hypotheses"),
        F.sum(F.greatest(F.lit(0), F.lit(100) - F.col("active_count"))).cast("bigint").alias("lost_particles"),
    )


@query(
    "uncertainty_reasons",
    """SELECT hypothesis, CASE WHEN c <> '' THEN c WHEN horizon_status <> 'SUPPORTED' THEN 'CONSERVATIVE_DIVERGENCE_THRESHOLD'
       ELSE 'NONE' END AS reasons FROM (SELECT d.*, concat_ws('|', CASE WHEN mx > 65 THEN 'HIGH_SCENARIO_SENSITIVITY' END,
        CASE WHEN d.hypothesis % 3 = 0 THEN 'NEARSHORE_CONTEXT' END, CASE WHEN d.hypothesis % 3 = 0 THEN 'NEAREST_WET_CELL_SUPPORT' END,
        CASE WHEN s.spread_km > 25 THEN 'LARGE_SOURCE_REGION_SPREAD' END,
        CASE WHEN active_fraction < 0.8e0 AND active_fraction >= 0.4e0 THEN 'PARTIAL_FORCING_SUPPORT' END,
        CASE WHEN 1e0-active_fraction > 0.2e0 THEN 'HIGH_LAND_STRANDING_FRACTION' END) AS c
       FROM v_diag d LEFT JOIN v_spread s ON s.hypothesis=d.hypothesis AND s.scenario='B' AND s.horizon=96 WHERE d.horizon=96) q""",
)
def uncertainty_reasons(t):
    return last_horizon(t).select("hypothesis", ens.uncertainty_reasons().alias("reasons"))


# --- envelopes --------------------------------------------------------------

ORACLE_VIEWS["v_trim"] = """
    SELECT p.*, count(*) OVER (PARTITION BY p.hypothesis, p.horizon) AS n_in FROM v_particles p JOIN (
      SELECT hypothesis, horizon, quantile_cont(lat, 0.025) AS a0, quantile_cont(lat, 0.975) AS a1,
             quantile_cont(lon, 0.025) AS o0, quantile_cont(lon, 0.975) AS o1 FROM v_particles WHERE status=0 GROUP BY ALL) c
    ON c.hypothesis=p.hypothesis AND c.horizon=p.horizon
    WHERE p.status=0 AND p.lat BETWEEN a0 AND a1 AND p.lon BETWEEN o0 AND o1
"""


def hull_views(name: str, source: str, keys: list[str]) -> None:
    """Oracle view ``name`` of the hull edges, counter-clockwise, of the points of ``source`` (keys, x, y).

    Every pair of points with all others on its left is an edge; points strictly
    inside the octagon of the extremes of eight directions are left out first.
    """
    k = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{c}={b}.{c}" for c in keys)
    top = lambda way: f"arg_max({{'x': x, 'y': y}}, {way})"
    ways = ", ".join(top(w) for w in ("x", "x+y", "y", "y-x", "-x", "-x-y", "-y", "x-y"))
    ORACLE_VIEWS[f"{name}_points"] = f"SELECT DISTINCT {k}, x, y FROM {source}"
    ORACLE_VIEWS[f"{name}_ends"] = f"SELECT {k}, unnest(range(8)) AS i, unnest([{ways}]) AS p FROM {name}_points GROUP BY {k}"
    ORACLE_VIEWS[f"{name}_outer"] = f"""
        SELECT {", ".join("s." + c for c in keys)}, s.x, s.y FROM {name}_points s JOIN {name}_ends a ON {same("a", "s")}
        JOIN {name}_ends b ON {same("b", "s")} AND b.i=(a.i+1)%8
        GROUP BY ALL HAVING NOT bool_and((a.p.x=b.p.x AND a.p.y=b.p.y) OR (b.p.x-a.p.x)*(s.y-a.p.y)-(b.p.y-a.p.y)*(s.x-a.p.x) > 0)
    """
    cross, dot = "((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x))", "((b.x-a.x)*(c.x-a.x)+(b.y-a.y)*(c.y-a.y))"
    ORACLE_VIEWS[name] = f"""
        SELECT {", ".join("a." + c for c in keys)}, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {name}_outer a JOIN {name}_outer b ON {same("a", "b")}
        AND (a.x<>b.x OR a.y<>b.y) JOIN {name}_outer c ON {same("c", "a")} GROUP BY ALL
        HAVING min({cross}) >= -1e-13 AND bool_and({cross} > 1e-13 OR {dot} BETWEEN 0 AND (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))
    """


def shared_area(pairs: str, keys: list[str]) -> str:
    """Area both polygons of a pair have in common, from edges ``keys``, side, x1, y1, x2, y2, counter-clockwise, as SQL text.

    The outline of the intersection is what of each polygon's edges lies in the
    other; Green's theorem adds those pieces up. What lies on both outlines counts
    with the first polygon.
    """
    k, on = ", ".join(keys), lambda a, b: " AND ".join(f"{a}.{c}={b}.{c}" for c in keys)
    own = ", ".join("p." + c for c in keys)
    turn = "((p.x2-p.x1)*(q.y2-q.y1)-(p.y2-p.y1)*(q.x2-q.x1))"
    t = f"(((q.x1-p.x1)*(q.y2-q.y1)-(q.y1-p.y1)*(q.x2-q.x1))/nullif({turn},0))"
    u = f"(((q.x1-p.x1)*(p.y2-p.y1)-(q.y1-p.y1)*(p.x2-p.x1))/nullif({turn},0))"
    return f"""SELECT {k}, sum((ax*by_-bx*ay_)/2) AS shared FROM (
        SELECT {", ".join("z." + c for c in keys)}, z.side, ax, ay_, bx, by_ FROM (
          SELECT *, x1+t0*(x2-x1) AS ax, y1+t0*(y2-y1) AS ay_, x1+t1*(x2-x1) AS bx, y1+t1*(y2-y1) AS by_ FROM (
            SELECT *, t AS t0, lead(t) OVER (PARTITION BY {k}, side, x1, y1, x2, y2 ORDER BY t) AS t1 FROM (
              SELECT {k}, side, x1, y1, x2, y2, unnest([0e0, 1e0]) AS t FROM ({pairs}) p
              UNION SELECT {own}, p.side, p.x1, p.y1, p.x2, p.y2, {t} FROM ({pairs}) p JOIN ({pairs}) q ON {on("p", "q")} AND p.side<>q.side
              WHERE {t} > 0 AND {t} < 1 AND {u} BETWEEN 0 AND 1) c) c WHERE t1 IS NOT NULL) z
        JOIN ({pairs}) o ON {on("o", "z")} AND o.side<>z.side
        GROUP BY ALL HAVING CASE WHEN bool_or(abs((o.x2-o.x1)*((ay_+by_)/2-o.y1)-(o.y2-o.y1)*((ax+bx)/2-o.x1)) <= 1e-15
          AND (ax+bx)/2 BETWEEN least(o.x1,o.x2)-1e-12 AND greatest(o.x1,o.x2)+1e-12 AND (ay_+by_)/2 BETWEEN least(o.y1,o.y2)-1e-12 AND greatest(o.y1,o.y2)+1e-12
          AND (o.x2-o.x1)*(bx-ax)+(o.y2-o.y1)*(by_-ay_) > 0) THEN z.side ELSE sum(CASE WHEN (o.y1>(ay_+by_)/2) <> (o.y2>(ay_+by_)/2) AND (ax+bx)/2 < (o.x2-o.x1)*((ay_+by_)/2-o.y1)/(o.y2-o.y1)+o.x1
          THEN 1 ELSE 0 END) % 2 = 1 END) g GROUP BY {k}"""


hull_views("v_envelope", "(SELECT hypothesis, horizon, lon AS x, lat AS y FROM v_trim) t", ["hypothesis", "horizon"])


@query(
    "source_envelope",
    f"""SELECT g.hypothesis, g.horizon, count(t.lat) AS kept, {rnd('min(t.lat)')} AS min_lat, {rnd('max(t.lat)')} AS max_lat,
        {rnd('min(t.lon)')} AS min_lon, {rnd('max(t.lon)')} AS max_lon, CASE WHEN count(t.lat) > 0 THEN 'Polygon' END AS geometry_type, max(r.ring) AS ring
        FROM (SELECT DISTINCT hypothesis, horizon FROM v_particles) g
        LEFT JOIN v_trim t ON t.hypothesis=g.hypothesis AND t.horizon=g.horizon
        LEFT JOIN (SELECT hypothesis, horizon, string_agg(CAST(CAST(floor(x1*1e5+0.5e0) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(floor(y1*1e5+0.5e0) AS BIGINT) AS VARCHAR), ','
            ORDER BY CASE WHEN x2>x1 THEN 0 WHEN x2<x1 THEN 2 WHEN y2>y1 THEN 1 ELSE 3 END, CASE WHEN x2=x1 THEN 0e0 ELSE (y2-y1)/(x2-x1) END) AS ring
          FROM v_envelope GROUP BY hypothesis, horizon) r ON r.hypothesis=g.hypothesis AND r.horizon=g.horizon
        GROUP BY g.hypothesis, g.horizon""",
)
def source_envelope(t):
    """Trimmed count, extent and corners of the hull, counter-clockwise from the least longitude, in 1e-5 degrees."""
    keys = ["hypothesis", "horizon"]
    p = particles(t)
    kept = cut_lineage(ens.trimmed(p, keys))
    env = ens.source_envelopes(p, keys, kept).withColumn("_b", geo.ring_bbox(F.col("ring")))
    at = lambda c: F.floor(c * 1e5 + 0.5).cast("bigint").cast("string")
    corners = F.transform(F.slice("ring", 1, F.size("ring") - 1), lambda q: F.concat_ws(" ", at(q["x"]), at(q["y"])))
    counts = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    return env.join(counts, keys, "left").select(
        *keys,
        F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"),
        geo.rnd("_b.min_y", 6).alias("min_lat"),
        geo.rnd("_b.max_y", 6).alias("max_lat"),
        geo.rnd("_b.min_x", 6).alias("min_lon"),
        geo.rnd("_b.max_x", 6).alias("max_lon"),
        "geometry_type",
        F.when(F.col("ring").isNotNull(), F.array_join(corners, ",")).alias("ring"),
    )


@query(
    "region_validity",
    """SELECT c.hypothesis, c.horizon, c.n AS particle_count, CASE WHEN c.n >= 200 THEN 'VALID' WHEN c.n > 0 THEN 'PARTIAL' ELSE 'INVALID' END
       AS validity, c.n >= 200 AND CASE WHEN c.hypothesis % 4 = 3 THEN 0.75e0 ELSE 0.85e0 END >= 0.8e0 AS eligible
       FROM (SELECT hypothesis, horizon, count(*) FILTER (status=0) AS n FROM v_particles WHERE scenario='B' GROUP BY ALL) c""",
)
def region_validity(t):
    env = ens.source_envelopes(particles(t).filter("scenario = 'B'"))
    env = env.withColumn("forcing_fraction", F.when(F.col("hypothesis") % 4 == 3, 0.75).otherwise(0.85))
    return ens.region_validity(env).select("hypothesis", "horizon", "particle_count", "validity", "eligible")


ORACLE_VIEWS["v_trim3"] = """
    SELECT p.hypothesis, p.scenario, p.horizon, p.lon AS x, p.lat AS y FROM v_particles p JOIN (
      SELECT hypothesis, scenario, horizon, quantile_cont(lat, 0.025) AS a0, quantile_cont(lat, 0.975) AS a1,
             quantile_cont(lon, 0.025) AS o0, quantile_cont(lon, 0.975) AS o1 FROM v_particles WHERE status=0 GROUP BY ALL) c
    ON c.hypothesis=p.hypothesis AND c.scenario=p.scenario AND c.horizon=p.horizon
    WHERE p.status=0 AND p.lat BETWEEN a0 AND a1 AND p.lon BETWEEN o0 AND o1
"""
hull_views("v_hull3", "v_trim3", ens.KEYS)
ORACLE_VIEWS["v_hull_area"] = """
    SELECT hypothesis, scenario, horizon, sum((x1-57.6e0)*(y2+20.4e0)-(x2-57.6e0)*(y1+20.4e0))/2 AS area FROM v_hull3 GROUP BY ALL
"""
ORACLE_VIEWS["v_hull_pairs"] = """
    SELECT hypothesis, horizon, n, s = substr(n, 1, 1) AS side, x1-57.6e0 AS x1, y1+20.4e0 AS y1, x2-57.6e0 AS x2, y2+20.4e0 AS y2
    FROM (SELECT h.*, h.scenario AS s, unnest(CASE h.scenario WHEN 'A' THEN ['AB', 'AC'] WHEN 'B' THEN ['AB', 'BC'] ELSE ['AC', 'BC'] END) AS n FROM v_hull3 h) z
"""


def _iou(n: str) -> str:
    a, b = (f"max(h.area) FILTER (h.scenario='{s}')" for s in n)
    both = f"coalesce(max(s.shared) FILTER (s.n='{n}'), 0e0)"
    return f"{rnd(f'coalesce({both}/({a}+{b}-{both}), 0e0)', 4)} AS overlap_{n.lower()}"


@query(
    "polygon_iou",
    f"""SELECT h.hypothesis, h.horizon, {_iou('AB')}, {_iou('BC')}, {_iou('AC')} FROM v_hull_area h
        LEFT JOIN ({shared_area('SELECT * FROM v_hull_pairs', ['hypothesis', 'horizon', 'n'])}) s ON s.hypothesis=h.hypothesis AND s.horizon=h.horizon
        GROUP BY h.hypothesis, h.horizon""",
)
def polygon_iou(t):
    """Overlap of the scenario hulls."""
    env = ens.source_envelopes(particles(t), ens.KEYS).filter("ring IS NOT NULL")
    return ens.scenario_overlap(env, ["hypothesis", "horizon"])


def targets(t: Tables) -> DataFrame:
    """One candidate polygon per hypothesis."""
    base = particles(t).select("hypothesis").distinct()
    ring = geo.ring_from_offsets(
        F.lit(57.65) + (F.col("hypothesis") % 4) * 0.04, F.lit(-20.35) + (F.col("hypothesis") % 6) * 0.05, RINGS[1], 1.0
    )
    return base.withColumn("ring", ring)


ORACLE_VIEWS["v_target_points"] = f"""
    SELECT h.hypothesis, t.i, 57.65e0+(h.hypothesis % 4)*0.04e0+t.dx AS x, -20.35e0+(h.hypothesis % 6)*0.05e0+t.dy AS y
    FROM (SELECT DISTINCT hypothesis FROM v_particles) h JOIN (VALUES {TEMPLATE_ROWS}) t(shape,i,dx,dy) ON t.shape=1
"""
ORACLE_VIEWS["v_target_edges"] = """
    SELECT a.hypothesis, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v_target_points a JOIN v_target_points b
    ON a.hypothesis=b.hypothesis AND b.i=a.i+1
"""
ORACLE_VIEWS["v_target_measures"] = """
    SELECT hypothesis, abs(sum(cr))/2 AS area, max(x0)+sum((ax+bx)*cr)/(3*sum(cr)) AS cx, max(y0)+sum((ay+b_y)*cr)/(3*sum(cr)) AS cy
    FROM (SELECT *, ax*b_y-bx*ay AS cr FROM (SELECT e.hypothesis, p.x AS x0, p.y AS y0, e.x1-p.x AS ax, e.y1-p.y AS ay, e.x2-p.x AS bx,
          e.y2-p.y AS b_y FROM v_target_edges e JOIN v_target_points p ON p.hypothesis=e.hypothesis AND p.i=0) a) b GROUP BY hypothesis
"""
ORACLE_VIEWS["v_arrival_points"] = f"""
    SELECT hypothesis, scenario, horizon, rid, max(lat) AS lat, max(lon) AS lon, inside,
           CASE WHEN inside THEN 0e0 ELSE {hav('max(lat)','max(lon)','arg_min(ny,d2)','arg_min(nx,d2)')}/1000 END AS km
    FROM (SELECT *, sum(cross_) OVER (PARTITION BY rid) % 2 = 1 AND NOT bool_or(touch) OVER (PARTITION BY rid) AS inside, (nx-lon)*(nx-lon)+(ny-lat)*(ny-lat) AS d2
      FROM (SELECT *, x1+tt*(x2-x1) AS nx, y1+tt*(y2-y1) AS ny FROM (
        SELECT p.*, e.x1, e.y1, e.x2, e.y2,
               CASE WHEN (y1>lat) <> (y2>lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END AS cross_,
               (x2-x1)*(lat-y1)-(y2-y1)*(lon-x1) = 0 AND lon BETWEEN least(x1,x2) AND greatest(x1,x2)
                 AND lat BETWEEN least(y1,y2) AND greatest(y1,y2) AS touch,
               greatest(0e0, least(1e0, ((lon-x1)*(x2-x1)+(lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS tt
        FROM (SELECT *, row_number() OVER () AS rid FROM v_particles WHERE status=0) p
        JOIN v_target_edges e ON e.hypothesis=p.hypothesis) a) b) c
    GROUP BY hypothesis, scenario, horizon, rid, inside
"""
hull_views("v_cloud", f"(SELECT {HC}, lon AS x, lat AS y FROM v_particles WHERE status=0) t", ens.KEYS)
ORACLE_VIEWS["v_cloud_pairs"] = f"""
    SELECT {HC}, true AS side, x1-57.6e0 AS x1, y1+20.4e0 AS y1, x2-57.6e0 AS x2, y2+20.4e0 AS y2 FROM v_cloud
    UNION ALL SELECT c.hypothesis, c.scenario, c.horizon, false, x1-57.6e0, y1+20.4e0, x2-57.6e0, y2+20.4e0 FROM (SELECT DISTINCT {HC} FROM v_cloud) c
    JOIN v_target_edges e ON e.hypothesis=c.hypothesis
"""
ORACLE_VIEWS["v_cloud_area"] = f"""
    SELECT {HC}, sum(x1*y2-x2*y1)/2 AS hull FROM v_cloud_pairs WHERE side GROUP BY ALL
"""
ORACLE_VIEWS["v_cloud_shared"] = shared_area("SELECT * FROM v_cloud_pairs", ens.KEYS)
ORACLE_VIEWS["v_arrival"] = f"""
    SELECT c.hypothesis, c.scenario, c.horizon, c.total, coalesce(a.n,0) AS active_count, coalesce(a.n,0)/CAST(c.total AS DOUBLE) AS active_fraction,
      coalesce({hav('a.clat','a.clon','m.cy','m.cx')}/1000, 999e0) AS centroid_distance_km,
      coalesce(a.n_in/CAST(c.total AS DOUBLE), 0e0) AS inside_fraction, coalesce(a.n5/CAST(c.total AS DOUBLE), 0e0) AS within_500m_fraction,
      coalesce(a.n2/CAST(c.total AS DOUBLE), 0e0) AS within_2km_fraction, coalesce(a.md, 999e0) AS median_distance_km,
      coalesce(a.p90, 999e0) AS p90_distance_km, m.area*111e0*111e0*cos(radians(m.cy)) AS candidate_area_km2,
      sqrt(m.area*111e0*111e0*cos(radians(m.cy))/3.141592653589793e0) AS radius, c.total-coalesce(a.n,0) AS stranded_count,
      (c.total-coalesce(a.n,0))/CAST(c.total AS DOUBLE) AS stranded_fraction, coalesce(h.hull, 0e0)*111e0*111e0*cos(radians(m.cy)) AS convex_hull_area_km2,
      coalesce(s.shared, 0e0)/(coalesce(h.hull, 0e0)+m.area-coalesce(s.shared, 0e0)) AS iou
    FROM v_counts c LEFT JOIN (SELECT hypothesis, scenario, horizon, count(*) AS n, avg(lat) AS clat, avg(lon) AS clon,
        count(*) FILTER (inside) AS n_in, count(*) FILTER (km <= 0.5) AS n5, count(*) FILTER (km <= 2) AS n2,
        median(km) AS md, quantile_cont(km, 0.9) AS p90 FROM v_arrival_points GROUP BY ALL) a
      ON a.hypothesis=c.hypothesis AND a.scenario=c.scenario AND a.horizon=c.horizon
    JOIN v_target_measures m ON m.hypothesis=c.hypothesis
    LEFT JOIN v_cloud_area h ON h.hypothesis=c.hypothesis AND h.scenario=c.scenario AND h.horizon=c.horizon
    LEFT JOIN v_cloud_shared s ON s.hypothesis=c.hypothesis AND s.scenario=c.scenario AND s.horizon=c.horizon
"""
ARRIVAL_COLS = (
    "active_fraction", "centroid_distance_km", "inside_fraction", "within_500m_fraction", "within_2km_fraction",
    "median_distance_km", "p90_distance_km", "candidate_area_km2", "stranded_fraction", "convex_hull_area_km2",
)


def arrivals(t: Tables, shape: bool = True) -> DataFrame:
    return ens.arrival_metrics(particles(t), targets(t), ens.KEYS, shape)


@query(
    "arrival_metrics",
    f"SELECT {HC}, total, active_count, stranded_count, {rnd('iou', 4)} AS iou, "
    + ", ".join(f"{rnd(c)} AS {c}" for c in ARRIVAL_COLS)
    + f", {rnd('radius')} AS equivalent_radius_km, {rnd('centroid_distance_km/radius', 3)} AS normalized_error FROM v_arrival",
)
def arrival_metrics(t):
    df = arrivals(t)
    return df.select(
        "hypothesis", "scenario", "horizon", "total", "active_count", "stranded_count", "iou",
        *[geo.rnd(c, 6).alias(c) for c in ARRIVAL_COLS],
        geo.rnd("equivalent_radius_km", 6).alias("equivalent_radius_km"),
        "normalized_error",
    )


CLOSURE_SQL = """CASE WHEN active_fraction < 0.4e0 THEN 'INSUFFICIENT_DATA' WHEN active_fraction >= 0.8e0 AND centroid_distance_km <= 15
    AND (within_2km_fraction >= 0.5e0 OR p90_distance_km <= 20) THEN 'GOOD_CLOSURE' WHEN centroid_distance_km <= 35 THEN 'PARTIAL_CLOSURE'
    ELSE 'POOR_CLOSURE' END"""


@query("closure_class", f"SELECT {HC}, {CLOSURE_SQL} AS closure FROM v_arrival")
def closure_class(t):
    df = arrivals(t, shape=False)  # no class asks for the hull
    return df.select("hypothesis", "scenario", "horizon", ens.closure_class(df).alias("closure"))


@query(
    "closure_counts",
    f"""SELECT k.closure, count(a.closure) AS n, count(a.closure) > 0 AS seen FROM (VALUES ('GOOD_CLOSURE'),('PARTIAL_CLOSURE'),
        ('POOR_CLOSURE'),('INSUFFICIENT_DATA')) k(closure) LEFT JOIN (SELECT {CLOSURE_SQL} AS closure FROM v_arrival) a
        ON a.closure=k.closure GROUP BY k.closure""",
)
def closure_counts(t):
    """Closure classes counted, absent ones as 0."""
    df = arrivals(t, shape=False)  # no class asks for the hull
    seen = df.select(ens.closure_class(df).alias("closure")).groupBy("closure").agg(F.count(F.lit(1)).alias("n"))
    classes = t.spark.createDataFrame([(c,) for c in ens.CLOSURE_CLASSES], "closure string")
    return classes.join(seen, "closure", "left").select(
        "closure", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.col("n").isNotNull().alias("seen")
    )


@query(
    "validation_class",
    f"""SELECT region_id, CASE WHEN inside OR bd3 <= 5 OR cd3 <= 15 OR e3 <= 2.5 THEN 'STRONG_HISTORICAL_COMPATIBILITY'
        WHEN bd3 <= 25 OR cd3 <= 35 OR e3 <= 5 THEN 'MODERATE_HISTORICAL_COMPATIBILITY'
        WHEN bd3 <= 60 OR cd3 <= 75 THEN 'WEAK_HISTORICAL_COMPATIBILITY' ELSE 'INCOMPATIBLE' END AS validation_class
        FROM (SELECT *, {rnd('CASE WHEN inside THEN 0e0 ELSE bd END',3)} AS bd3, {rnd('cd',3)} AS cd3,
              {rnd('cd/sqrt(area_km2/3.141592653589793)',3)} AS e3 FROM v_truth_match) q""",
)
def validation_class(t):
    return truth_rows(t).select("region_id", ens.validation_class().alias("validation_class"))


@query(
    "horizon_temporal_class",
    """SELECT region_id, horizon_hours, CASE WHEN case_id % 5 = 4 THEN 'TRUTH_TIME_INSUFFICIENT' WHEN horizon_hours IN (72,96)
       THEN 'TEMPORALLY_COMPATIBLE' WHEN horizon_hours = 48 THEN 'PARTIALLY_COMPATIBLE' ELSE 'NOT_COMPATIBLE' END AS temporal_status
       FROM v_regions""",
)
def horizon_temporal_class(t):
    df = t.view("v_regions").withColumn(
        "release_start", F.when(F.col("case_id") % 5 != 4, F.lit("2020-08-06T00:00:00Z"))
    )
    return df.select("region_id", "horizon_hours", ens.horizon_temporal_class().alias("temporal_status"))


@query(
    "run_comparison",
    f"""SELECT b.hypothesis, b.n AS baseline_active, coalesce(c.n, 0) AS new_active,
        {rnd(f"abs(coalesce({hav('-20.3e0','57.7e0','c.c_lat','c.c_lon')}/1000, 0e0) - {hav('-20.3e0','57.7e0','b.c_lat','b.c_lon')}/1000)")}
        AS displacement_difference_km
        FROM (SELECT * FROM v_centers WHERE scenario='A' AND horizon=96) b LEFT JOIN
        (SELECT * FROM v_centers WHERE scenario='B' AND horizon=96 AND hypothesis % 4 <> 1) c ON c.hypothesis=b.hypothesis""",
)
def run_comparison(t):
    """Two runs by hypothesis; a hypothesis missing from the new run counts 0."""
    c = ens.centers(particles(t)).filter("horizon = 96")
    km = geo.haversine_m(F.lit(-20.3), F.lit(57.7), "c_lat", "c_lon") / 1000
    c = c.withColumn("km", km)
    base = c.filter("scenario = 'A'").select("hypothesis", F.col("active_count").alias("baseline_active"), F.col("km").alias("b"))
    new = c.filter("scenario = 'B' AND hypothesis % 4 <> 1").select("hypothesis", F.col("active_count").alias("n"), F.col("km").alias("k"))
    return base.join(new, "hypothesis", "left").select(
        "hypothesis",
        "baseline_active",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("new_active"),
        geo.rnd(F.abs(F.coalesce("k", F.lit(0.0)) - F.col("b")), 6).alias("displacement_difference_km"),
    )


def uniform_sql(number: str, tag: str) -> str:
    """The even number of ``operators.ensembles``, as SQL text."""
    return f"(CAST(('0x' || substr(md5(candidate_id || '|' || CAST({number} AS VARCHAR) || '|314159|{tag}'), 1, 10)) AS BIGINT)/1099511627776e0)"


# All attempts at once, the first forty inside each region.
@query(
    "seed_sample",
    f"""WITH b AS (SELECT candidate_id, region_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v_region_points GROUP BY ALL),
        a AS (SELECT b.candidate_id, region_id, k, x0+{uniform_sql('k', 'x')}*(x1-x0) AS lon, y0+{uniform_sql('k', 'y')}*(y1-y0) AS lat FROM b, (SELECT unnest(range(1, 801)) AS k) n),
        h AS (SELECT a.candidate_id, k, lon, lat FROM a JOIN v_region_edges e ON e.region_id=a.region_id GROUP BY a.candidate_id, k, lon, lat
          HAVING sum(CASE WHEN (y1>lat) <> (y2>lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END) % 2 = 1
            AND NOT bool_or((x2-x1)*(lat-y1)-(y2-y1)*(lon-x1) = 0 AND lon BETWEEN least(x1,x2) AND greatest(x1,x2) AND lat BETWEEN least(y1,y2) AND greatest(y1,y2)))
       SELECT candidate_id, seq, {rnd('lat', 9)} AS lat, {rnd('lon', 9)} AS lon FROM (SELECT *, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY k) AS INTEGER) AS seq FROM h) q
       WHERE seq <= 40""",
)
def seed_sample(t):
    """Forty seeds inside every source region."""
    from slickwatch.plans.vessel import regions

    seeds = ens.seed_particles(regions(t).select("candidate_id", "ring"), 40)
    return seeds.select("candidate_id", "seq", geo.rnd("lat", 9).alias("lat"), geo.rnd("lon", 9).alias("lon"))
