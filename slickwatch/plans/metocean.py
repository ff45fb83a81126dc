"""Queries on gridded forcing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators import candidates as cand
from slickwatch.operators import forcing as fc
from slickwatch.plans.registry import Tables, query, rnd
from slickwatch.plans.scene import located
from slickwatch.plans.vessel import hav
from slickwatch.plans.views import ORACLE_VIEWS

PAIRS = {"wind": ("u_wind", "v_wind"), "current": ("u_current", "v_current")}


def points(t: Tables) -> DataFrame:
    """Candidate centres with the dataset and time they are looked up at."""
    return located(t).select(
        F.col("ordinal").alias("point_id"),
        "candidate_id",
        "group_id",
        "ds",
        F.col("c_lat").alias("lat"),
        F.col("c_lon").alias("lon"),
        (F.lit(1596700000) + F.col("ordinal") * 13 % 9 * 10000).alias("t_s"),
        "nearshore_context",
    )


def drift_points(t: Tables) -> DataFrame:
    return t.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("particle_id"),
        F.floor(F.col("l_suppkey") / 14).alias("ds"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("scenario"),
        (F.lit(-21.7) + (F.col("l_orderkey") * 7919 % 2201) / 1000).alias("lat"),
        (F.lit(57.0) + (F.col("l_partkey") * 6271 % 2201) / 1000).alias("lon"),
        (F.lit(1596585600) + F.col("l_orderkey") % 120 * 3600).alias("t_s"),
    )


ORACLE_VIEWS["v_points"] = """
    SELECT ordinal AS point_id, candidate_id, group_id, ds, c_lat AS lat, c_lon AS lon,
           1596700000 + ordinal*13 % 9 * 10000 AS t_s, nearshore_context FROM v_located
"""
ORACLE_VIEWS["v_lat_axis"] = "SELECT ds, yi, lat, row_number() OVER (PARTITION BY ds ORDER BY lat)-1 AS k, count(*) OVER (PARTITION BY ds) AS n FROM (SELECT DISTINCT ds, yi, lat FROM v_grid) a"
ORACLE_VIEWS["v_lon_axis"] = "SELECT ds, xi, lon, row_number() OVER (PARTITION BY ds ORDER BY lon)-1 AS k, count(*) OVER (PARTITION BY ds) AS n FROM (SELECT DISTINCT ds, xi, lon FROM v_grid) a"
ORACLE_VIEWS["v_time_axis"] = "SELECT ds, ti, t_s, row_number() OVER (PARTITION BY ds ORDER BY t_s)-1 AS k, count(*) OVER (PARTITION BY ds) AS n FROM (SELECT DISTINCT ds, ti, t_s FROM v_grid) a"


def placed_sql(source: str) -> str:
    """Interval start, fraction and nearest places per axis, by joins."""
    def part(axis, col, idx, tag):
        return f"""
        (SELECT p.point_id, max(a.n) AS n{tag}, min(a.{col}) AS lo{tag}, max(a.{col}) AS hi{tag},
                greatest(0, least(max(a.n)-2, count(*) FILTER (a.{col} <= p.{col})-1)) AS {tag}0,
                arg_min(a.k, (abs(a.{col}-p.{col}), -a.k)) AS {tag}n, arg_min(a.k, (abs(a.{col}-p.{col}), a.k)) AS {tag}p
         FROM {source} p JOIN {axis} a ON a.ds=p.ds GROUP BY p.point_id)"""
    return f"""
    SELECT p.*, y.*EXCLUDE(point_id), x.*EXCLUDE(point_id), t.*EXCLUDE(point_id),
           coalesce(NOT (p.lat BETWEEN loy AND hiy AND p.lon BETWEEN lox AND hix), true) AS out_box
    FROM {source} p LEFT JOIN {part('v_lat_axis','lat','yi','y')} y ON y.point_id=p.point_id
    LEFT JOIN {part('v_lon_axis','lon','xi','x')} x ON x.point_id=p.point_id
    LEFT JOIN {part('v_time_axis','t_s','ti','t')} t ON t.point_id=p.point_id
    """


def corner_sql(placed: str, u: str, v: str) -> str:
    return f"""
    SELECT point_id, CASE WHEN count(gu)=8 THEN sum(w*gu) END AS u, CASE WHEN count(gu)=8 THEN sum(w*gv) END AS v
    FROM (SELECT p.point_id, CASE WHEN g.{u} IS NOT NULL AND g.{v} IS NOT NULL THEN g.{u} END AS gu,
                 CASE WHEN g.{u} IS NOT NULL AND g.{v} IS NOT NULL THEN g.{v} END AS gv,
                 (CASE WHEN ct.k=p.t0 THEN 1-(p.t_s-c0.t_s)/CAST(c1.t_s-c0.t_s AS DOUBLE) ELSE (p.t_s-c0.t_s)/CAST(c1.t_s-c0.t_s AS DOUBLE) END)
                 *(CASE WHEN cy.k=p.y0 THEN 1-(p.lat-y0.lat)/(y1.lat-y0.lat) ELSE (p.lat-y0.lat)/(y1.lat-y0.lat) END)
                 *(CASE WHEN cx.k=p.x0 THEN 1-(p.lon-x0.lon)/(x1.lon-x0.lon) ELSE (p.lon-x0.lon)/(x1.lon-x0.lon) END) AS w
          FROM {placed} p
          JOIN v_time_axis c0 ON c0.ds=p.ds AND c0.k=p.t0 JOIN v_time_axis c1 ON c1.ds=p.ds AND c1.k=p.t0+1
          JOIN v_lat_axis y0 ON y0.ds=p.ds AND y0.k=p.y0 JOIN v_lat_axis y1 ON y1.ds=p.ds AND y1.k=p.y0+1
          JOIN v_lon_axis x0 ON x0.ds=p.ds AND x0.k=p.x0 JOIN v_lon_axis x1 ON x1.ds=p.ds AND x1.k=p.x0+1
          JOIN v_time_axis ct ON ct.ds=p.ds AND ct.k IN (p.t0, p.t0+1)
          JOIN v_lat_axis cy ON cy.ds=p.ds AND cy.k IN (p.y0, p.y0+1)
          JOIN v_lon_axis cx ON cx.ds=p.ds AND cx.k IN (p.x0, p.x0+1)
          LEFT JOIN v_grid g ON g.ds=p.ds AND g.ti=ct.ti AND g.yi=cy.yi AND g.xi=cx.xi
          WHERE NOT p.out_box AND p.t_s BETWEEN p.lot AND p.hit) q GROUP BY point_id
    """


def patch_sql(placed: str, u: str, v: str) -> str:
    return f"""
    SELECT p.point_id, arg_min(g.{u}, o) AS u, arg_min(g.{v}, o) AS v FROM (
      SELECT p.point_id, p.ds, tt.ti, yy.yi, xx.xi, 1+yy.k*100000+xx.k AS o FROM {placed} p
        JOIN v_time_axis tt ON tt.ds=p.ds AND tt.k=p.tn
        JOIN v_lat_axis yy ON yy.ds=p.ds AND yy.k BETWEEN p.yp-3 AND p.yp+3
        JOIN v_lon_axis xx ON xx.ds=p.ds AND xx.k BETWEEN p.xp-3 AND p.xp+3
      UNION ALL
      SELECT p.point_id, p.ds, tt.ti, yy.yi, xx.xi, 0 FROM {placed} p
        JOIN v_time_axis tt ON tt.ds=p.ds AND tt.k=p.tn JOIN v_lat_axis yy ON yy.ds=p.ds AND yy.k=p.yn
        JOIN v_lon_axis xx ON xx.ds=p.ds AND xx.k=p.xn) p
    JOIN v_grid g ON g.ds=p.ds AND g.ti=p.ti AND g.yi=p.yi AND g.xi=p.xi
    WHERE g.{u} IS NOT NULL AND g.{v} IS NOT NULL GROUP BY p.point_id
    """


def forcing_sql(placed: str, u: str, v: str) -> str:
    return f"""
    SELECT p.point_id, CASE WHEN p.out_box THEN 0e0 ELSE coalesce(c.u, f.u, 0e0) END AS u,
           CASE WHEN p.out_box THEN 0e0 ELSE coalesce(c.v, f.v, 0e0) END AS v,
           CASE WHEN p.out_box THEN 'OUT_OF_DOMAIN' WHEN c.u IS NOT NULL OR f.u IS NOT NULL THEN 'VALID'
                ELSE 'MISSING_DATA' END AS status
    FROM {placed} p LEFT JOIN ({corner_sql(placed,u,v)}) c ON c.point_id=p.point_id
    LEFT JOIN ({patch_sql(placed,u,v)}) f ON f.point_id=p.point_id
    """


ORACLE_VIEWS["v_placed"] = placed_sql("v_points")
ORACLE_VIEWS["v_f_current"] = forcing_sql("v_placed", "u_current", "v_current")
ORACLE_VIEWS["v_f_wind"] = forcing_sql("v_placed", "u_wind", "v_wind")
ORACLE_VIEWS["v_f_deep"] = forcing_sql("v_placed", "u_deep", "v_deep")
BEARING_TO = "(degrees(atan2({u},{v})) - 360*floor(degrees(atan2({u},{v}))/360))"


def bearing_to(u, v):
    return BEARING_TO.format(u=u, v=v)


def bearing_from(u, v):
    return BEARING_TO.format(u=f"-({u})", v=f"-({v})")


ORACLE_VIEWS["v_aligned"] = f"""
    SELECT *, sqrt(wu*wu+wv*wv) AS ws, sqrt(cu*cu+cv*cv) AS cs,
           degrees(acos(greatest(-1e0, least(1e0, (wu*cu+wv*cv)/(sqrt(wu*wu+wv*wv)*sqrt(cu*cu+cv*cv)+1e-9))))) AS ang,
           CASE WHEN w_status='OUT_OF_DOMAIN' OR c_status='OUT_OF_DOMAIN' THEN 'OUT_OF_DOMAIN'
                WHEN w_status<>'VALID' OR c_status<>'VALID' THEN 'MISSING' ELSE 'VALID' END AS forcing_status
    FROM (SELECT p.*, w.u AS wu, w.v AS wv, w.status AS w_status, c.u AS cu, c.v AS cv, c.status AS c_status
          FROM v_points p JOIN v_f_wind w ON w.point_id=p.point_id JOIN v_f_current c ON c.point_id=p.point_id) q
"""


def aligned(t: Tables) -> DataFrame:
    return fc.aligned_forcing(points(t), t.view("v_grid"), PAIRS)


@query(
    "asof_forcing_nearest",
    f"""WITH pts AS (SELECT l_orderkey*10+l_linenumber AS particle_id, CAST(floor(l_suppkey/14e0) AS BIGINT) AS ds,
          CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS scenario,
          -21.7e0+(l_orderkey*7919 % 2201)/1000e0 AS lat, 57e0+(l_partkey*6271 % 2201)/1000e0 AS lon,
          1596585600+l_orderkey % 120*3600 AS t_s FROM lineitem),
        tn AS (SELECT p.ds, p.t_s, arg_min(a.ti, (abs(a.t_s-p.t_s), a.k)) AS ti FROM (SELECT DISTINCT ds, t_s FROM pts) p
               JOIN v_time_axis a ON a.ds=p.ds GROUP BY ALL),
        ln AS (SELECT p.ds, p.lat, least(count(*) FILTER (a.lat < p.lat), max(a.n)-1) AS yk, min(a.lat) AS lo, max(a.lat) AS hi
               FROM (SELECT DISTINCT ds, lat FROM pts) p JOIN v_lat_axis a ON a.ds=p.ds GROUP BY ALL),
        xn AS (SELECT p.ds, p.lon, least(count(*) FILTER (a.lon < p.lon), max(a.n)-1) AS xk, min(a.lon) AS lo, max(a.lon) AS hi
               FROM (SELECT DISTINCT ds, lon FROM pts) p JOIN v_lon_axis a ON a.ds=p.ds GROUP BY ALL)
       SELECT p.particle_id, p.scenario,
          {rnd("coalesce(u_current,0e0) + CASE WHEN scenario IN ('B','C') THEN coalesce(u_wind,0e0)*0.03e0 ELSE 0e0 END + CASE WHEN scenario='C' THEN coalesce(u_stokes,0e0) ELSE 0e0 END")} AS u_total,
          {rnd("coalesce(v_current,0e0) + CASE WHEN scenario IN ('B','C') THEN coalesce(v_wind,0e0)*0.03e0 ELSE 0e0 END + CASE WHEN scenario='C' THEN coalesce(v_stokes,0e0) ELSE 0e0 END")} AS v_total,
          CASE WHEN coalesce(p.lat < ln.lo OR p.lat > ln.hi OR p.lon < xn.lo OR p.lon > xn.hi, true) OR u_current IS NULL OR v_current IS NULL
               THEN 'OUT_OF_DOMAIN' ELSE 'ACTIVE' END AS status
       FROM pts p LEFT JOIN tn ON tn.ds=p.ds AND tn.t_s=p.t_s LEFT JOIN ln ON ln.ds=p.ds AND ln.lat=p.lat
       LEFT JOIN xn ON xn.ds=p.ds AND xn.lon=p.lon LEFT JOIN v_lat_axis y ON y.ds=p.ds AND y.k=ln.yk
       LEFT JOIN v_lon_axis x ON x.ds=p.ds AND x.k=xn.xk
       LEFT JOIN v_grid g ON g.ds=p.ds AND g.ti=tn.ti AND g.yi=y.yi AND g.xi=x.xi""",
)
def asof_forcing_nearest(t):
    df = fc.next_line_lookup(drift_points(t), t.view("v_grid"))
    return df.select(
        "particle_id", "scenario", geo.rnd("u_total", 6).alias("u_total"), geo.rnd("v_total", 6).alias("v_total"), "status"
    )


@query(
    "forcing_bilinear",
    f"""SELECT p.candidate_id, {rnd('c.u')} AS current_u, {rnd('c.v')} AS current_v, c.status AS current_status,
        {rnd('w.u')} AS wind_u, {rnd('w.v')} AS wind_v, w.status AS wind_status
        FROM v_points p JOIN v_f_current c ON c.point_id=p.point_id JOIN v_f_wind w ON w.point_id=p.point_id""",
)
def forcing_bilinear(t):
    df = fc.forcing_at(points(t), t.view("v_grid"), PAIRS)
    return df.select(
        "candidate_id",
        *[geo.rnd(c, 6).alias(c) for c in ("current_u", "current_v", "wind_u", "wind_v")],
        "current_status",
        "wind_status",
    )


@query(
    "vector_features",
    f"""SELECT candidate_id, {rnd('ws')} AS wind_speed_mps, {rnd('cs')} AS current_speed_mps,
        {rnd('ang', 5)} AS wind_current_angle_deg, {rnd(bearing_from('wu','wv'))} AS wind_direction_deg,
        {rnd(bearing_to('cu','cv'))} AS current_direction_deg, {rnd('cs/(ws+1e-6)')} AS current_wind_speed_ratio,
        {rnd('(wu*cu+wv*cv)/(ws+1e-6)')} AS along, {rnd('(wu*cv-wv*cu)/(ws+1e-6)')} AS across FROM v_aligned""",
)
def vector_features(t):
    df = aligned(t)
    return df.select(
        "candidate_id",
        *[
            geo.rnd(c, 6).alias(c)
            for c in (
                "wind_speed_mps",
                "current_speed_mps",
                "wind_direction_deg",
                "current_direction_deg",
                "current_wind_speed_ratio",
            )
        ],
        geo.rnd("wind_current_angle_deg", 5).alias("wind_current_angle_deg"),
        geo.rnd("current_component_along_wind_mps", 6).alias("along"),
        geo.rnd("current_component_across_wind_mps", 6).alias("across"),
    )


@query(
    "phys_context_labels",
    f"""SELECT candidate_id, concat_ws('|', CASE WHEN ws4 < 4 THEN 'WEAK_WIND' WHEN ws4 > 10 THEN 'STRONG_WIND' ELSE 'MODERATE_WIND' END,
        CASE WHEN cs4 < 0.15e0 THEN 'WEAK_CURRENT' WHEN cs4 > 0.40e0 THEN 'STRONG_CURRENT' ELSE 'MODERATE_CURRENT' END,
        CASE WHEN a2 <= 45 THEN 'WIND_CURRENT_ALIGNED' WHEN a2 >= 135 THEN 'WIND_CURRENT_OPPOSING' ELSE 'WIND_CURRENT_CROSSING' END)
        AS labels FROM (SELECT *, {rnd('ws',4)} AS ws4, {rnd('cs',4)} AS cs4, {rnd('ang',2)} AS a2 FROM v_aligned) q""",
)
def phys_context_labels(t):
    labels = cand.context_labels(
        geo.rnd("wind_speed_mps", 4), geo.rnd("current_speed_mps", 4), geo.rnd("wind_current_angle_deg", 2)
    )
    return aligned(t).select("candidate_id", labels.alias("labels"))


@query(
    "group_forcing",
    f"""SELECT group_id, count(*) AS candidate_count, {rnd("avg(ws) FILTER (forcing_status='VALID')")} AS mean_wind_speed_mps,
        {rnd("avg(cs) FILTER (forcing_status='VALID')")} AS mean_current_speed_mps,
        {rnd("avg(ang) FILTER (forcing_status='VALID')", 5)} AS mean_wind_current_angle_deg,
        {rnd('avg(CASE WHEN nearshore_context THEN 1e0 ELSE 0e0 END)')} AS nearshore_fraction,
        {rnd("avg(CASE WHEN forcing_status='VALID' THEN 1e0 ELSE 0e0 END)")} AS coverage_fraction
        FROM v_aligned GROUP BY group_id""",
)
def group_forcing(t):
    df = fc.group_forcing(aligned(t), ["group_id"])
    return df.select(
        "group_id",
        "candidate_count",
        *[
            geo.rnd(c, 5 if "angle" in c else 6).alias(c)
            for c in df.columns
            if c not in ("group_id", "candidate_count")
        ],
    )


ORACLE_VIEWS["v_sample_points"] = """
    SELECT p.point_id*100+o.h AS point_id, p.point_id AS base_id, p.ds, p.lat, p.lon, p.t_s+o.h*3600 AS t_s
    FROM v_points p JOIN (VALUES (-6),(-3),(0),(3),(6)) o(h) ON true
"""
ORACLE_VIEWS["v_sample_placed"] = placed_sql("v_sample_points")
ORACLE_VIEWS["v_s_wind"] = forcing_sql("v_sample_placed", "u_wind", "v_wind")
ORACLE_VIEWS["v_s_current"] = forcing_sql("v_sample_placed", "u_current", "v_current")
ORACLE_VIEWS["v_stability"] = f"""
    SELECT point_id, candidate_id, ds, group_id, wr AS wind_range, cr AS current_range, CASE WHEN dd > 180 THEN 360-dd ELSE dd END AS dir_drift
    FROM (SELECT s.base_id, max(ws)-min(ws) AS wr, max(cs)-min(cs) AS cr, max(d)-min(d) AS dd FROM (
            SELECT p.base_id, sqrt(w.u*w.u+w.v*w.v) AS ws, sqrt(c.u*c.u+c.v*c.v) AS cs, {bearing_from('w.u','w.v')} AS d
            FROM v_sample_points p JOIN v_s_wind w ON w.point_id=p.point_id JOIN v_s_current c ON c.point_id=p.point_id) s
          GROUP BY s.base_id) q JOIN v_points p ON p.point_id=q.base_id
"""
STABILITY = """CASE WHEN wind_range > 6 OR dir_drift > 45 THEN 'HIGHLY_VARIABLE'
    WHEN wind_range > 3 OR dir_drift > 25 THEN 'MODERATELY_VARIABLE' ELSE 'STABLE' END"""


def stability_rows(t: Tables) -> DataFrame:
    pts = points(t)
    return fc.stability(pts, t.view("v_grid"), PAIRS).join(
        pts.select("point_id", "candidate_id", "ds", "group_id"), "point_id"
    )


@query(
    "forcing_range_12h",
    f"""SELECT candidate_id, {rnd('wind_range')} AS wind_range, {rnd('current_range')} AS current_range,
        {rnd('dir_drift')} AS dir_drift FROM v_stability""",
)
def forcing_range_12h(t):
    return stability_rows(t).select(
        "candidate_id", *[geo.rnd(c, 6).alias(c) for c in ("wind_range", "current_range", "dir_drift")]
    )


@query(
    "stability_class",
    f"""SELECT group_id, count(*) FILTER (st='STABLE') AS n_stable, count(*) FILTER (st='MODERATELY_VARIABLE') AS n_moderately_variable,
        count(*) FILTER (st='HIGHLY_VARIABLE') AS n_highly_variable,
        CASE WHEN count(*) FILTER (st='HIGHLY_VARIABLE') = 0 THEN 'PASS'
             WHEN count(*) FILTER (st='HIGHLY_VARIABLE') < 10 THEN 'WARNING' ELSE 'FAIL' END AS overall_status
        FROM (SELECT *, {STABILITY} AS st FROM v_stability) q GROUP BY group_id""",
)
def stability_class(t):
    classed = stability_rows(t).withColumn("stability", fc.stability_class())
    return fc.stability_summary(classed, ["group_id"])


ORACLE_VIEWS["v_depth"] = f"""
    SELECT p.*, abs(sqrt(s.u*s.u+s.v*s.v)-sqrt(d.u*d.u+d.v*d.v)) AS speed_diff,
           abs((bs-bd+180) - 360*floor((bs-bd+180)/360) - 180) AS dir_diff
    FROM v_points p JOIN (SELECT *, {bearing_to('u','v')} AS bs FROM v_f_current) s ON s.point_id=p.point_id
    JOIN (SELECT *, {bearing_to('u','v')} AS bd FROM v_f_deep) d ON d.point_id=p.point_id
"""


@query(
    "depth_sensitivity",
    f"""SELECT ds, {rnd('median(speed_diff)')} AS median_speed_diff, {rnd('quantile_cont(speed_diff,0.95)')} AS p95_speed_diff,
        {rnd('median(dir_diff)',5)} AS median_dir_diff, {rnd('quantile_cont(dir_diff,0.95)',5)} AS p95_dir_diff,
        CASE WHEN median(speed_diff) < 0.10e0 AND median(dir_diff) < 15 THEN 'PASS' ELSE 'WARNING' END AS status
        FROM v_depth GROUP BY ds""",
)
def depth_sensitivity(t):
    diffs = fc.depth_sensitivity(points(t), t.view("v_grid"), ("u_current", "v_current"), ("u_deep", "v_deep"))
    df = fc.depth_summary(diffs, ["ds"])
    return df.select(
        "ds",
        *[geo.rnd(c, 6).alias(c) for c in ("median_speed_diff", "p95_speed_diff")],
        *[geo.rnd(c, 5).alias(c) for c in ("median_dir_diff", "p95_dir_diff")],
        "status",
    )


ORACLE_VIEWS["v_wet"] = f"""
    SELECT *, {hav('lat','lon','alat','alon')} AS offset_m,
           CASE WHEN {hav('lat','lon','alat','alon')} > 15000 THEN 'INSUFFICIENT_SPATIAL_SUPPORT' ELSE 'VALID' END AS support
    FROM (SELECT p.*, CASE WHEN c.u IS NOT NULL THEN p.lat ELSE coalesce(f.lat, ya.lat) END AS alat,
             CASE WHEN c.u IS NOT NULL THEN p.lon ELSE coalesce(f.lon, xa.lon) END AS alon,
             CASE WHEN c.u IS NOT NULL THEN 'BILINEAR_VALID_OCEAN' ELSE 'NEAREST_WET_CELL' END AS method
          FROM v_placed p LEFT JOIN ({corner_sql('v_placed','u_current','v_current')}) c ON c.point_id=p.point_id
          LEFT JOIN (SELECT p.point_id, arg_min(g.lat, ({hav('p.lat','p.lon','g.lat','g.lon')}, yy.k, xx.k)) AS lat,
                            arg_min(g.lon, ({hav('p.lat','p.lon','g.lat','g.lon')}, yy.k, xx.k)) AS lon
                     FROM v_placed p JOIN v_time_axis tt ON tt.ds=p.ds AND tt.k=p.tn
                     JOIN v_lat_axis yy ON yy.ds=p.ds AND yy.k BETWEEN p.yp-3 AND p.yp+3
                     JOIN v_lon_axis xx ON xx.ds=p.ds AND xx.k BETWEEN p.xp-3 AND p.xp+3
                     JOIN v_grid g ON g.ds=p.ds AND g.ti=tt.ti AND g.yi=yy.yi AND g.xi=xx.xi
                     WHERE g.u_current IS NOT NULL AND g.v_current IS NOT NULL GROUP BY p.point_id) f ON f.point_id=p.point_id
          LEFT JOIN v_lat_axis ya ON ya.ds=p.ds AND ya.k=p.yp LEFT JOIN v_lon_axis xa ON xa.ds=p.ds AND xa.k=p.xp) q
"""


def wet(t: Tables) -> DataFrame:
    return fc.wet_cells(points(t), t.view("v_grid"), ("u_current", "v_current"))


@query(
    "nearest_wet_cell",
    f"""SELECT candidate_id, {rnd('alat')} AS actual_lat, {rnd('alon')} AS actual_lon, method, {rnd('offset_m',3)} AS offset_m, support
        FROM v_wet""",
)
def nearest_wet_cell(t):
    return wet(t).select(
        "candidate_id",
        geo.rnd("actual_lat", 6).alias("actual_lat"),
        geo.rnd("actual_lon", 6).alias("actual_lon"),
        "method",
        geo.rnd("offset_m", 3).alias("offset_m"),
        "support",
    )


@query(
    "offset_summary",
    f"""SELECT ds, {rnd('max(offset_m)',3)} AS max_offset_m, {rnd('median(offset_m)',3)} AS median_offset_m,
        count(*) FILTER (support <> 'VALID') AS unsupported FROM v_wet GROUP BY ds""",
)
def offset_summary(t):
    df = fc.offset_summary(wet(t), ["ds"])
    return df.select(
        "ds", geo.rnd("max_offset_m", 3).alias("max_offset_m"), geo.rnd("median_offset_m", 3).alias("median_offset_m"), "unsupported"
    )


@query(
    "forcing_gate",
    f"""SELECT q.ds, count(*) AS candidates, count(*) FILTER (w_status='VALID') AS valid_wind, count(*) FILTER (c_status='VALID') AS valid_current,
        count(*) FILTER (forcing_status='OUT_OF_DOMAIN') AS out_of_domain, count(*) FILTER (forcing_status='MISSING') AS missing,
        {rnd("avg(CASE WHEN w_status='VALID' THEN 1e0 ELSE 0e0 END)")} AS coverage, bool_and(s.wind_range < 4) AS all_stable,
        CASE WHEN count(*) FILTER (forcing_status='OUT_OF_DOMAIN')=0 AND bool_and(s.wind_range < 4)
              AND bool_and(w_status='VALID') AND bool_and(c_status='VALID') THEN 'PASS' ELSE 'FAILED_ALIGNMENT' END AS gate
        FROM v_aligned q JOIN v_stability s ON s.point_id=q.point_id GROUP BY q.ds""",
)
def forcing_gate(t):
    df = fc.aligned_and_stable(points(t), t.view("v_grid"), PAIRS).withColumn("is_stable", F.col("wind_range") < 4.0)
    return fc.forcing_gate(df, ["ds"]).withColumn("coverage", geo.rnd("coverage", 6))


@query(
    "dataset_extent",
    f"""SELECT ds, {rnd('min(lat)')} AS lat_min, {rnd('max(lat)')} AS lat_max, {rnd('min(lon)')} AS lon_min, {rnd('max(lon)')} AS lon_max,
        min(t_s) AS start_s, max(t_s) AS end_s, 0.22e0 AS spatial_res_deg,
        CASE WHEN count(DISTINCT t_s) > 1 THEN 6e0 END AS time_res_hours FROM v_grid GROUP BY ds""",
)
def dataset_extent(t):
    df = fc.dataset_extent(t.view("v_grid"))
    for c in ("lat_min", "lat_max", "lon_min", "lon_max"):
        df = df.withColumn(c, geo.rnd(c, 6))
    return df


@query(
    "coverage_96h",
    """SELECT e.ds, e.target_s, CASE WHEN g.lo IS NULL THEN 'UNAVAILABLE' WHEN g.lo <= e.target_s-345600 AND g.hi >= e.target_s
        THEN 'PASS' ELSE 'FAIL' END AS coverage_status
       FROM (SELECT s_suppkey AS ds, 1596900000+(s_suppkey*7 % 5)*50000 AS target_s FROM supplier) e
       LEFT JOIN (SELECT ds, min(t_s) AS lo, max(t_s) AS hi FROM v_grid GROUP BY ds) g ON g.ds=e.ds""",
)
def coverage_96h(t):
    expected = t.table("supplier").select(
        F.col("s_suppkey").alias("ds"), (F.lit(1596900000) + F.col("s_suppkey") * 7 % 5 * 50000).alias("target_s")
    )
    return fc.coverage_96h(fc.dataset_extent(t.view("v_grid")), expected).select("ds", "target_s", "coverage_status")


def _coverage_cols(name, types, needs):
    kind = f"coalesce(evidence_type IN {types}, false)"
    use = f"({kind} AND has_u AND has_v)" if needs else f"({kind})"
    inside = "lat BETWEEN lat_min-0.05e0 AND lat_max+0.05e0 AND lon BETWEEN lon_min-0.05e0 AND lon_max+0.05e0"
    covers = "start_s <= obs_s-43200+300 AND end_s >= obs_s-300"
    return f"""bool_or({kind}) AS {name}_present, coalesce(bool_or({use} AND {inside}), false) AS {name}_spatial,
        coalesce(bool_or({use} AND {covers}), false) AS {name}_temporal,
        min(start_s) FILTER ({use}) AS {name}_start_s, max(end_s) FILTER ({use}) AS {name}_end_s"""


@query(
    "coverage_check",
    f"""WITH c AS (SELECT c.case_id, {_coverage_cols('current', "('ocean_current','met_ocean')", True)},
          {_coverage_cols('wind', "('wind','met_ocean')", True)}, {_coverage_cols('wave', "('wave','met_ocean')", False)}
          FROM v_case_list c LEFT JOIN v_evidence e ON e.case_id=c.case_id GROUP BY c.case_id)
       SELECT *, reasons='' AS ready FROM (SELECT *, concat_ws('|', CASE WHEN NOT current_present THEN 'missing_current_data' END,
          CASE WHEN current_present AND NOT current_spatial THEN 'current_spatial_gap' END,
          CASE WHEN current_present AND NOT current_temporal THEN 'current_temporal_gap' END,
          CASE WHEN NOT wind_present THEN 'missing_wind_data' END,
          CASE WHEN wind_present AND NOT wind_spatial THEN 'wind_spatial_gap' END,
          CASE WHEN wind_present AND NOT wind_temporal THEN 'wind_temporal_gap' END) AS reasons FROM c) q""",
)
def coverage_check(t):
    df = fc.coverage_check(t.view("v_case_list"), t.view("v_evidence"), 12.0)
    return df.withColumn("reasons", F.concat_ws("|", "reasons"))
