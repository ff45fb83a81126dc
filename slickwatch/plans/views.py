"""Tables the queries read, derived by rule from the given parquet tables.

The given tables hold no vessels, rasters or grids, so each view maps whole
rows of a given table onto one of the engine's record types. The text is SQL
both Spark and DuckDB accept: doubles are written with an exponent (a plain
``1000.0`` is a decimal in both), and the few places where the dialects differ
are named placeholders. No view subsets its table.
"""

from __future__ import annotations

import re

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # Vessel reports, in seasons of 40 days: more reports are more seasons, not a
    # denser sea, so what a case retrieves does not grow. Fixed residues carry each kind of fault: bad latitude,
    # short identity, impossible speed, out-of-range course, repeated report,
    # unreadable coordinate.
    "v_positions": """
        SELECT event_id*2+copy AS ordinal,
               CASE WHEN event_id % 197 = 3 THEN '123'
                    ELSE CAST(538000000+user_id AS STRING) END AS mmsi,
               @mkts(1596585600000000 + CAST(floor(event_id/10000e0) AS BIGINT)*3456000000000
                     + CAST(floor((us-1704067200000000) / CAST(1+user_id%40 AS DOUBLE)) AS BIGINT)) AS ts,
               CASE WHEN event_id % 307 = 2 THEN 'n/a'
                    WHEN event_id % 211 = 5 THEN '-95.0'
                    ELSE CAST(-22e0+(event_id*7919 % 3000)/1000e0 AS STRING) END AS lat_text,
               CAST(56.5e0+(event_id*104729 % 3500)/1000e0 AS STRING) AS lon_text,
               CASE WHEN event_id % 199 = 11 THEN 85e0
                    ELSE (user_id % 5)*2e0 + value % CAST(5+user_id%9 AS DOUBLE) END AS sog,
               CASE WHEN event_id % 223 = 9 THEN 400e0
                    ELSE ((event_id*37) % 360)*1e0 END AS cog,
               CASE WHEN user_id % 11 = 4 THEN NULL
                    ELSE 'MV ' || CAST(user_id AS STRING) END AS vessel_name,
               CASE user_id % 4 WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Cargo'
                    WHEN 2 THEN 'Bulk' ELSE 'Fishing' END AS vessel_type
        FROM (SELECT event_id, user_id, value, @us(@ts) AS us, 0 AS copy FROM {events}
              UNION ALL
              SELECT event_id, user_id, value, @us(@ts) AS us, 1 AS copy FROM {events}
              WHERE event_id % 173 = 7) b
    """,
    # A case belongs to the season of its first region and groups eight source regions: the reference engine selects at most
    # ten hypotheses per case, so the regions of one case are bounded.
    "v_cases": """
        SELECT case_id,
               -21.4e0+(case_id*37 % 18)/10e0 AS aoi_lat,
               57.1e0+(case_id*53 % 23)/10e0 AS aoi_lon,
               @mkts(1597023487500000 + CAST(floor(case_id*8/100e0) AS BIGINT)*3456000000000 - (case_id % 3)*43200000000) AS obs_ts
        FROM (SELECT DISTINCT CAST(floor(s_suppkey/8e0) AS BIGINT) AS case_id
              FROM {supplier}) c
    """,
    "v_regions": """
        SELECT s_suppkey AS region_id,
               CAST(floor(s_suppkey/8e0) AS BIGINT) AS case_id,
               'HC' || CAST(s_suppkey AS STRING) AS candidate_id,
               CASE s_suppkey % 4 WHEN 0 THEN 24 WHEN 1 THEN 48 WHEN 2 THEN 72
                    ELSE 96 END AS horizon_hours,
               -21.4e0+(CAST(floor(s_suppkey/8e0) AS BIGINT)*37 % 18)/10e0
                   +((s_suppkey*17 % 11)-5)*0.05e0 AS c_lat,
               57.1e0+(CAST(floor(s_suppkey/8e0) AS BIGINT)*53 % 23)/10e0
                   +((s_suppkey*29 % 13)-6)*0.05e0 AS c_lon,
               s_suppkey % 3 AS shape,
               s_acctbal >= 0e0 AS eligible
        FROM {supplier}
    """,
    "v_candidates": """
        SELECT p_partkey AS ordinal,
               'C' || CAST(p_partkey AS STRING) AS candidate_id,
               CAST(floor(p_partkey/50e0) AS BIGINT) AS scene_id,
               CASE WHEN p_size % 7 = 0 THEN 'GRP_UNASSIGNED' ELSE p_brand END AS group_id,
               CASE WHEN p_size % 10 = 0 THEN p_size*6e0
                    WHEN p_size % 10 = 1 THEN p_size*0.002e0
                    ELSE p_size/4e0 END AS area_km2,
               p_size*7 + p_partkey % 50 AS pixel_count,
               (p_partkey*13 % 70)/10e0 AS contrast_db,
               1e0+(p_partkey*7 % 40)/10e0 AS elongation,
               (p_partkey*11 % 100)/100e0 AS compactness,
               0.4e0+(p_partkey*3 % 60)/100e0 AS solidity,
               (p_partkey*47 % 180)*1e0 AS orientation_deg,
               p_partkey % 23 = 0 AS edge_touching,
               p_partkey % 29 = 0 AS touches_invalid,
               CASE WHEN p_partkey % 9 = 0 THEN 0.2e0 WHEN p_partkey % 9 = 1 THEN 0.05e0
                    ELSE 0e0 END AS land_overlap,
               CASE WHEN p_partkey % 8 = 3 THEN 0.15e0 ELSE 0.02e0 END AS buffer_overlap,
               (p_partkey*101 % 5000)*1e0 AS distance_to_land_m,
               (p_partkey*17 % 1000)/10e0 AS orig_score,
               (p_partkey*29 % 1000)/1000e0 AS oil_like_score,
               -21.5e0+(CAST(floor(p_partkey/50e0) AS BIGINT)*7 % 20)/10e0
                   +((p_partkey*13 % 50)-25)*0.004e0 AS c_lat,
               57.2e0+(CAST(floor(p_partkey/50e0) AS BIGINT)*11 % 20)/10e0
                   +((p_partkey*31 % 50)-25)*0.004e0 AS c_lon,
               0.002e0+(p_partkey % 5)*0.001e0 AS half_width,
               CAST(floor(p_partkey/260e0) AS BIGINT) AS ds
        FROM {part}
    """,
    # Islands; one ring template scaled per row. Some have a second part.
    "v_land": """
        SELECT land_id, part, c_lat, c_lon + part*0.11e0 AS c_lon, half_width/(1e0+part) AS half_width, shape
        FROM (SELECT s_suppkey AS land_id, 0 AS part,
               -21.5e0+(s_suppkey*7 % 20)/10e0 + ((s_suppkey*3 % 7)-3)*0.02e0 AS c_lat,
               57.2e0+(s_suppkey*11 % 20)/10e0 + ((s_suppkey*5 % 9)-4)*0.02e0 AS c_lon,
               0.008e0+(s_suppkey % 4)*0.004e0 AS half_width,
               s_suppkey % 3 AS shape
        FROM {supplier}
        UNION ALL
        SELECT s_suppkey, 1, -21.5e0+(s_suppkey*7 % 20)/10e0 + ((s_suppkey*3 % 7)-3)*0.02e0,
               57.2e0+(s_suppkey*11 % 20)/10e0 + ((s_suppkey*5 % 9)-4)*0.02e0,
               0.008e0+(s_suppkey % 4)*0.004e0, s_suppkey % 3
        FROM {supplier} WHERE s_suppkey % 5 = 2) l
    """,
    # Forcing lattice: 10 x 10 cells, 20 six-hour steps, 2000 cells a dataset.
    "v_grid": """
        SELECT CAST(floor(o_orderkey/2000e0) AS BIGINT) AS ds,
               CAST(floor(o_orderkey/100e0) AS BIGINT) % 20 AS ti,
               CAST(floor(o_orderkey/10e0) AS BIGINT) % 10 AS yi,
               o_orderkey % 10 AS xi,
               1596585600 + (CAST(floor(o_orderkey/100e0) AS BIGINT) % 20)*21600 AS t_s,
               -21.6e0 + (CAST(floor(o_orderkey/10e0) AS BIGINT) % 10)*0.22e0 AS lat,
               57.1e0 + (o_orderkey % 10)*0.22e0 AS lon,
               CASE WHEN (o_orderkey*31) % 17 = 0 OR (o_orderkey % 100) IN (44,45,54,55,56,64,65,66)
                    THEN NULL ELSE ((o_orderkey*37) % 101 - 50)/100e0 END AS u_current,
               CASE WHEN (o_orderkey*31) % 17 = 0 OR (o_orderkey % 100) IN (44,45,54,55,56,64,65,66)
                    THEN NULL ELSE ((o_orderkey*53) % 101 - 50)/100e0 END AS v_current,
               ((o_orderkey*7) % 241 - 120)/10e0 AS u_wind,
               ((o_orderkey*11) % 201 - 100)/10e0 AS v_wind,
               ((o_orderkey*5) % 41 - 20)/100e0 AS u_stokes,
               ((o_orderkey*3) % 41 - 20)/100e0 AS v_stokes,
               ((o_orderkey*41) % 101 - 50)/110e0 AS u_deep,
               ((o_orderkey*59) % 101 - 50)/110e0 AS v_deep
        FROM {orders}
    """,
    # Scenes of 50 x 50 pixels; two dark blocks and isolated dark specks.
    "v_pixels": """
        SELECT CAST(floor(event_id/2500e0) AS BIGINT) AS scene_id,
               CAST(floor((event_id % 2500)/50e0) AS BIGINT) AS y,
               event_id % 50 AS x,
               CASE WHEN event_id % 389 = 17 THEN NULL
                    WHEN event_id % 401 = 23 THEN 45e0
                    ELSE -12e0 - (value % 7e0)/10e0
                      - CASE WHEN floor((event_id % 2500)/50e0) BETWEEN 10 AND 19
                              AND event_id % 50 BETWEEN 8 AND 21 THEN 9e0
                             WHEN floor((event_id % 2500)/50e0) BETWEEN 30 AND 36
                              AND event_id % 50 - (CAST(floor((event_id % 2500)/50e0) AS BIGINT) - 30)
                                  BETWEEN 25 AND 34 THEN 7e0
                             WHEN event_id % 331 = 5 THEN 8e0 ELSE 0e0 END END AS vv_db,
               CASE WHEN event_id % 397 = 29 THEN NULL
                    ELSE -18e0 - (value % 5e0)/10e0
                      - CASE WHEN floor((event_id % 2500)/50e0) BETWEEN 10 AND 19
                              AND event_id % 50 BETWEEN 8 AND 21 THEN 5e0 ELSE 0e0 END
                    END AS vh_db,
               CASE WHEN event_id % 50 >= 46 THEN 0 ELSE 1 END AS ocean
        FROM {events}
    """,
    # Particle snapshots of an ensemble: hypothesis, scenario, horizon.
    "v_particles": """
        SELECT l_orderkey*10+l_linenumber AS particle_id,
               CAST(floor(l_suppkey/10e0) AS BIGINT) AS hypothesis,
               CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS scenario,
               CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 24 WHEN 1 THEN 48 WHEN 2 THEN 72
                    ELSE 96 END AS horizon,
               (l_partkey % 32)*3 AS elapsed_h,
               CASE WHEN (l_orderkey*13+l_linenumber) % 100 < (CAST(floor(l_suppkey/10e0) AS BIGINT) % 10)
                         * (1 + CAST(l_quantity AS BIGINT) % 4) * 2 THEN 1
                    WHEN l_tax > 0.075e0 AND l_returnflag = 'A' THEN 2
                    WHEN l_tax > 0.075e0 AND l_returnflag = 'R' THEN 3
                    WHEN l_tax < 0.005e0 AND l_linestatus = 'O' AND l_returnflag = 'N' THEN 4
                    WHEN l_quantity > 49.5e0 THEN 5 ELSE 0 END AS status,
               -20.4e0 + CAST(floor(l_suppkey/10e0) AS BIGINT) % 7 * 0.05e0
                   + ((l_orderkey*7919 + l_linenumber*101) % 2001 - 1000)/10000e0
                   + (CASE l_partkey % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 0.03e0 ELSE 0.09e0 END)
                     * (CAST(floor(l_suppkey/10e0) AS BIGINT) % 5) AS lat,
               57.6e0 + CAST(floor(l_suppkey/10e0) AS BIGINT) % 5 * 0.05e0
                   + ((l_orderkey*6271 + l_linenumber*211) % 2001 - 1000)/10000e0 AS lon
        FROM {lineitem}
    """,
    # Segmentation predictions, one scene category each.
    "v_predictions": """
        SELECT CAST(floor(event_id/500e0) AS BIGINT) AS scene_id,
               CASE CAST(floor(event_id/500e0) AS BIGINT) % 4 WHEN 0 THEN 'oil' WHEN 1 THEN 'lookalike'
                    WHEN 2 THEN 'no_oil' ELSE 'oil' END AS category,
               CAST(floor((event_id % 500)/25e0) AS BIGINT) AS y, event_id % 25 AS x,
               value/(CASE WHEN CAST(floor(event_id/500e0) AS BIGINT) % 4 = 2 THEN 900e0 ELSE 60e0 END) AS p,
               event_type = 'error' AND CAST(floor(event_id/500e0) AS BIGINT) % 4 IN (0,3) AS truth
        FROM {events}
    """,
    # Scene samples of a training manifest.
    "v_samples": """
        SELECT 'S1_' || source || '_' || CAST(doc_id AS STRING) AS scene_id,
               CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split,
               CASE WHEN doc_id % 3 = 0 THEN NULL
                    ELSE '2020-' || CASE WHEN doc_id % 12 < 9 THEN '0' ELSE '' END
                         || CAST(1 + doc_id % 12 AS STRING) || '-1' || CAST(doc_id % 9 AS STRING)
                         || 'T01:00:00Z' END AS acquired,
               CASE doc_id % 3 WHEN 0 THEN 'oil' WHEN 1 THEN 'lookalike' ELSE 'no_oil' END AS category,
               'img/' || source || '/' || CAST(doc_id AS STRING) || '.tif' AS vv_path,
               doc_id, n_chars, lang
        FROM {documents}
    """,
    # Analysis results appended to cases.
    "v_results": """
        SELECT o_orderkey AS ordinal, o_custkey AS case_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'oil_detection' WHEN 1 THEN 'spill_geometry'
                    ELSE 'hindcast_readiness' END AS module,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running'
                    ELSE 'completed' END AS status,
               'AN' || CAST(o_orderkey AS STRING) AS analysis_id,
               o_totalprice AS score
        FROM {orders}
    """,
    # Evidence items of a case.
    "v_evidence": """
        SELECT o_orderkey AS ordinal, o_custkey AS case_id,
               CASE o_orderkey % 6 WHEN 0 THEN 'sar_image' WHEN 1 THEN 'ais' WHEN 2 THEN 'ocean_current'
                    WHEN 3 THEN 'wind' WHEN 4 THEN 'met_ocean' ELSE 'wave' END AS evidence_type,
               'EV' || CAST(o_orderkey AS STRING) AS evidence_id,
               -21e0 + (o_orderkey*13 % 20)/10e0 AS lat_min,
               -20e0 + (o_orderkey*13 % 20)/10e0 AS lat_max,
               56.5e0 + (o_orderkey*7 % 20)/10e0 AS lon_min,
               58e0 + (o_orderkey*7 % 20)/10e0 AS lon_max,
               1596585600 + (o_orderkey*17 % 8)*43200 AS start_s,
               1596585600 + (o_orderkey*17 % 8)*43200 + (2 + o_orderkey*3 % 9)*43200 AS end_s,
               o_orderkey % 5 <> 4 AS has_u, o_orderkey % 7 <> 6 AS has_v
        FROM {orders}
    """,
    "v_case_list": """
        SELECT c_custkey AS case_id, 'CASE-' || CAST(c_custkey AS STRING) AS case_code,
               c_name AS case_name, n_name AS location,
               CASE c_custkey % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'CLOSED' WHEN 2 THEN 'DEMONSTRATION'
                    ELSE 'REVIEW' END AS status,
               CASE WHEN c_custkey % 5 = 0 THEN 'Benchmark replay' ELSE 'Live' END AS mode,
               1596585600 + (c_custkey*7919) % 86400 AS created_s,
               -21e0 + (c_custkey*11 % 30)/10e0 AS lat, 57e0 + (c_custkey*7 % 30)/10e0 AS lon,
               1596585600 + (c_custkey*5 % 10)*43200 AS obs_s
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
    """,
}

# Views only the oracles use; plans/*.py adds to it beside the queries.
ORACLE_VIEWS: dict[str, str] = {}

_NAME = re.compile(r"\bv_[a-z0-9_]+\b")


def _with_clause(main: str, known: dict[str, str]) -> str:
    """Prefix ``main`` with the views it names, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(main)
    if not order:
        return main
    ctes = ",\n".join(f"{name} AS ({known[name].strip()})" for name in order)
    main = main.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if main.startswith(head):
            return f"{head}{ctes},\n{main[len(head):]}"
    return f"WITH {ctes}\n{main}"


def duck_sql(main: str) -> str:
    """Complete DuckDB text of an oracle."""
    text = _with_clause(main, {**VIEWS, **ORACLE_VIEWS})
    text = text.replace("@us(@ts)", "epoch_us(ts)").replace("@mkts", "make_timestamp")
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text


def spark_sql(name: str, folder: str) -> str:
    """Complete Spark text of one view over the parquet files in ``folder``."""
    text = _with_clause(f"SELECT * FROM {name}", VIEWS)
    text = text.replace("@us(@ts)", "unix_micros(CAST(ts AS TIMESTAMP))")
    text = text.replace("@mkts", "timestamp_micros")
    for table in TABLES:
        text = text.replace("{" + table + "}", f"parquet.`{folder}/{table}.parquet`")
    return text
