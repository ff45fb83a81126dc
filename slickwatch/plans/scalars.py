"""Queries on scalar functions and on the readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from slickwatch.functions import geo, text
from slickwatch.functions.shape import map_to_pixel, pixel_to_map
from slickwatch.operators import provenance as pv
from slickwatch.operators.spatial import with_box_cells, with_point_cell
from slickwatch.plans.registry import query, rnd
from slickwatch.plans.vessel import hav, parsed, regions
from slickwatch.session import scratch_folder
from slickwatch.sources import files


@query(
    "haversine_m",
    f"SELECT candidate_id, {rnd(hav('c_lat','c_lon','-20.5e0','57.5e0'),3)} AS metres FROM v_candidates",
)
def haversine_m(t):
    m = geo.haversine_m("c_lat", "c_lon", F.lit(-20.5), F.lit(57.5))
    return t.view("v_candidates").select("candidate_id", geo.rnd(m, 3).alias("metres"))


@query(
    "point_in_polygon",
    """SELECT p.ordinal, e.region_id FROM v_parsed p JOIN v_region_edges e ON p.lat BETWEEN -90 AND 90
       JOIN v_regions r ON r.region_id=e.region_id AND p.lon BETWEEN r.c_lon-0.08e0 AND r.c_lon+0.08e0 AND p.lat BETWEEN r.c_lat-0.05e0 AND r.c_lat+0.05e0
       GROUP BY p.ordinal, e.region_id HAVING sum(CASE WHEN (y1>lat) <> (y2>lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 THEN 1 ELSE 0 END) % 2 = 1
         AND NOT bool_or((x2-x1)*(lat-y1)-(y2-y1)*(lon-x1) = 0 AND lon BETWEEN least(x1,x2) AND greatest(x1,x2) AND lat BETWEEN least(y1,y2) AND greatest(y1,y2))""",
)
def point_in_polygon(t):
    """Positions inside regions: cells first, then the exact test, once for each place and region however many positions share it."""
    r = regions(t).select("region_id", "ring", geo.ring_bbox(F.col("ring")).alias("_b"))
    r = with_box_cells(r, "_b.min_x", "_b.min_y", "_b.max_x", "_b.max_y", 0.05)
    p = parsed(t).filter("lat BETWEEN -90 AND 90").select("ordinal", "lon", "lat")
    places = with_point_cell(p.select("lon", "lat").distinct(), "lon", "lat", 0.05)
    met = places.join(r.hint("merge"), ["_cx", "_cy"]).filter(geo.point_in_ring(F.col("ring"), "lon", "lat"))
    return p.join(met.select("lon", "lat", "region_id").hint("merge"), ["lon", "lat"]).select("ordinal", "region_id")


@query(
    "boundary_distance",
    f"""SELECT region_id, {rnd(f"min({hav('t_lat','t_lon','y1','x1')})",3)} AS vertex_m, {rnd(hav('max(t_lat)','max(t_lon)','arg_min(ny,d2)','arg_min(nx,d2)'),3)} AS segment_m
        FROM (SELECT *, (nx-t_lon)*(nx-t_lon)+(ny-t_lat)*(ny-t_lat) AS d2 FROM (SELECT *, x1+tt*(x2-x1) AS nx, y1+tt*(y2-y1) AS ny FROM (
          SELECT t.region_id, t.t_lat, t.t_lon, x1, y1, x2, y2,
            greatest(0e0, least(1e0, ((t_lon-x1)*(x2-x1)+(t_lat-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS tt
          FROM v_truth t JOIN v_region_edges e ON e.region_id=t.region_id) a) b) c GROUP BY region_id""",
)
def boundary_distance(t):
    centre = t.view("v_cases").select("case_id", "aoi_lat", "aoi_lon")
    k = F.col("region_id")
    df = regions(t).join(centre, "case_id")
    df = df.withColumn("t_lat", F.col("aoi_lat") + ((k * 7 % 9) - 4) * F.lit(0.04)).withColumn(
        "t_lon", F.col("aoi_lon") + ((k * 5 % 9) - 4) * F.lit(0.04)
    )
    return df.select(
        "region_id",
        geo.rnd(geo.vertex_distance_m(F.col("ring"), "t_lat", "t_lon"), 3).alias("vertex_m"),
        geo.rnd(geo.segment_distance_m(F.col("ring"), "t_lat", "t_lon"), 3).alias("segment_m"),
    )


@query(
    "circular_diff",
    f"""SELECT candidate_id, {rnd('least(abs(a-b), 360-abs(a-b))')} AS full_turn, {rnd('least(abs(o-p), 180-abs(o-p))')} AS axial FROM (
        SELECT candidate_id, orientation_deg*2 AS a, (ordinal*91 % 360)*1e0 AS b, orientation_deg AS o, (ordinal*91 % 180)*1e0 AS p FROM v_candidates) q""",
)
def circular_diff(t):
    o, k = F.col("orientation_deg"), F.col("ordinal")
    return t.view("v_candidates").select(
        "candidate_id",
        geo.rnd(geo.circular_diff(o * 2, (k * 91 % 360) * F.lit(1.0)), 6).alias("full_turn"),
        geo.rnd(geo.circular_diff(o, (k * 91 % 180) * F.lit(1.0), 180.0), 6).alias("axial"),
    )


@query(
    "normalize_lon",
    f"""SELECT o_orderkey, CASE WHEN s = -180 AND lon > 0 THEN 180e0 ELSE {rnd('s')} END AS lon FROM (
        SELECT o_orderkey, lon, (lon+180) - 360*floor((lon+180)/360) - 180 AS s FROM (SELECT o_orderkey, (o_orderkey*45 % 1100)/2e0 - 190e0 AS lon FROM orders) a) b""",
)
def normalize_lon(t):
    lon = (F.col("o_orderkey") * 45 % 1100) / 2 - 190.0
    return t.table("orders").select("o_orderkey", geo.normalize_lon(lon).alias("lon"))


@query(
    "to_utc",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(to_timestamp(1596585600 + (o_orderkey*977) % 864000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS utc
       FROM orders""",
)
def to_utc(t):
    """The same instants as naive text, epoch seconds, offset text, and junk."""
    k = F.col("o_orderkey")
    seconds = F.lit(1596585600) + (k * 977) % 864000
    ts = F.timestamp_seconds(seconds)
    plus4 = F.concat(F.date_format(ts + F.expr("INTERVAL 4 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+04:00"))
    given = (
        F.when(k % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k % 4 == 1, seconds.cast("string"))
        .when(k % 4 == 2, plus4)
        .otherwise("not a time")
    )
    return t.table("orders").select("o_orderkey", text.iso_z(text.to_utc(given)).alias("utc"))


@query(
    "scene_midpoint",
    """SELECT event_id, epoch_us(ts)//1000 + (event_id*37 % 50000)//2 AS mid_ms FROM events""",
)
def scene_midpoint(t):
    a = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    b = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id") * 37 % 50000)
    return t.table("events").select("event_id", F.unix_millis(text.midpoint(a, b)).alias("mid_ms"))


@query(
    "horizon_windows",
    """SELECT case_id, h AS horizon_hours, strftime(obs_ts - h * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS start_utc, strftime(obs_ts, '%Y-%m-%dT%H:%M:%SZ') AS end_utc
       FROM (SELECT *, unnest([24,48,72,96]) AS h FROM v_cases) q""",
)
def horizon_windows(t):
    df = t.view("v_cases").withColumn("horizon_hours", F.explode(F.array(*[F.lit(h) for h in (24, 48, 72, 96)])))
    start = F.col("obs_ts") - F.make_interval(hours=F.col("horizon_hours"))
    return df.select("case_id", "horizon_hours", text.iso_z(start).alias("start_utc"), text.iso_z("obs_ts").alias("end_utc"))


@query(
    "canonical_hash",
    """SELECT event_id, sha256('{"id":"' || CAST(event_id AS VARCHAR) || '","kind":"' || event_type || '","user":"' || CAST(user_id AS VARCHAR) || '"}') AS digest FROM events""",
)
def canonical_hash(t):
    """Hash of a document with its keys in order, whatever order they came in."""
    props = F.create_map(
        F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("id"), F.col("event_id").cast("string")
    )
    return t.table("events").select("event_id", text.content_hash(text.canonical_json(props)).alias("digest"))


@query(
    "safe_name",
    """SELECT page_id, CASE WHEN n IN ('', '.', '..') THEN NULL ELSE n END AS stored_name
       FROM (SELECT page_id, trim(regexp_extract(url || CASE page_id % 5 WHEN 1 THEN '/..' WHEN 2 THEN '/' WHEN 3 THEN '\\x.tif' ELSE '' END, '([^/\\\\]*)$', 1)) AS n FROM pages) q""",
)
def safe_name(t):
    k = F.col("page_id") % 5
    path = F.concat("url", F.when(k == 1, "/..").when(k == 2, "/").when(k == 3, "\\x.tif").otherwise(""))
    return t.table("pages").select("page_id", text.safe_name(path).alias("stored_name"))


@query(
    "path_parts",
    """SELECT doc_id, CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.tar' ELSE '' END AS stem,
       CASE doc_id % 3 WHEN 0 THEN 'gz' WHEN 1 THEN 'tif' ELSE '' END AS kind FROM documents""",
)
def path_parts(t):
    k = F.col("doc_id") % 3
    path = F.concat(F.lit("a/b/"), F.col("doc_id").cast("string"), F.when(k == 0, ".tar.gz").when(k == 1, ".TIF").otherwise(""))
    return t.table("documents").select("doc_id", text.stem(path).alias("stem"), text.extension(path).alias("kind"))


@query(
    "json_props",
    """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.name'), 'none') AS name FROM events""",
)
def json_props(t):
    return t.table("events").select(
        "event_id",
        F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1)).alias("k"),
        F.coalesce(F.get_json_object("props", "$.name"), F.lit("none")).alias("name"),
    )


@query(
    "affine_px_geo",
    f"""SELECT scene_id, y, x, {rnd('57e0+0.001e0*x')} AS lon, {rnd('-20e0-0.001e0*y')} AS lat, {rnd('((57e0+0.001e0*x)-57e0)/0.001e0',3)} AS back_x FROM v_pixels""",
)
def affine_px_geo(t):
    tr = {"a": 0.001, "c": 57.0, "e": -0.001, "f": -20.0}
    lon, lat = pixel_to_map("x", "y", tr)
    back, _ = map_to_pixel(lon, lat, tr)
    return t.view("v_pixels").select(
        "scene_id", "y", "x", geo.rnd(lon, 6).alias("lon"), geo.rnd(lat, 6).alias("lat"), geo.rnd(back, 3).alias("back_x")
    )


@query(
    "alias_detect",
    """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'u_current' WHEN 1 THEN 'v_current' WHEN 2 THEN 'u_wind' WHEN 3 THEN 'v_wind' WHEN 4 THEN 'swh'
       WHEN 5 THEN 'mwd' WHEN 6 THEN 'u_current' END AS component FROM part""",
)
def alias_detect(t):
    k = (F.col("p_partkey") % 8).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in ("UO", "v_curr", "u10", "wind_v", "Hs", "mwd", "ssu", "salinity")]), k + 1)
    std = F.when(k == 6, "surface_sea_water_x_velocity")
    return t.table("part").select("p_partkey", files.component_of(name, std).alias("component"))


# --- readers and writers -----------------------------------------------------


@query(
    "src_ais_csv",
    f"""SELECT CAST(538000000 + user_id AS BIGINT) AS mmsi, event_id, {rnd('-22e0+(event_id*7919 % 3000)/1000e0')} AS lat, {rnd('56.5e0+(event_id*104729 % 3500)/1000e0')} AS lon,
        CASE WHEN event_id % 6 = 1 THEN 10e0 ELSE {rnd('value')} END AS sog, CASE WHEN event_id % 6 = 2 THEN 0e0 ELSE ((event_id*37) % 360)*1e0 END AS cog,
        'VESSEL_' || CAST(538000000+user_id AS VARCHAR) AS vessel_name, 'Cargo' AS vessel_type FROM events WHERE event_id % 29 NOT IN (3, 7)""",
)
def src_ais_csv(t):
    """Positions written as CSV with odd headers and bad rows, then read back."""
    k = F.col("event_id")
    out = t.table("events").select(
        F.when(k % 29 == 3, "not a number").otherwise(F.concat((F.lit(538000000) + F.col("user_id")).cast("string"), F.lit(".0"))).alias(" MMSI "),
        k.cast("string").alias("BaseDateTime"),
        F.when(k % 29 == 7, "-95.5").otherwise((F.lit(-22.0) + (k * 7919 % 3000) / 1000).cast("string")).alias("LATITUDE"),
        (F.lit(56.5) + (k * 104729 % 3500) / 1000).cast("string").alias("Lon"),
        F.when(k % 6 != 1, F.col("value").cast("string")).alias("SOG"),
        F.when(k % 6 != 2, ((k * 37) % 360).cast("string")).alias("COG"),
    )
    folder = scratch_folder(t.spark, "positions")
    files.write_stage(out, folder, [f"`{c}`" for c in out.columns], "csv")
    good, _ = files.read_positions_csv(t.spark, folder)
    return good.select(
        "mmsi", F.col("timestamp_utc").cast("bigint").alias("event_id"),
        *[geo.rnd(c, 6).alias(c) for c in ("lat", "lon", "sog", "cog")], "vessel_name", "vessel_type",
    )


@query(
    "src_metocean_csv",
    f"""SELECT CAST(t_s AS BIGINT) AS t_s, {rnd('lat')} AS lat, {rnd('lon')} AS lon, {rnd('u_wind')} AS u_wind, {rnd('v_wind')} AS v_wind FROM v_grid""",
)
def src_metocean_csv(t):
    g = t.view("v_grid").select(
        text.iso_z(F.timestamp_seconds("t_s")).alias("Time"), F.when(F.col("xi") % 2 == 0, F.col("lat")).alias("lat"), F.col("lat").alias("lat_deg"),
        F.col("lon").alias("Longitude"), F.col("u_wind").alias("U10"), F.col("v_wind").alias("wind_v"),
    )
    folder = scratch_folder(t.spark, "grid")
    files.write_stage(g, folder, g.columns, "csv")
    df = files.read_metocean_csv(t.spark, folder)
    return df.select(F.unix_seconds("ts").alias("t_s"), *[geo.rnd(c, 6).alias(c) for c in ("lat", "lon", "u_wind", "v_wind")])


@query("src_manifest", "SELECT scene_id, category AS scene_category, vv_path, acquired AS acquisition_timestamp FROM v_samples")
def src_manifest(t):
    m = t.view("v_samples").select(
        "scene_id", "vv_path", F.replace("vv_path", F.lit("img"), F.lit("vh")).alias("vh_path"),
        F.replace("vv_path", F.lit("img"), F.lit("mask")).alias("mask_path"), F.upper("category").alias("scene_category"),
        F.col("acquired").alias("acquisition_timestamp"),
    )
    folder = scratch_folder(t.spark, "manifest") + "/m.jsonl"
    files.write_stage(m, folder, m.columns, "json")
    return files.read_manifest(t.spark, folder).select("scene_id", "scene_category", "vv_path", "acquisition_timestamp")


@query(
    "src_geojson_features",
    f"""SELECT candidate_id, horizon_hours, 'Polygon' AS geometry_type, {rnd('max(x)')} AS max_x, {rnd('min(y)')} AS min_y, CAST(count(*) AS INTEGER) AS points
        FROM (SELECT candidate_id, CAST(horizon_hours AS VARCHAR) AS horizon_hours, x, y FROM v_region_points) q GROUP BY candidate_id, horizon_hours""",
)
def src_geojson_features(t):
    """Regions written as features, then read back."""
    folder = scratch_folder(t.spark, "features")
    files.write_geojson(regions(t).select("candidate_id", "horizon_hours", "ring"), folder)
    df = files.read_geojson(t.spark, folder, lines=True).withColumn("_b", geo.ring_bbox(F.col("ring")))
    return df.select(
        F.col("properties")["candidate_id"].alias("candidate_id"), F.col("properties")["horizon_hours"].alias("horizon_hours"), "geometry_type",
        geo.rnd("_b.max_x", 6).alias("max_x"), geo.rnd("_b.min_y", 6).alias("min_y"), F.size("ring").alias("points"),
    )


@query(
    "sink_csv_json",
    f"""SELECT candidate_id, tier, {rnd('area_km2')} AS area_km2 FROM v_triaged""",
)
def sink_csv_json(t):
    """A stage table through CSV and JSON; rows both copies agree on."""
    from slickwatch.plans.scene import triaged

    cols = ["candidate_id", "tier", "area_km2"]
    csv, js = scratch_folder(t.spark, "csv"), scratch_folder(t.spark, "json")
    files.write_stage(triaged(t), csv, cols, "csv")
    files.write_stage(triaged(t), js, cols, "json")
    a = files.read_text_csv(t.spark, csv).withColumn("area_km2", F.col("area_km2").cast("double"))
    b = t.spark.read.schema("candidate_id string, tier string, area_km2 double").json(js)
    return a.join(b, cols, "left_semi").withColumn("area_km2", geo.rnd("area_km2", 6))


@query("sink_geojson", "SELECT candidate_id, 'Feature' AS type FROM v_regions")
def sink_geojson(t):
    """Features written as one JSON line each and read back."""
    path = scratch_folder(t.spark, "geojson")
    files.geojson_features(regions(t).select("candidate_id", "horizon_hours", "ring")).select("value").write.text(path)
    return t.spark.read.text(path).select(
        F.get_json_object("value", "$.properties.candidate_id").alias("candidate_id"), F.get_json_object("value", "$.type").alias("type")
    )


@query("src_inventory")
def src_inventory(t):
    """Data files below the table folder, by word and suffix."""
    found = pv.inventory(files.list_files(t.spark, t.folder), ("events", "lineitem", "ais"))
    return pv.inventory_summary(found)
