"""Readers and writers of the record types.

Everything is read as text columns first and cast with ``try_cast``, so bad
rows never fail a task; whether they are dropped or reported is the reader's
choice, stated in its result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwatch.functions.text import extension, to_utc

# Header aliases and defaults of the position and grid files.
POSITION_ALIASES = {
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "ts": ("basedatetime", "datetime", "timestamp"),
}
DEFAULT_TIME = "2020-08-10T01:38:00Z"
DEFAULT_SOG, DEFAULT_COG, DEFAULT_TYPE = 10.0, 0.0, "Cargo"
GRID_ALIASES = {
    "lat": ("lat", "latitude", "lat_deg"),
    "lon": ("lon", "longitude", "lon_deg"),
    "ts": ("time", "timestamp", "datetime", "time_utc"),
}
COMPONENT_ALIASES = {
    "u_current": ("u_current", "uo", "ucurrent", "u_curr"),
    "v_current": ("v_current", "vo", "vcurrent", "v_curr"),
    "u_wind": ("u_wind", "u10", "u10m", "wind_u"),
    "v_wind": ("v_wind", "v10", "v10m", "wind_v"),
    "swh": ("swh", "hs", "significant_wave_height"),
    "mwd": ("mwd", "dir", "mean_wave_direction"),
}
STANDARD_NAMES = {
    "u_current": "sea_water_x_velocity",
    "v_current": "sea_water_y_velocity",
    "u_wind": "eastward_wind",
    "v_wind": "northward_wind",
    "swh": "significant_height_of_wind_and_swell_waves",
    "mwd": "mean_wave_direction",
}
CATEGORIES = ("oil", "lookalike", "no_oil")


class SourceError(ValueError):
    """A file does not meet its contract."""


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column as text and trimmed lower-case names."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _first_of(df: DataFrame, names) -> str | None:
    return next((n for n in names if n in df.columns), None)


def read_positions_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vessel positions and the rejected rows, from a CSV with varying headers."""
    raw = read_text_csv(spark, path)
    cols = {k: _first_of(raw, names) for k, names in POSITION_ALIASES.items()}
    if "mmsi" not in raw.columns or not cols["lat"] or not cols["lon"]:
        raise SourceError("position file needs mmsi, latitude and longitude columns")

    def text(name, default):
        return F.col(name) if name in raw.columns else F.lit(default)

    def number(name, default):
        """Empty takes the default; text that is no number rejects the row."""
        if name not in raw.columns:
            return F.lit(default), F.lit(True)
        empty = F.coalesce(F.trim(name), F.lit("")) == ""
        value = F.col(name).try_cast("double")
        return F.when(empty, default).otherwise(value), empty | value.isNotNull()

    sog, sog_ok = number("sog", DEFAULT_SOG)
    cog, cog_ok = number("cog", DEFAULT_COG)
    mmsi = F.col("mmsi").try_cast("double").try_cast("bigint")
    df = raw.select(
        mmsi.alias("mmsi"),
        (F.col(cols["ts"]) if cols["ts"] else F.lit(DEFAULT_TIME)).alias("timestamp_utc"),
        F.col(cols["lat"]).try_cast("double").alias("lat"),
        F.col(cols["lon"]).try_cast("double").alias("lon"),
        sog.alias("sog"),
        cog.alias("cog"),
        (F.col("vesselname") if "vesselname" in raw.columns else F.concat(F.lit("VESSEL_"), mmsi.cast("string"))).alias("vessel_name"),
        text("vesseltype", DEFAULT_TYPE).alias("vessel_type"),
        (sog_ok & cog_ok).alias("_numbers"),
    )
    good = (
        F.col("mmsi").isNotNull()
        & F.col("lat").between(-90, 90)
        & F.col("lon").between(-180, 180)
        & F.col("_numbers")
    )
    good = F.coalesce(good, F.lit(False))
    valid = df.filter(good).drop("_numbers")
    if not valid.limit(1).count():
        raise SourceError("no valid position rows")
    return valid, df.filter(~good).drop("_numbers")


def detect_components(columns: list[str]) -> dict[str, str]:
    """Canonical component per column name."""
    return {
        component: next(c for c in columns if c.lower() in names)
        for component, names in COMPONENT_ALIASES.items()
        if any(c.lower() in names for c in columns)
    }


def component_of(name: Column, standard: Column) -> Column:
    """Canonical component of a variable from its name or standard name."""
    low, std = F.lower(name), F.lower(F.coalesce(standard, F.lit("")))
    out = None
    for component, names in COMPONENT_ALIASES.items():
        hit = low.isin(*names) | std.contains(STANDARD_NAMES[component])
        out = F.when(hit, component) if out is None else out.when(hit, component)
    return out


def read_metocean_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gridded rows: first readable alias per row, components by name."""
    raw = read_text_csv(spark, path)
    picked = {}
    for key, names in GRID_ALIASES.items():
        found = [to_utc(n) if key == "ts" else F.col(n).try_cast("double") for n in names if n in raw.columns]
        picked[key] = F.coalesce(*found) if found else F.lit(None)
    comps = detect_components(raw.columns)
    return raw.select(
        *[v.alias(k) for k, v in picked.items()],
        *[F.col(c).try_cast("double").alias(k) for k, c in comps.items()],
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scene manifest from CSV, JSON array or JSON lines, checked."""
    kind = re.search(r"\.([^./]+)/?$", path)
    kind = kind.group(1).lower() if kind else ""
    if kind == "csv":
        df = read_text_csv(spark, path)
    elif kind == "json":
        df = spark.read.option("multiLine", True).json(path)
    elif kind in ("jsonl", "ndjson"):
        df = spark.read.json(path)
    else:
        raise SourceError(f"unsupported manifest type: {path}")
    need = ["scene_id", "vv_path", "vh_path", "mask_path", "scene_category"]
    lacking = [c for c in need if c not in df.columns]
    if lacking:
        raise SourceError(f"manifest lacks {', '.join(lacking)}")
    if "acquisition_timestamp" not in df.columns:
        df = df.withColumn("acquisition_timestamp", F.lit(None).cast("string"))
    df = df.select(
        *[F.trim(F.col(c).cast("string")).alias(c) for c in need[:4]],
        F.lower(F.trim("scene_category")).alias("scene_category"),
        F.nullif(F.trim(F.col("acquisition_timestamp").cast("string")), F.lit("")).alias("acquisition_timestamp"),
    )
    blank = F.lit(False)
    for c in need:
        blank = blank | (F.coalesce(c, F.lit("")) == "")
    checks = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(blank).alias("blank"),
        F.count_if(~F.col("scene_category").isin(*CATEGORIES)).alias("odd"),
    ).first()
    repeated = df.groupBy("scene_id").count().filter("count > 1").limit(1).count()
    if checks.n == 0:
        raise SourceError("manifest holds no samples")
    if checks.blank or checks.odd or repeated:
        raise SourceError("manifest has missing fields, unknown categories or repeated scenes")
    return df


# Coordinates nest as deep as their type says, so they are parsed once it is known.
GEOJSON_FEATURE = "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"
POLYGON = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Polygon and MultiPolygon features as (properties, geometry_type, part, ring, holes).

    Each part of a MultiPolygon is a row, numbered from 0, with its outer ring
    and its holes; a feature of another type has one row without part or ring.
    ``lines=True`` reads one feature a line, which splits over tasks; a single
    FeatureCollection document is read whole by the one task that owns it.
    """
    if lines:
        features = spark.read.schema(GEOJSON_FEATURE).json(path)
    else:
        doc = spark.read.option("multiLine", True).schema(f"features array<struct<{_struct_ddl(GEOJSON_FEATURE)}>>").json(path)
        features = doc.select(F.explode("features").alias("f")).select("f.*")

    def ring(r):
        return F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    parts = F.when(kind == "MultiPolygon", F.from_json(text, f"array<{POLYGON}>")).when(
        kind == "Polygon", F.array(F.from_json(text, POLYGON))
    )
    each = features.select("properties", kind.alias("geometry_type"), F.posexplode_outer(parts).alias("part", "_rings"))
    rings = F.transform("_rings", ring)
    return each.select(
        "properties",
        "geometry_type",
        "part",
        F.get(rings, 0).alias("ring"),
        F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))).alias("holes"),
    )


def _struct_ddl(ddl: str) -> str:
    """``a t, b t`` to ``a:t, b:t`` at the top level."""
    return re.sub(r"(^|, )(\w+) (?=string|map|struct)", r"\1\2:", ddl)


def geojson_features(df: DataFrame, ring: str = "ring", holes: str | None = None) -> DataFrame:
    """One Feature document a row: the ring, and its holes, as geometry, the rest as properties."""

    def line(r):
        return F.transform(r, lambda p: F.array(p["x"], p["y"]))

    coords = F.array(line(F.col(ring)))
    if holes is not None:
        coords = F.concat(coords, F.transform(F.coalesce(F.col(holes), F.array().cast(df.schema[holes].dataType)), line))
    props = [c for c in df.columns if c not in (ring, holes)]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*props).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"),
    )
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, ring: str = "ring") -> None:
    geojson_features(df, ring).write.mode("overwrite").text(path)


def write_stage(df: DataFrame, path: str, columns: list[str], kind: str = "parquet") -> None:
    """A stage table in a fixed column order; parquet unless asked otherwise."""
    out = df.select(*columns).write.mode("overwrite")
    if kind == "csv":
        out.option("header", True).csv(path)
    elif kind == "json":
        out.json(path)
    elif kind == "parquet":
        out.parquet(path)
    else:
        raise SourceError(f"unsupported stage type: {kind}")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes under a folder; file contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", extension("path").alias("kind"))
    )
