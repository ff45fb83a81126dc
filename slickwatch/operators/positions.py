"""Vessel position quality: flags, rejects, retrieval window, first copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slickwatch.functions.geo import as_col, rnd
from slickwatch.functions.text import join_codes

# Plausible ranges of a report and the retrieval area and window.
SOG_RANGE = (0.0, 60.0)
COG_RANGE = (0.0, 360.0)
AOI_LAT = (-22.0, -19.0)
AOI_LON = (56.5, 60.0)
HOURS_BEFORE, HOURS_AFTER = 120, 10


def parse_coordinates(df: DataFrame, lat="lat_text", lon="lon_text") -> DataFrame:
    """Text coordinates to doubles; unreadable ones become null."""
    return df.withColumn("lat", F.col(lat).try_cast("double")).withColumn(
        "lon", F.col(lon).try_cast("double")
    )


def first_copies(df: DataFrame, key: list[Column], ordinal: str = "ordinal") -> DataFrame:
    """Mark the first row of each key as ``is_first``.

    The least ordinal per key is a map-side aggregate, so a key repeated a
    billion times ships one row per task; the mark comes back on the ordinal,
    which is unique, so no join key is hot.
    """
    names = [f"_k{i}" for i in range(len(key))]
    firsts = (
        df.select(*[k.alias(n) for k, n in zip(key, names)], ordinal)
        .groupBy(*names)
        .agg(F.min(ordinal).alias(ordinal))
        .select(ordinal, F.lit(True).alias("is_first"))
    )
    return df.join(firsts, ordinal, "left").withColumn(
        "is_first", F.coalesce("is_first", F.lit(False))
    )


def copy_key() -> list[Column]:
    """Identity of a report: vessel, time, position at five decimals."""
    return [F.trim("mmsi"), F.col("ts"), rnd("lat", 5), rnd("lon", 5)]


def clean_positions(df: DataFrame) -> DataFrame:
    """Readable reports with trimmed identity, defaults and courses in 0..360.

    Nothing is shuffled; the course as reported stays in ``cog_reported``.
    """
    df = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    df = df.withColumn("mmsi", F.trim("mmsi"))
    for c in ("sog", "cog", "heading"):
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return df.withColumn("cog_reported", F.col("cog")).withColumn(
        "cog",
        F.when(F.col("cog").between(*COG_RANGE), F.col("cog")).otherwise(F.pmod("cog", F.lit(360.0))),
    )


def flag_positions(df: DataFrame) -> DataFrame:
    """Quality flags of each readable report; flagged rows stay in."""
    df = first_copies(clean_positions(df), copy_key())
    in_box = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    flags = join_codes(
        ";",
        F.when(~in_box, "LAT_LON_OUT_OF_BOUNDS"),
        F.when(~F.col("mmsi").rlike("^[0-9]{9}$"), "INVALID_MMSI_FORMAT"),
        F.when(~F.col("sog").between(*SOG_RANGE), "IMPOSSIBLE_SOG"),
        F.when(~F.col("cog_reported").between(*COG_RANGE), "COG_NORMALIZED"),
        F.when(~F.col("is_first"), "DUPLICATE_RECORD"),
    )
    return df.withColumn("quality", F.when(flags == "", "VALID").otherwise(flags)).drop(
        "is_first", "cog_reported"
    )


def anomalies(parsed: DataFrame, flagged: DataFrame) -> DataFrame:
    """Flagged reports plus the reports whose coordinates cannot be read."""
    bad = parsed.filter(F.col("lat").isNull() | F.col("lon").isNull()).select(
        "ordinal", "mmsi", "ts", F.lit("LAT_LON_PARSING_ERROR").alias("flags")
    )
    odd = flagged.filter(F.col("quality") != "VALID").select(
        "ordinal", "mmsi", "ts", F.col("quality").alias("flags")
    )
    return odd.unionByName(bad)


def within_aoi(obs_ts, lat="lat", lon="lon", ts="ts") -> Column:
    """Report inside the default area and the window around ``obs_ts``."""
    obs = as_col(obs_ts)
    return (
        F.col(lat).between(*AOI_LAT)
        & F.col(lon).between(*AOI_LON)
        & F.col(ts).between(
            obs - F.expr(f"INTERVAL {HOURS_BEFORE} HOURS"), obs + F.expr(f"INTERVAL {HOURS_AFTER} HOURS")
        )
    )


def chronological(df: DataFrame) -> DataFrame:
    """Total order by parsed time; Spark range-partitions, nothing is gathered."""
    return df.orderBy("ts", "ordinal")
