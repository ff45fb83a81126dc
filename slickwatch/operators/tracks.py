"""Vessel tracks and behaviour from flagged positions.

All per-report work is cut by range of vessel and time (see ``ordered``), because
an identity shared by many transmitters can hold a large share of all reports. ``keys`` is the vessel, or the case and the vessel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwatch.functions.geo import rnd
from slickwatch.operators.ordered import carry_forward, grouped_percentiles, sorted_percentile

# Behaviour and gap limits.
LARGE_GAP_H = 2.0
SILENCE_GAP_H = 4.0
SLOW_KN, FAST_KN = 3.0, 8.0
SHARP_TURN_DEG = 45.0


def with_previous(positions: DataFrame, keys: list[str], whole: bool = False) -> DataFrame:
    """Each report with the gap to and turn from the vessel's previous one.

    ``whole``: the caller has made sure that no track is too long for one task.
    """
    payload = F.struct(F.col("ts").alias("pts"), F.col("cog").alias("pcog"))
    if whole:
        df = positions.withColumn("prev", F.lag(payload).over(Window.partitionBy(*keys).orderBy("ts", "ordinal")))
    else:
        df = carry_forward(positions, keys, ["ts", "ordinal"], payload, out="prev")
    gap = (F.unix_micros("ts") - F.unix_micros("prev.pts")) / F.lit(60e6)
    swing = F.abs(F.col("cog") - F.col("prev.pcog"))
    return (
        df.withColumn("gap_minutes", gap)
        .withColumn("turn_deg", F.when(swing > 180, F.lit(360.0) - swing).otherwise(swing))
        .withColumn("sharp_turn", F.coalesce(F.col("turn_deg") >= SHARP_TURN_DEG, F.lit(False)))
        .withColumn("is_start", F.col("prev").isNull())
        .drop("prev")
    )


def track_medians(linked: DataFrame, keys: list[str]) -> DataFrame:
    """Median gap (minutes) and median speed in one pass over both."""
    long = linked.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("gap").alias("m"), F.col("gap_minutes").alias("v")),
                F.struct(F.lit("sog").alias("m"), F.col("sog").alias("v")),
            )
        ).alias("_s"),
    ).select(*keys, F.col("_s.m").alias("m"), F.col("_s.v").alias("v"))
    per = grouped_percentiles(long, [*keys, "m"], "v", {"med": 0.5}, bin_width=1.0)
    return per.groupBy(*keys).agg(
        F.max(F.when(F.col("m") == "gap", F.col("med"))).alias("median_gap_minutes"),
        F.max(F.when(F.col("m") == "sog", F.col("med"))).alias("median_sog"),
    )


def vessel_profiles(linked: DataFrame, keys: list[str] | None = None, whole: bool = False, reports: Column | None = None) -> DataFrame:
    """One row per track: extent, reporting regularity and behaviour.

    ``linked`` comes from :func:`with_previous`. A track has exactly one start
    row, so the values of its first report are plain conditional maxima; medians
    count equal values, so no track is ordered in one task, unless ``whole`` says
    that tracks are short. ``reports``, for short tracks too, is gathered into an array.
    """
    keys = keys or ["mmsi"]
    medians = {"median_gap_minutes": "gap_minutes", "median_sog": "sog"}
    sorted_ = [F.sort_array(F.collect_list(c)).alias(m) for m, c in medians.items()] if whole else []
    if reports is not None:
        sorted_.append(F.collect_list(reports).alias("reports"))

    def at_start(c):
        return F.max(F.when(F.col("is_start"), F.col(c)))

    totals = linked.groupBy(*keys).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("record_count"),
        F.max("gap_minutes").alias("_gap"),
        F.min("sog").alias("min_sog"),
        F.avg("sog").alias("mean_sog"),
        F.max("sog").alias("max_sog"),
        F.count_if(F.col("sog") < SLOW_KN).alias("low_speed_points"),
        F.count_if("sharp_turn").alias("sharp_turns"),
        F.coalesce(at_start("vessel_name"), F.lit("UNKNOWN")).alias("vessel_name"),
        at_start("vessel_type").alias("vessel_type"),
        at_start("lat").alias("first_lat"),
        at_start("lon").alias("first_lon"),
        *sorted_,
    )
    if whole:
        df = totals.withColumns({m: sorted_percentile(F.col(m), 0.5) for m in medians})
    else:
        df = totals.join(track_medians(linked, keys), keys, "left")
    seconds = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(1e6)
    df = (
        df.withColumn("duration_hours", rnd(seconds / 3600, 2))
        .withColumn("median_gap_minutes", rnd(F.coalesce("median_gap_minutes", F.lit(0.0)), 1))
        .withColumn("max_gap_hours", rnd(F.coalesce("_gap", F.lit(0.0)) / 60, 2))
        .drop("_gap")
    )
    expected = F.when(
        F.col("median_gap_minutes") > 0,
        F.greatest(
            F.lit(1),
            F.floor(
                F.col("duration_hours") * 60 / F.greatest(F.lit(1.0), F.col("median_gap_minutes"))
            ),
        ),
    ).otherwise(F.col("record_count"))
    return (
        df.withColumn("expected_records", expected.cast("bigint"))
        .withColumn(
            "completeness",
            rnd(F.least(F.lit(1.0), F.col("record_count") / F.col("expected_records")), 3),
        )
        .withColumn("has_large_gap", F.col("max_gap_hours") > LARGE_GAP_H)
        .withColumn("min_sog", rnd("min_sog", 2))
        .withColumn("slowdown", (F.col("min_sog") < SLOW_KN) & (F.col("max_sog") > FAST_KN))
        .withColumn("gap_class", gap_class("max_gap_hours"))
    )


def gap_class(max_gap_hours: str) -> Column:
    gap = F.col(max_gap_hours)
    return (
        F.when(gap > SILENCE_GAP_H, "EXTENDED_SILENCE_INTERVAL")
        .when(gap > LARGE_GAP_H, "MODERATE_REPORTING_GAP")
        .otherwise("NORMAL_TRANSMISSION")
    )


def file_order_summary(positions: DataFrame) -> DataFrame:
    """Per vessel: first and last report in file order, and the count.

    The extreme ordinals are a map-side aggregate; the two rows they name come
    back through a join on the unique ordinal.
    """
    ends = positions.groupBy("mmsi").agg(
        F.min("ordinal").alias("_first"),
        F.max("ordinal").alias("_last"),
        F.count(F.lit(1)).alias("track_points"),
    )
    first = positions.select(
        F.col("ordinal").alias("_first"), "vessel_name", "vessel_type", F.col("ts").alias("start_ts")
    )
    last = positions.select(F.col("ordinal").alias("_last"), F.col("ts").alias("end_ts"))
    return ends.join(first, "_first").join(last, "_last").drop("_first", "_last")


def last_known_position(positions: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """As-of lookup: the latest report at or before each query time.

    ``queries`` carries ``keys``, ``ts`` and a unique ``query_id``. Both sides
    are unioned and the last report carried forward; a report at the same time
    counts as known.
    """
    marks = positions.select(
        *keys,
        "ts",
        F.lit(0).alias("_side"),
        "ordinal",
        F.lit(None).cast("bigint").alias("query_id"),
        F.struct(F.col("ts").alias("at"), "lat", "lon", "ordinal").alias("_pos"),
    )
    asks = queries.select(
        *keys,
        "ts",
        F.lit(1).alias("_side"),
        F.lit(0).cast("bigint").alias("ordinal"),
        "query_id",
    )
    both = marks.unionByName(asks, allowMissingColumns=True)
    seen = carry_forward(both, keys, ["ts", "_side", "ordinal"], F.col("_pos"), out="known", inclusive=True)
    return seen.filter(F.col("_side") == 1).select("query_id", *keys, "ts", "known")
