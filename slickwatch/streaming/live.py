"""The position operators over a stream of reports.

Flags that need one report only are the batch expressions; repeated reports are
dropped within the watermark, and tracks are sessions closed by a long silence.
State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwatch.functions.geo import rnd
from slickwatch.operators.positions import clean_positions


def first_reports(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Clean reports, each repeated one once (same vessel, time and place)."""
    clean = clean_positions(stream.withWatermark("ts", delay))
    keyed = clean.withColumn("_lat5", rnd("lat", 5)).withColumn("_lon5", rnd("lon", 5))
    return keyed.dropDuplicatesWithinWatermark(["mmsi", "ts", "_lat5", "_lon5"]).drop("_lat5", "_lon5")


def live_tracks(stream: DataFrame, silence: str = "4 hours", delay: str = "2 hours") -> DataFrame:
    """Tracks as sessions of a vessel, closed by ``silence``."""
    return (
        first_reports(stream, delay)
        .groupBy("mmsi", F.session_window("ts", silence).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.min("sog").alias("min_sog"),
            F.max("sog").alias("max_sog"),
        )
        .select("mmsi", "start_ts", "end_ts", "record_count", "min_sog", "max_sog")
    )
