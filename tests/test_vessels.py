"""Positions, tracks and scores on small hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slickwatch.operators import positions as pos
from slickwatch.operators import regions as reg
from slickwatch.operators import scoring, tracks


def rows(spark, data):
    cols = "ordinal bigint, mmsi string, t string, lat double, lon double, sog double, cog double"
    return spark.createDataFrame(data, cols).select(
        "*", F.col("t").cast("timestamp").alias("ts"), F.lit("V").alias("vessel_name"), F.lit("Cargo").alias("vessel_type")
    )


def test_quality_flags(spark):
    m = "538009999"
    df = rows(
        spark,
        [
            (0, m, "2020-08-07 00:00:00", -20.4, 57.5, 10.0, 45.0),
            (1, m, "2020-08-07 00:00:00", -20.4, 57.5, 10.0, 45.0),
            (2, m, "2020-08-07 01:00:00", -95.0, 57.5, 10.0, 45.0),
            (3, "123", "2020-08-07 02:00:00", -20.4, 57.5, 10.0, 45.0),
            (4, m, "2020-08-07 03:00:00", -20.4, 57.5, 85.0, 45.0),
        ],
    )
    flagged = pos.flag_positions(df)
    got = [r.quality for r in flagged.orderBy("ordinal").collect()]
    assert got == ["VALID", "DUPLICATE_RECORD", "LAT_LON_OUT_OF_BOUNDS", "INVALID_MMSI_FORMAT", "IMPOSSIBLE_SOG"]
    assert pos.anomalies(df, flagged).count() == 4


def test_tracks_and_behaviour(spark):
    df = rows(
        spark,
        [
            (0, "1", "2020-08-07 00:00:00", -20.4, 57.5, 12.0, 45.0),
            (1, "1", "2020-08-07 01:00:00", -20.4, 57.5, 2.0, 150.0),
            (2, "1", "2020-08-07 06:00:00", -20.4, 57.5, 11.0, 45.0),
        ],
    )
    r = tracks.vessel_profiles(tracks.with_previous(df, ["mmsi"]), ["mmsi"]).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.duration_hours, r.record_count, r.max_gap_hours, r.has_large_gap) == (6.0, 3, 5.0, True)
    assert r.slowdown and r.sharp_turns == 2 and r.gap_class == "EXTENDED_SILENCE_INTERVAL"
    assert r.median_gap_minutes == 180.0 and r.median_sog == 11.0


def test_a_hot_vessel_against_one_plain_window(spark):
    """One vessel holding most reports: bucketed ordering and medians match a plain window."""
    df = spark.range(4000).select(
        F.col("id").alias("ordinal"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("mmsi"),
        F.timestamp_seconds(F.lit(1596585600) + (F.col("id") * 7919) % 90000).alias("ts"),
        F.lit(-20.0).alias("lat"),
        F.lit(57.0).alias("lon"),
        ((F.col("id") * 13 % 120) / 10).alias("sog"),
        ((F.col("id") * 37 % 360) * 1.0).alias("cog"),
        F.lit("V").alias("vessel_name"),
        F.lit("T").alias("vessel_type"),
    )
    linked = tracks.with_previous(df, ["mmsi"])
    w = Window.partitionBy("mmsi").orderBy("ts", "ordinal")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / F.lit(60e6)
    plain = df.withColumn("gap", gap)
    got = {r.ordinal: r.gap_minutes for r in linked.collect()}
    assert got == {r.ordinal: r.gap for r in plain.collect()}
    medians = plain.groupBy("mmsi").agg(F.median("gap").alias("g"), F.median("sog").alias("s")).collect()
    profiles = {r.mmsi: r for r in tracks.vessel_profiles(linked, ["mmsi"]).collect()}
    for r in medians:
        assert profiles[r.mmsi].median_gap_minutes == round(r.g, 1) and profiles[r.mmsi].median_sog == r.s


def region(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in
                     [(57.4, -20.5), (57.6, -20.5), (57.6, -20.3), (57.4, -20.3), (57.4, -20.5)]])
    return spark.range(1).select(
        F.lit(1).cast("bigint").alias("case_id"), F.lit(1).cast("bigint").alias("region_id"), F.lit("C1").alias("candidate_id"),
        F.lit(72).alias("horizon_hours"), F.lit(-20.4).alias("c_lat"), F.lit(57.5).alias("c_lon"), F.lit(True).alias("eligible"), ring.alias("ring"),
    )


@pytest.mark.parametrize("boundary", ["vertex", "segment"])
def test_region_distance(spark, boundary):
    df = rows(
        spark,
        [(0, "in", "2020-08-07 00:00:00", -20.4, 57.5, 1.0, 1.0), (1, "out", "2020-08-07 00:00:00", -21.0, 57.5, 1.0, 1.0)],
    ).withColumn("case_id", F.lit(1).cast("bigint"))
    keys = ["case_id", "mmsi"]
    prof = tracks.vessel_profiles(tracks.with_previous(df, keys), keys)
    got = {r.mmsi: r for r in reg.track_region_distance(df, region(spark), prof, boundary).collect()}
    assert got["in"].min_distance_km == 0.0 and got["in"].intersects
    assert got["out"].min_distance_km > 50 and not got["out"].intersects
    assert reg.track_region_distance(df.filter("false"), region(spark), prof).count() == 0


def test_overlap_and_guard(spark):
    def one(a, b):
        df = spark.createDataFrame([(a, b, "2020-08-10 01:38:07", 72)], "a string, b string, o string, horizon_hours int")
        df = df.select(*[F.col(x).cast("timestamp").alias(y) for x, y in (("a", "start_ts"), ("b", "end_ts"), ("o", "obs_ts"))], "horizon_hours")
        return reg.window_overlap(df).first()

    r = one("2020-08-07 10:00:00", "2020-08-09 10:00:00")
    assert r.temporal_status == "TEMPORALLY_COMPATIBLE" and r.overlap_hours > 30
    assert one("2020-08-01 00:00:00", "2020-08-02 00:00:00").temporal_status == "NOT_COMPATIBLE"

    cols = "spatial_score double, temporal_score double, route_score double, behaviour_score double, integrity_score double, temporal_status string, intersects boolean, min_distance_km double"
    df = spark.createDataFrame(
        [(0.9, 1.0, 0.8, 0.7, 0.9, "TEMPORALLY_COMPATIBLE", True, 0.0), (1.0, 1.0, 1.0, 1.0, 1.0, "NOT_COMPATIBLE", True, 0.0)], cols
    )
    a, b = scoring.priority(df).collect()
    assert a.guard_passed and 0 <= a.priority_score <= 1
    assert not b.guard_passed and b.priority_score <= 0.69


def test_case_states(spark):
    top = spark.createDataFrame(
        [
            (1, "A", "A", 0.85, True, "B", 0.83, 0.02),
            (2, "A", "A", 0.85, True, "B", 0.2, 0.65),
            (3, "A", "A", 0.15, False, None, None, None),
        ],
        "case_id int, top_mmsi string, top_name string, top_score double, top_guard boolean, second_name string, second_score double, delta double",
    )
    cases = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.9), (4, 0.9)], "case_id int, coverage double")
    got = {r.case_id: (r.case_state, r.abstain) for r in scoring.case_attribution(cases, top).collect()}
    assert got == {
        1: ("AMBIGUOUS_ATTRIBUTION", True),
        2: ("INSUFFICIENT_DATA", True),
        3: ("NON_VESSEL_SOURCE_POSSIBLE", True),
        4: ("NO_CREDIBLE_CANDIDATE", True),
    }
