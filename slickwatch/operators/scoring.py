"""Component scores, guarded priority, reason codes and case states.

Scores rank leads for an analyst; they never state responsibility.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwatch.functions.geo import as_col, rnd

# Weights, limits and labels of the priority score.
WEIGHTS = {
    "spatial": 0.30,
    "temporal": 0.25,
    "route": 0.20,
    "behaviour": 0.10,
    "integrity": 0.05,
    "physics": 0.10,
}
PHYSICS_SUPPORT = 0.8
GUARD_KM = 5.0
GUARD_CAP = 0.69
HIGH, MODERATE, LOW = 0.70, 0.45, 0.25
AMBIGUOUS_DELTA = 0.05
MIN_COVERAGE = 0.30


#: What the scores need of a track.
TRACK_FACTS = ["start_ts", "end_ts", "completeness", "max_gap_hours", "slowdown", "sharp_turns", "gap_class"]


def attach_tracks(intersections: DataFrame, profiles: DataFrame | None, cases: DataFrame) -> DataFrame:
    """Look up track, behaviour and observation time of each intersection row.

    A row without a track keeps the defaults: an empty interval at the
    observation time, complete reporting, no slowdown. Without ``profiles`` the
    rows carry ``TRACK_FACTS`` already.
    """
    if profiles is not None:
        intersections = intersections.join(profiles.select("case_id", "mmsi", *TRACK_FACTS), ["case_id", "mmsi"], "left")
    return (
        intersections.join(cases.select("case_id", "obs_ts"), "case_id", "left")
        .withColumn("start_ts", F.coalesce("start_ts", "obs_ts"))
        .withColumn("end_ts", F.coalesce("end_ts", "obs_ts"))
        .withColumn("completeness", F.coalesce("completeness", F.lit(1.0)))
        .withColumn("max_gap_hours", F.coalesce("max_gap_hours", F.lit(0.0)))
        .withColumn("slowdown", F.coalesce("slowdown", F.lit(False)))
        .withColumn("sharp_turns", F.coalesce("sharp_turns", F.lit(0)).cast("bigint"))
    )


def component_scores(df: DataFrame) -> DataFrame:
    status = F.col("temporal_status")
    return (
        df.withColumn(
            "spatial_score", rnd(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("min_distance_km") / 50), 3)
        )
        .withColumn(
            "temporal_score",
            F.when(status == "TEMPORALLY_COMPATIBLE", 1.0)
            .when(status == "PARTIALLY_COMPATIBLE", 0.5)
            .otherwise(0.0),
        )
        .withColumn("route_score", F.when(F.col("intersects"), 0.9).otherwise(0.4))
        .withColumn("behaviour_score", F.when(F.col("slowdown"), 0.8).otherwise(0.5))
        .withColumn(
            "integrity_score",
            rnd(F.greatest(F.lit(0.0), F.col("completeness") - F.col("max_gap_hours") / 24), 3),
        )
    )


def priority(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted score with the hard evidence guard."""
    w = dict(weights or WEIGHTS)
    total = sum(w.values())
    raw = (
        F.col("spatial_score") * w["spatial"]
        + F.col("temporal_score") * w["temporal"]
        + F.col("route_score") * w["route"]
        + F.col("behaviour_score") * w["behaviour"]
        + F.col("integrity_score") * w["integrity"]
        + F.lit(PHYSICS_SUPPORT) * w["physics"]
    ) / total
    guard = (F.col("temporal_status") == "TEMPORALLY_COMPATIBLE") & (
        F.col("intersects") | (F.col("min_distance_km") <= GUARD_KM)
    )
    score = rnd(raw, 3)
    return (
        df.withColumn("guard_passed", guard)
        .withColumn("physics_support", F.lit(PHYSICS_SUPPORT))
        .withColumn("priority_score", F.when(guard, score).otherwise(F.least(score, F.lit(GUARD_CAP))))
    )


def vessel_state(score="priority_score", guard="guard_passed") -> Column:
    score, guard = as_col(score), as_col(guard)
    return (
        F.when((score >= HIGH) & guard, "HIGH_PRIORITY_INVESTIGATIVE_CANDIDATE")
        .when(score >= MODERATE, "MODERATE_PRIORITY_INVESTIGATIVE_CANDIDATE")
        .otherwise("LOW_PRIORITY_INVESTIGATIVE_CANDIDATE")
    )


def _evidence() -> dict[str, list[tuple[Column, str | Column]]]:
    """Reason codes, supporting, limiting and missing evidence: when each applies, and what it says."""
    near, km = F.col("intersects"), F.col("min_distance_km")
    full = F.col("temporal_status") == "TEMPORALLY_COMPATIBLE"
    part = F.col("temporal_status") == "PARTIALLY_COMPATIBLE"
    close = ~near & (km <= 15.0)
    turned = F.col("sharp_turns") > 0
    gap = F.col("max_gap_hours") > 2.0
    silent = F.col("gap_class") == "EXTENDED_SILENCE_INTERVAL"
    km1 = F.format_string("%.1f", rnd(km, 1))
    gap1 = F.format_string("%.1f", rnd("max_gap_hours", 1))
    return {
        "reason_codes": [
            (near, "SOURCE_REGION_INTERSECTION"),
            (close, "CLOSE_APPROACH"),
            (full, "STRONG_TEMPORAL_MATCH"),
            (F.col("slowdown"), "SPEED_CHANGE_PRESENT"),
            (F.col("slowdown"), "DWELL_NEAR_SOURCE_REGION"),
            (turned, "COURSE_CHANGE_PRESENT"),
            (gap, "AIS_GAP_PRESENT"),
            (silent, "AIS_COVERAGE_WEAK"),
        ],
        "supporting": [
            (near, "Positions fall on or inside the region."),
            (close, F.concat(F.lit("Closest position: "), km1, F.lit(" km off the region."))),
            (full, "Positions span the whole time window."),
            (F.col("slowdown"), "Slow running after faster passage."),
            (turned, F.concat(F.lit("Turns of 45 degrees or more: "), F.col("sharp_turns").cast("string"))),
        ],
        "limiting": [
            (~near & ~close, F.concat(F.lit("No position nearer than "), km1, F.lit(" km."))),
            (part, "Positions span part of the time window."),
            (~full & ~part, "No position in the time window."),
            (gap, F.concat(F.lit("Longest gap between positions: "), gap1, F.lit(" h."))),
        ],
        "missing": [(silent, "Positions are missing for four hours or longer.")],
    }


def reasons(df: DataFrame) -> DataFrame:
    """Reason codes with supporting, limiting and missing evidence texts."""
    present = {
        name: F.filter(F.array(*[F.when(when, says) for when, says in items]), lambda x: x.isNotNull())
        for name, items in _evidence().items()
    }
    return df.withColumns(present)


def reason_summary(df: DataFrame) -> DataFrame:
    """What :func:`reasons` tells, as the codes joined by ``|`` and the number of texts of each kind, without writing those."""
    found = _evidence()
    codes = F.concat_ws("|", *[F.when(when, says) for when, says in found.pop("reason_codes")])
    counts = {f"n_{name}": sum((F.when(when, 1).otherwise(0) for when, _ in items), F.lit(0)) for name, items in found.items()}
    return df.withColumns({"reason_codes": codes, **counts})


def top_two(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Best and runner-up score per case.

    ``row_number() <= 2`` becomes a group limit that runs before the shuffle, so
    a case holding most rows still ships two rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(
        F.col("priority_score").desc(), "mmsi", "region_id"
    )
    top = scored.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")

    def at(rank, c):
        return F.max(F.when(F.col("_r") == rank, F.col(c)))

    return (
        top.groupBy(*keys)
        .agg(
            at(1, "mmsi").alias("top_mmsi"),
            at(1, "vessel_name").alias("top_name"),
            at(1, "priority_score").alias("top_score"),
            at(1, "guard_passed").alias("top_guard"),
            at(2, "vessel_name").alias("second_name"),
            at(2, "priority_score").alias("second_score"),
        )
        .withColumn("delta", F.col("top_score") - F.col("second_score"))
    )


def case_attribution(cases: DataFrame, top: DataFrame) -> DataFrame:
    """State of every case, cases without vessels included.

    ``cases`` carries ``coverage`` (0..1), the quality of position coverage.
    """
    df = cases.join(top, "case_id", "left")
    state = (
        F.when(F.col("top_score").isNull(), "NO_CREDIBLE_CANDIDATE")
        .when(F.col("coverage") < MIN_COVERAGE, "INSUFFICIENT_DATA")
        .when(
            (F.col("top_score") >= HIGH)
            & F.col("second_score").isNotNull()
            & (F.col("delta") <= AMBIGUOUS_DELTA),
            "AMBIGUOUS_ATTRIBUTION",
        )
        .when((F.col("top_score") >= HIGH) & F.col("top_guard"), "HIGH_PRIORITY_INVESTIGATIVE_CANDIDATE")
        .when(F.col("top_score") >= MODERATE, "MODERATE_PRIORITY_INVESTIGATIVE_CANDIDATE")
        .when(F.col("top_score") >= LOW, "LOW_PRIORITY_INVESTIGATIVE_CANDIDATE")
        .otherwise("NON_VESSEL_SOURCE_POSSIBLE")
    )
    df = df.withColumn("case_state", state)
    return df.withColumn(
        "abstain",
        F.col("case_state").isin(
            "NO_CREDIBLE_CANDIDATE",
            "INSUFFICIENT_DATA",
            "AMBIGUOUS_ATTRIBUTION",
            "NON_VESSEL_SOURCE_POSSIBLE",
        ),
    ).withColumn("explanation", explanation())


def explanation() -> Column:
    """One sentence about the state, from the scores."""
    score = F.format_string("%.3f", F.col("top_score"))
    return (
        F.when(F.col("case_state") == "NO_CREDIBLE_CANDIDATE", "No vessel track lies in the search domain.")
        .when(F.col("case_state") == "INSUFFICIENT_DATA", "Position coverage is too thin for a conclusion.")
        .when(
            F.col("case_state") == "AMBIGUOUS_ATTRIBUTION",
            F.concat(
                F.lit("Leading vessels "),
                F.col("top_name"),
                F.lit(" and "),
                F.col("second_name"),
                F.lit(" score alike ("),
                score,
                F.lit(" vs "),
                F.format_string("%.3f", F.col("second_score")),
                F.lit(")."),
            ),
        )
        .otherwise(F.concat(F.lit("Leading vessel "), F.col("top_name"), F.lit(" scored "), score, F.lit(".")))
    )
