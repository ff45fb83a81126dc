"""Dark-spot candidates: context, triage, scores, ranks and hypotheses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slickwatch.functions.geo import as_col, rnd
from slickwatch.operators.ordered import distributed_rank

# Triage thresholds; callers may override any of them.
TRIAGE = {
    "coastal_buffer_m": 500.0,
    "nearshore_m": 2000.0,
    "land_overlap": 0.10,
    "buffer_overlap": 0.10,
    "primary_min_area_km2": 0.05,
    "primary_max_area_km2": 150.0,
    "primary_min_contrast_db": 3.0,
    "primary_min_elongation": 1.2,
    "secondary_min_distance_m": 200.0,
    "secondary_min_area_km2": 0.01,
    "secondary_min_contrast_db": 1.5,
}
# Number of hypotheses taken into reconstruction.
MIN_HYPOTHESES, MAX_HYPOTHESES = 5, 10
# Band in which a classifier score decides nothing.
INCONCLUSIVE = (0.45, 0.55)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def context_labels(wind, current, angle) -> Column:
    """Wind, current and alignment labels joined with ``|``."""
    wind, current, angle = map(as_col, (wind, current, angle))
    return F.concat_ws(
        "|",
        F.when(wind < 4.0, "WEAK_WIND").when(wind > 10.0, "STRONG_WIND").otherwise("MODERATE_WIND"),
        F.when(current < 0.15, "WEAK_CURRENT")
        .when(current > 0.40, "STRONG_CURRENT")
        .otherwise("MODERATE_CURRENT"),
        F.when(angle <= 45.0, "WIND_CURRENT_ALIGNED")
        .when(angle >= 135.0, "WIND_CURRENT_OPPOSING")
        .otherwise("WIND_CURRENT_CROSSING"),
    )


def location(df: DataFrame, config: Mapping[str, float] | None = None) -> DataFrame:
    c = {**TRIAGE, **(config or {})}
    distance = F.col("distance_to_land_m")
    return df.withColumn(
        "location_category",
        F.when(F.col("land_overlap") > c["land_overlap"], "on_land")
        .when(
            (distance <= c["coastal_buffer_m"]) | (F.col("buffer_overlap") > c["buffer_overlap"]),
            "coastal_buffer",
        )
        .otherwise("offshore"),
    ).withColumn("nearshore_context", distance <= c["nearshore_m"])


def triage(df: DataFrame, config: Mapping[str, float] | None = None) -> DataFrame:
    """Tier and reason; the first matching rule wins."""
    c = {**TRIAGE, **(config or {})}
    distance, land = F.col("distance_to_land_m"), F.col("land_overlap")
    area, contrast = F.col("area_km2"), F.col("contrast_db")
    primary = (
        (distance >= c["coastal_buffer_m"])
        & (land == 0.0)
        & area.between(c["primary_min_area_km2"], c["primary_max_area_km2"])
        & (contrast >= c["primary_min_contrast_db"])
        & (F.col("elongation") >= c["primary_min_elongation"])
    )
    secondary = (
        (land < c["land_overlap"])
        & (distance > c["secondary_min_distance_m"])
        & (area >= c["secondary_min_area_km2"])
        & (contrast >= c["secondary_min_contrast_db"])
    )
    rules = [
        (land > c["land_overlap"], "BACKGROUND", "land_overlap"),
        (F.col("edge_touching"), "BACKGROUND", "edge_touching"),
        (F.col("touches_invalid"), "BACKGROUND", "invalid_data_overlap"),
        (primary, "PRIMARY_REVIEW", "offshore_strong_contrast_coherent"),
        (secondary, "SECONDARY_REVIEW", "moderate_contrast_or_nearshore"),
    ]
    tier = reason = None
    for test, t, r in rules:
        tier = F.when(test, t) if tier is None else tier.when(test, t)
        reason = F.when(test, r) if reason is None else reason.when(test, r)
    return df.withColumn("tier", tier.otherwise("BACKGROUND")).withColumn(
        "tier_reason", reason.otherwise("low_contrast_or_speckle")
    )


def revised_score(orig="orig_score", category="location_category") -> Column:
    penalty = (
        F.when(as_col(category) == "on_land", -100.0)
        .when(as_col(category) == "coastal_buffer", -40.0)
        .otherwise(0.0)
    )
    return clamp(as_col(orig) + penalty, 0, 100)


def candidate_score(df: DataFrame) -> DataFrame:
    """Heuristic score with its breakdown kept beside it."""
    area = F.col("area_km2")
    parts = {
        "contrast_score": clamp(F.col("contrast_db") * 8.0, 0, 30),
        "elongation_score": clamp((F.col("elongation") - 1.0) * 5.0, 0, 25),
        "area_score": F.when(area.between(0.05, 50.0), F.least(area * 2.0, F.lit(20.0))).otherwise(5.0),
        "coherence_score": F.least(F.col("solidity") * 15.0, F.lit(15.0)),
        "edge_penalty": F.when(F.col("edge_touching"), -30.0).otherwise(0.0),
        "size_penalty": F.when((area > 200.0) | (F.col("pixel_count") < 40), -30.0).otherwise(0.0),
        "compactness_penalty": F.when(F.col("compactness") > 0.8, -15.0).otherwise(0.0),
    }
    df = df.withColumn("breakdown", F.struct(*[v.alias(k) for k, v in parts.items()]))
    total = F.lit(0.0)
    for name in parts:
        total = total + F.col(f"breakdown.{name}")
    return df.withColumn("candidate_score", clamp(total, 0, 100))


def evidence_priority(df: DataFrame, sar="orig_score", ml="oil_like_score") -> DataFrame:
    value = (
        F.col(sar) * 0.40
        + F.col(ml) * 35.0
        + F.least(F.col("contrast_db") * 2.5, F.lit(15.0))
        + F.least((F.col("elongation") - 1.0) * 3.0, F.lit(10.0))
        + F.when(F.col("nearshore_context"), 5.0).otherwise(0.0)
    )
    return df.withColumn("evidence_priority", clamp(value, 0, 100))


def score_band(score) -> Column:
    score = as_col(score)
    return (
        F.when(score.between(*INCONCLUSIVE), "ML_INCONCLUSIVE")
        .when(score > 0.5, "OIL_LIKE")
        .otherwise("NON_OIL_LIKE")
    )


def training_lock(df: DataFrame) -> DataFrame:
    """Fail the job when a real-case row could leak into training.

    The check is part of the plan: each task asserts its own rows.
    """
    ok = (F.col("label_status") == "UNLABELLED_REAL_CASE") & ~F.col("training_allowed")
    return df.withColumn(
        "_locked", F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("real-case rows must stay unlabelled"))
    ).filter(F.col("_locked").isNull()).drop("_locked")


def rank_in_scene(df: DataFrame, score="candidate_score", scene="scene_id") -> DataFrame:
    """Rank by score, ties in input order, and the id C001, C002, ...

    Bucketing by the score at two decimals and by ordinal range keeps any one
    scene from being sorted in a single task.
    """
    ranked = distributed_rank(
        df.withColumn("_s", rnd(score, 2)),
        [scene],
        [F.col("_s"), F.floor(F.col("ordinal") / 1000000)],
        ["desc", "asc"],
        [F.col("ordinal")],
    )
    return ranked.drop("_s").withColumn(
        "ranked_id", F.concat(F.lit("C"), _padded("rank", 3))
    )


def _padded(number: str, width: int) -> Column:
    """Zero-padded to ``width``, longer numbers in full."""
    text = F.col(number).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def best_per_group(df: DataFrame, keys: list[str], score="evidence_priority") -> DataFrame:
    """Best row of each group; the filter on the row number becomes a group
    limit applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "ordinal")
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def select_hypotheses(
    df: DataFrame,
    scene="scene_id",
    group="group_id",
    score="evidence_priority",
    low: int = MIN_HYPOTHESES,
    high: int = MAX_HYPOTHESES,
) -> DataFrame:
    """Up to ``high`` hypotheses per scene: the best of each group first, and
    only when those are fewer than ``low`` the best of the rest.

    Every window here is limited before its shuffle, so a scene of any size
    sends a bounded number of rows to the final ranking.
    """
    by_score = [F.col(score).desc(), F.col("ordinal")]
    first = best_per_group(df, [scene, group], score).withColumn("_pass", F.lit(1))
    leaders = (
        first.withColumn("_r", F.row_number().over(Window.partitionBy(scene).orderBy(*by_score)))
        .filter(F.col("_r") <= high)
        .drop("_r")
    )
    pool = (
        df.withColumn("_r", F.row_number().over(Window.partitionBy(scene).orderBy(*by_score)))
        .filter(F.col("_r") <= high + low)
        .drop("_r")
        .join(leaders.select(scene, "ordinal"), [scene, "ordinal"], "left_anti")
        .withColumn("_pass", F.lit(2))
    )
    both = leaders.unionByName(pool)
    n_first = F.count_if(F.col("_pass") == 1).over(Window.partitionBy(scene))
    place = Window.partitionBy(scene).orderBy("_pass", *by_score)
    chosen = (
        both.withColumn("_n", n_first)
        .filter((F.col("_pass") == 1) | (F.col("_n") < low))
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= high)
        .drop("_n")
    )
    return chosen.withColumn(
        "hypothesis_id",
        F.concat(F.lit("HYP_"), _padded("place", 2), F.lit("_"), F.col("candidate_id")),
    ).withColumnRenamed("_pass", "selection_pass")


def group_features(df: DataFrame, group="group_id") -> DataFrame:
    """Shape and context of each assigned group."""
    return (
        df.filter(F.col(group) != "GRP_UNASSIGNED")
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("candidate_count"),
            F.sum("area_km2").alias("total_area_km2"),
            F.stddev_pop("orientation_deg").alias("orientation_std_deg"),
            F.avg("contrast_db").alias("mean_contrast_db"),
            F.avg(F.col("nearshore_context").cast("double")).alias("nearshore_fraction"),
        )
    )


def group_members(df: DataFrame, group="group_id", block: int = 10000) -> DataFrame:
    """Member lists in blocks of at most ``block`` ids.

    A group may hold any number of candidates, so its list is written as
    numbered blocks rather than as one unbounded array.
    """
    assigned = df.filter(F.col(group) != "GRP_UNASSIGNED").withColumn(
        "block", F.floor(F.col("ordinal") / block)
    )
    return assigned.groupBy(group, "block").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "candidate_id"))).alias("_m")
    ).select(group, "block", F.transform("_m", lambda m: m["candidate_id"]).alias("members"))


def area_pixel_consistency(df: DataFrame, pixel_area_km2) -> DataFrame:
    """Relative difference of pixel-derived and reported area."""
    area = F.col("area_km2")
    derived = F.col("pixel_count") * as_col(pixel_area_km2)
    return df.withColumn("pixel_area_km2", derived).withColumn(
        "relative_discrepancy", F.abs(area - derived) / F.greatest(area, F.lit(1e-6))
    )


def triage_statistics(df: DataFrame, scene="scene_id") -> DataFrame:
    """Counts by location and tier per scene, and contamination of the first
    twenty primary candidates by the coastal buffer."""
    totals = df.groupBy(scene).agg(
        F.count(F.lit(1)).alias("candidates"),
        *[
            F.count_if(F.col("location_category") == c).alias(f"n_{c}")
            for c in ("on_land", "coastal_buffer", "offshore")
        ],
        *[
            F.count_if(F.col("tier") == c).alias(f"n_{c.lower()}")
            for c in ("PRIMARY_REVIEW", "SECONDARY_REVIEW", "BACKGROUND")
        ],
        F.sum(F.when(F.col("tier") == "PRIMARY_REVIEW", F.col("pixel_count")).otherwise(0))
        .cast("bigint")
        .alias("primary_pixel_sum"),
        F.max(F.when(F.col("tier") == "PRIMARY_REVIEW", F.col("relative_discrepancy"))).alias(
            "max_discrepancy"
        ),
    )
    w = Window.partitionBy(scene).orderBy(F.col("revised_score").desc(), "ordinal")
    first = (
        df.filter("tier = 'PRIMARY_REVIEW'")
        .withColumn("_r", F.row_number().over(w))
        .filter("_r <= 20")
        .groupBy(scene)
        .agg(F.avg((F.col("location_category") == "coastal_buffer").cast("double")).alias("_coastal"))
    )
    return (
        totals.join(first, scene, "left")
        .withColumn("coastal_contaminated", F.coalesce(F.col("_coastal") > 0.5, F.lit(False)))
        .withColumn("area_consistent", F.coalesce(F.col("max_discrepancy") < 1.0, F.lit(True)))
        .withColumn(
            "status",
            F.when(
                (F.col("n_primary_review") == 0) & (F.col("n_secondary_review") == 0), "INSUFFICIENT_DATA"
            ).otherwise("PASS"),
        )
        .drop("_coastal")
    )
