"""Queries on dark-spot candidates: ladders, scores, ranks, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators import candidates as cand
from slickwatch.plans.registry import Tables, query, rnd
from slickwatch.plans.views import ORACLE_VIEWS


def located(t: Tables) -> DataFrame:
    return cand.location(t.view("v_candidates"))


def prioritised(t: Tables) -> DataFrame:
    return cand.evidence_priority(located(t))


def triaged(t: Tables) -> DataFrame:
    df = cand.triage(located(t)).withColumn("revised_score", cand.revised_score())
    return cand.area_pixel_consistency(df, 0.01)


ORACLE_VIEWS["v_located"] = """
    SELECT *, CASE WHEN land_overlap > 0.10e0 THEN 'on_land'
                   WHEN distance_to_land_m <= 500 OR buffer_overlap > 0.10e0 THEN 'coastal_buffer'
                   ELSE 'offshore' END AS location_category,
           distance_to_land_m <= 2000 AS nearshore_context
    FROM v_candidates
"""
ORACLE_VIEWS["v_prioritised"] = """
    SELECT *, greatest(0e0, least(100e0, orig_score*0.40e0 + oil_like_score*35e0 + least(contrast_db*2.5e0, 15e0)
              + least((elongation-1e0)*3e0, 10e0) + CASE WHEN nearshore_context THEN 5e0 ELSE 0e0 END)) AS evidence_priority
    FROM v_located
"""
TIER_RULES = """
    CASE WHEN land_overlap > 0.10e0 THEN '{}' WHEN edge_touching THEN '{}' WHEN touches_invalid THEN '{}'
         WHEN distance_to_land_m >= 500 AND land_overlap = 0 AND area_km2 BETWEEN 0.05e0 AND 150e0
              AND contrast_db >= 3 AND elongation >= 1.2e0 THEN '{}'
         WHEN land_overlap < 0.10e0 AND distance_to_land_m > 200 AND area_km2 >= 0.01e0 AND contrast_db >= 1.5e0 THEN '{}'
         ELSE '{}' END
"""
TIER = TIER_RULES.format("BACKGROUND", "BACKGROUND", "BACKGROUND", "PRIMARY_REVIEW", "SECONDARY_REVIEW", "BACKGROUND")
TIER_REASON = TIER_RULES.format(
    "land_overlap", "edge_touching", "invalid_data_overlap", "offshore_strong_contrast_coherent",
    "moderate_contrast_or_nearshore", "low_contrast_or_speckle",
)
ORACLE_VIEWS["v_triaged"] = f"""
    SELECT *, {TIER} AS tier, {TIER_REASON} AS tier_reason,
           greatest(0e0, least(100e0, orig_score + CASE location_category WHEN 'on_land' THEN -100e0
                    WHEN 'coastal_buffer' THEN -40e0 ELSE 0e0 END)) AS revised_score,
           abs(area_km2 - pixel_count*0.01e0)/greatest(area_km2, 1e-6) AS relative_discrepancy
    FROM v_located
"""
ORACLE_VIEWS["v_cand_score"] = """
    SELECT *, greatest(0e0, least(100e0, s1+s2+s3+s4+s5+s6+s7)) AS candidate_score
    FROM (SELECT *, greatest(0e0, least(30e0, contrast_db*8e0)) AS s1,
             greatest(0e0, least(25e0, (elongation-1e0)*5e0)) AS s2,
             CASE WHEN area_km2 BETWEEN 0.05e0 AND 50e0 THEN least(area_km2*2e0, 20e0) ELSE 5e0 END AS s3,
             least(solidity*15e0, 15e0) AS s4,
             CASE WHEN edge_touching THEN -30e0 ELSE 0e0 END AS s5,
             CASE WHEN area_km2 > 200 OR pixel_count < 40 THEN -30e0 ELSE 0e0 END AS s6,
             CASE WHEN compactness > 0.8e0 THEN -15e0 ELSE 0e0 END AS s7 FROM v_candidates) q
"""


@query("location_category", "SELECT candidate_id, location_category, nearshore_context FROM v_located")
def location_category(t):
    return located(t).select("candidate_id", "location_category", "nearshore_context")


@query("triage_tier", "SELECT candidate_id, tier, tier_reason FROM v_triaged")
def triage_tier(t):
    return triaged(t).select("candidate_id", "tier", "tier_reason")


@query("triage_score", f"SELECT candidate_id, {rnd('revised_score')} AS revised_score FROM v_triaged")
def triage_score(t):
    return triaged(t).select("candidate_id", geo.rnd("revised_score", 6).alias("revised_score"))


@query(
    "candidate_score",
    f"""SELECT candidate_id, {rnd('s1')} AS contrast_score, {rnd('s2')} AS elongation_score, {rnd('s3')} AS area_score,
        {rnd('s4')} AS coherence_score, s5 AS edge_penalty, s6 AS size_penalty, s7 AS compactness_penalty,
        {rnd('candidate_score')} AS candidate_score FROM v_cand_score""",
)
def candidate_score(t):
    df = cand.candidate_score(t.view("v_candidates"))
    return df.select(
        "candidate_id",
        *[
            geo.rnd(f"breakdown.{c}", 6).alias(c)
            for c in ("contrast_score", "elongation_score", "area_score", "coherence_score")
        ],
        *[F.col(f"breakdown.{c}").alias(c) for c in ("edge_penalty", "size_penalty", "compactness_penalty")],
        geo.rnd("candidate_score", 6).alias("candidate_score"),
    )


@query("evidence_priority", f"SELECT candidate_id, {rnd('evidence_priority')} AS evidence_priority FROM v_prioritised")
def evidence_priority(t):
    return prioritised(t).select("candidate_id", geo.rnd("evidence_priority", 6).alias("evidence_priority"))


@query(
    "score_band",
    """SELECT candidate_id, CASE WHEN oil_like_score BETWEEN 0.45e0 AND 0.55e0 THEN 'ML_INCONCLUSIVE'
       WHEN oil_like_score > 0.5e0 THEN 'OIL_LIKE' ELSE 'NON_OIL_LIKE' END AS predicted_class FROM v_candidates""",
)
def score_band(t):
    return t.view("v_candidates").select("candidate_id", cand.score_band("oil_like_score").alias("predicted_class"))


ORACLE_VIEWS["v_flags"] = """
    SELECT candidate_id, CASE WHEN land_overlap >= 0e0 AND oil_like_score >= 0e0 THEN 'UNLABELLED_REAL_CASE' ELSE 'LABELLED' END AS label_status,
           orig_score < 0e0 OR area_km2 <= 0e0 AS training_allowed FROM v_candidates
"""


@query("training_lock", "SELECT * FROM v_flags WHERE label_status = 'UNLABELLED_REAL_CASE' AND NOT training_allowed")
def training_lock(t):
    """Flags drawn from each row's scores; one row that breaks the lock fails the job."""
    unlabelled = (F.col("land_overlap") >= 0) & (F.col("oil_like_score") >= 0)
    df = t.view("v_candidates").select(
        "candidate_id",
        F.when(unlabelled, "UNLABELLED_REAL_CASE").otherwise("LABELLED").alias("label_status"),
        ((F.col("orig_score") < 0) | (F.col("area_km2") <= 0)).alias("training_allowed"),
    )
    return cand.training_lock(df)


@query(
    "rank_candidates",
    f"""SELECT scene_id, candidate_id, {rnd('candidate_score', 2)} AS candidate_score, rank,
        'C' || CASE WHEN rank < 1000 THEN lpad(CAST(rank AS VARCHAR), 3, '0') ELSE CAST(rank AS VARCHAR) END AS ranked_id
        FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY {rnd('candidate_score', 2)} DESC, ordinal) AS rank
              FROM v_cand_score) q""",
)
def rank_candidates(t):
    df = cand.rank_in_scene(cand.candidate_score(t.view("v_candidates")))
    return df.select(
        "scene_id", "candidate_id", geo.rnd("candidate_score", 2).alias("candidate_score"), "rank", "ranked_id"
    )


@query(
    "top_per_group",
    f"""SELECT scene_id, group_id, candidate_id, {rnd('evidence_priority')} AS evidence_priority
        FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, group_id ORDER BY evidence_priority DESC, ordinal) AS r
              FROM v_prioritised) q WHERE r = 1""",
)
def top_per_group(t):
    best = cand.best_per_group(prioritised(t), ["scene_id", "group_id"])
    return best.select("scene_id", "group_id", "candidate_id", geo.rnd("evidence_priority", 6).alias("evidence_priority"))


@query(
    "select_hypotheses",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, group_id ORDER BY evidence_priority DESC, ordinal) AS g
                  FROM v_prioritised),
        f AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY evidence_priority DESC, ordinal) AS fr FROM b WHERE g = 1),
        p AS (SELECT b.*, CASE WHEN f.fr <= 10 THEN 1 ELSE 2 END AS ps FROM b LEFT JOIN f
              ON f.scene_id=b.scene_id AND f.ordinal=b.ordinal),
        n AS (SELECT scene_id, count(*) FILTER (ps=1) AS n1 FROM p GROUP BY scene_id),
        z AS (SELECT p.*, row_number() OVER (PARTITION BY p.scene_id ORDER BY ps, evidence_priority DESC, ordinal) AS place
              FROM p JOIN n ON n.scene_id=p.scene_id WHERE ps=1 OR n1 < 5)
       SELECT scene_id, 'HYP_' || lpad(CAST(place AS VARCHAR), 2, '0') || '_' || candidate_id AS hypothesis_id, candidate_id,
              group_id, ps AS selection_pass FROM z WHERE place <= 10""",
)
def select_hypotheses(t):
    return cand.select_hypotheses(prioritised(t)).select(
        "scene_id", "hypothesis_id", "candidate_id", "group_id", "selection_pass"
    )


@query(
    "topn_review",
    f"""SELECT tier, candidate_id, {rnd('revised_score')} AS revised_score, r FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY tier ORDER BY revised_score DESC, ordinal) AS INTEGER) AS r FROM v_triaged) q
        WHERE r <= 25""",
)
def topn_review(t):
    """Best 25 of each tier by revised score."""
    from pyspark.sql import Window

    w = Window.partitionBy("tier").orderBy(F.col("revised_score").desc(), "ordinal")
    top = triaged(t).withColumn("r", F.row_number().over(w)).filter("r <= 25")
    return top.select("tier", "candidate_id", geo.rnd("revised_score", 6).alias("revised_score"), "r")


@query(
    "group_features",
    f"""SELECT group_id, count(*) AS candidate_count, {rnd('sum(area_km2)')} AS total_area_km2,
        {rnd('stddev_pop(orientation_deg)')} AS orientation_std_deg, {rnd('avg(contrast_db)')} AS mean_contrast_db,
        {rnd('avg(CASE WHEN nearshore_context THEN 1e0 ELSE 0e0 END)')} AS nearshore_fraction
        FROM v_located WHERE group_id <> 'GRP_UNASSIGNED' GROUP BY group_id""",
)
def group_features(t):
    df = cand.group_features(located(t))
    return df.select(
        "group_id",
        "candidate_count",
        *[
            geo.rnd(c, 6).alias(c)
            for c in ("total_area_km2", "orientation_std_deg", "mean_contrast_db", "nearshore_fraction")
        ],
    )


@query(
    "group_members",
    """SELECT group_id, CAST(floor(ordinal/10000e0) AS BIGINT) AS block, string_agg(candidate_id, ',' ORDER BY ordinal) AS members
       FROM v_located WHERE group_id <> 'GRP_UNASSIGNED' GROUP BY ALL""",
)
def group_members(t):
    return cand.group_members(located(t)).withColumn("members", F.concat_ws(",", "members"))


@query(
    "area_pixel_consistency",
    f"""SELECT candidate_id, {rnd('pixel_count*0.01e0')} AS pixel_area_km2, {rnd('relative_discrepancy')} AS relative_discrepancy
        FROM v_triaged""",
)
def area_pixel_consistency(t):
    return triaged(t).select(
        "candidate_id",
        geo.rnd("pixel_area_km2", 6).alias("pixel_area_km2"),
        geo.rnd("relative_discrepancy", 6).alias("relative_discrepancy"),
    )


@query(
    "triage_statistics",
    f"""SELECT s.*, coalesce(c.f > 0.5, false) AS coastal_contaminated, coalesce(s.max_discrepancy < 1, true) AS area_consistent,
        CASE WHEN n_primary_review=0 AND n_secondary_review=0 THEN 'INSUFFICIENT_DATA' ELSE 'PASS' END AS status FROM (
        SELECT scene_id, count(*) AS candidates, count(*) FILTER (location_category='on_land') AS n_on_land,
          count(*) FILTER (location_category='coastal_buffer') AS n_coastal_buffer,
          count(*) FILTER (location_category='offshore') AS n_offshore,
          count(*) FILTER (tier='PRIMARY_REVIEW') AS n_primary_review,
          count(*) FILTER (tier='SECONDARY_REVIEW') AS n_secondary_review,
          count(*) FILTER (tier='BACKGROUND') AS n_background,
          CAST(coalesce(sum(pixel_count) FILTER (tier='PRIMARY_REVIEW'), 0) AS BIGINT) AS primary_pixel_sum,
          {rnd("max(relative_discrepancy) FILTER (tier='PRIMARY_REVIEW')")} AS max_discrepancy
        FROM v_triaged GROUP BY scene_id) s LEFT JOIN (
        SELECT scene_id, avg(CASE WHEN location_category='coastal_buffer' THEN 1e0 ELSE 0e0 END) AS f FROM (
          SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY revised_score DESC, ordinal) AS r FROM v_triaged
          WHERE tier='PRIMARY_REVIEW') q WHERE r <= 20 GROUP BY scene_id) c ON c.scene_id=s.scene_id""",
)
def triage_statistics(t):
    return cand.triage_statistics(triaged(t)).withColumn("max_discrepancy", geo.rnd("max_discrepancy", 6))


@query(
    "candidate_geometry_lookup",
    f"""SELECT h.hyp, h.candidate_id, {rnd('coalesce(c.c_lat, h.fallback_lat)')} AS lat, {rnd('coalesce(c.c_lon, 57e0)')} AS lon,
        c.candidate_id IS NOT NULL AS has_geometry
        FROM (SELECT l_orderkey*10+l_linenumber AS hyp, 'C' || CAST(l_partkey + CASE WHEN l_linenumber=1 THEN 10000000 ELSE 0 END AS VARCHAR) AS candidate_id,
              -20e0 - (l_orderkey % 7)/10e0 AS fallback_lat FROM lineitem) h LEFT JOIN v_candidates c ON c.candidate_id=h.candidate_id""",
)
def candidate_geometry_lookup(t):
    """Ranked rows to their geometry by id, with coalesced centroid sources."""
    ranked = t.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hyp"),
        F.concat(
            F.lit("C"),
            (F.col("l_partkey") + F.when(F.col("l_linenumber") == 1, 10000000).otherwise(0)).cast("string"),
        ).alias("candidate_id"),
        (F.lit(-20.0) - (F.col("l_orderkey") % 7) / 10).alias("fallback_lat"),
    )
    shapes = t.view("v_candidates").select("candidate_id", "c_lat", "c_lon", F.lit(True).alias("found"))
    return ranked.join(shapes, "candidate_id", "left").select(
        "hyp",
        "candidate_id",
        geo.rnd(F.coalesce("c_lat", "fallback_lat"), 6).alias("lat"),
        geo.rnd(F.coalesce("c_lon", F.lit(57.0)), 6).alias("lon"),
        F.coalesce("found", F.lit(False)).alias("has_geometry"),
    )


@query(
    "shape_descriptors",
    f"""SELECT candidate_id, {rnd('CASE WHEN perim=0 THEN 1e0 ELSE 4*3.141592653589793*pixel_count/(perim*perim) END')} AS compactness,
        {rnd('major/greatest(minor,1e-6)')} AS elongation, {rnd('2*sqrt(pixel_count/3.141592653589793)')} AS equivalent_diameter,
        {rnd('pixel_count/greatest(hull,1e0)')} AS solidity FROM (SELECT candidate_id, pixel_count*1e0 AS pixel_count,
        (ordinal % 40)*3e0 AS perim, 10e0+ordinal % 90 AS major, (ordinal % 13)*1e0 AS minor, pixel_count*1.2e0 AS hull FROM v_candidates) q""",
)
def shape_descriptors(t):
    from slickwatch.functions.shape import descriptors

    df = t.view("v_candidates").select(
        "candidate_id",
        (F.col("pixel_count") * F.lit(1.0)).alias("a"),
        ((F.col("ordinal") % 40) * F.lit(3.0)).alias("p"),
        (F.lit(10.0) + F.col("ordinal") % 90).alias("major"),
        ((F.col("ordinal") % 13) * F.lit(1.0)).alias("minor"),
        (F.col("pixel_count") * F.lit(1.2)).alias("hull"),
    )
    d = descriptors("a", "p", "major", "minor", "hull")
    return df.select("candidate_id", *[geo.rnd(v, 6).alias(k) for k, v in d.items()])
