"""Leader groups of fragments of the same slick.

In order of score, an unassigned candidate becomes a leader and claims every
later unassigned candidate close to it in place, heading and contrast. The
leaders are the lexicographically first independent set, and every candidate
belongs to its best-ranked adjacent leader.

Candidates are bucketed so finely that two in one bucket are always
neighbours. A bucket then has at most one leader, and only bucket champions
and leaders are compared with other rows: no bucket, however full, is paired
with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slickwatch.functions import geo
from slickwatch.operators.ordered import distributed_rank
from slickwatch.operators.spatial import with_box_cells
from slickwatch.session import cut_lineage

# How close two fragments of a group are.
MAX_DISTANCE_M, MAX_HEADING_DEG, MAX_CONTRAST_DB = 2000.0, 35.0, 4.0
COARSE_M = 4000.0


def prepared(candidates: DataFrame) -> DataFrame:
    """Projected ring, box and bucket of each candidate."""
    df = candidates.withColumn("_ea", geo.equal_area_ring(F.col("ring")))
    df = df.withColumn("_box", geo.ring_bbox(F.col("_ea"))).drop("ring")
    side = MAX_DISTANCE_M / 2**0.5
    anchor = F.col("_ea")[0]
    return (
        df.withColumn("_ix", F.floor(anchor["x"] / side))
        .withColumn("_iy", F.floor(anchor["y"] / side))
        .withColumn("_ih", F.floor(F.pmod("orientation_deg", F.lit(180.0)) / MAX_HEADING_DEG))
        .withColumn("_ic", F.floor(F.col("contrast_db") / MAX_CONTRAST_DB))
    )


def heading_gap(a, b) -> Column:
    """Difference of two undirected headings as the grouping rule has it."""
    gap = F.abs(geo.as_col(a) - geo.as_col(b))
    return F.when(gap > 90.0, F.lit(180.0) - gap).otherwise(gap)


def close_pairs(leaders: DataFrame, others: DataFrame) -> DataFrame:
    """(leader, other) pairs near each other in place, heading and contrast.

    Both sides come from :func:`prepared`. Leaders are sparse (one a bucket at
    most), so the pairs grow with the rows, not with their square.
    """
    cols = ["candidate_id", "ordinal", "_ea", "_box", "orientation_deg", "contrast_db", "score"]
    left = leaders.select("scene_id", *[F.col(c).alias(f"l_{c}") for c in cols])
    d = MAX_DISTANCE_M
    left = with_box_cells(
        left,
        F.col("l__box.min_x") - d,
        F.col("l__box.min_y") - d,
        F.col("l__box.max_x") + d,
        F.col("l__box.max_y") + d,
        COARSE_M,
    )
    right = with_box_cells(
        others.select("scene_id", *cols), "_box.min_x", "_box.min_y", "_box.max_x", "_box.max_y", COARSE_M
    )
    boxes = (
        (F.col("_box.min_x") <= F.col("l__box.max_x") + d)
        & (F.col("_box.max_x") >= F.col("l__box.min_x") - d)
        & (F.col("_box.min_y") <= F.col("l__box.max_y") + d)
        & (F.col("_box.max_y") >= F.col("l__box.min_y") - d)
    )
    cheap = (
        (F.col("ordinal") != F.col("l_ordinal"))
        & (heading_gap("orientation_deg", "l_orientation_deg") <= MAX_HEADING_DEG)
        & (F.abs(F.col("contrast_db") - F.col("l_contrast_db")) <= MAX_CONTRAST_DB)
        & boxes
    )
    # A pair may share several coarse cells; keep the one holding the corner of
    # the overlap of the two boxes, so no distinct is needed.
    own_x = F.floor(F.greatest(F.col("_box.min_x"), F.col("l__box.min_x") - d) / COARSE_M)
    own_y = F.floor(F.greatest(F.col("_box.min_y"), F.col("l__box.min_y") - d) / COARSE_M)
    pairs = left.join(right, ["scene_id", "_cx", "_cy"]).filter(
        cheap & (F.col("_cx") == own_x) & (F.col("_cy") == own_y)
    )
    return pairs.filter(geo.ring_distance(F.col("_ea"), F.col("l__ea")) <= d)


def _rank_key(prefix: str = "") -> Column:
    """Order of claiming: higher score first, then input order."""
    return F.struct((-F.col(f"{prefix}score")).alias("s"), F.col(f"{prefix}ordinal").alias("o"))


BUCKET = ["scene_id", "_ix", "_iy", "_ih", "_ic"]


def _new_leaders(open_: DataFrame) -> DataFrame:
    """Bucket champions that no better champion can be adjacent to."""
    span = [
        F.min("_box.min_x").alias("x0"),
        F.max("_box.max_x").alias("x1"),
        F.min("_box.min_y").alias("y0"),
        F.max("_box.max_y").alias("y1"),
        F.min("contrast_db").alias("c0"),
        F.max("contrast_db").alias("c1"),
    ]
    champs = open_.groupBy(*BUCKET).agg(F.min(_rank_key()).alias("k"), *span)
    d = MAX_DISTANCE_M
    mine = with_box_cells(
        champs, F.col("x0") - d, F.col("y0") - d, F.col("x1") + d, F.col("y1") + d, COARSE_M
    )
    names = {c: f"o_{c}" for c in ("k", "x0", "x1", "y0", "y1", "c0", "c1")}
    other = with_box_cells(champs, "x0", "y0", "x1", "y1", COARSE_M).withColumnsRenamed(names).select(
        "scene_id", "_cx", "_cy", *names.values()
    )
    better = (
        mine.join(other, ["scene_id", "_cx", "_cy"])
        .filter(
            (F.col("o_k") < F.col("k"))
            & (F.col("o_x0") <= F.col("x1") + d)
            & (F.col("o_x1") >= F.col("x0") - d)
            & (F.col("o_y0") <= F.col("y1") + d)
            & (F.col("o_y1") >= F.col("y0") - d)
            & (F.col("o_c0") <= F.col("c1") + MAX_CONTRAST_DB)
            & (F.col("o_c1") >= F.col("c0") - MAX_CONTRAST_DB)
        )
        .select("scene_id", F.col("k.o").alias("ordinal"))
        .distinct()
    )
    free = champs.select("scene_id", F.col("k.o").alias("ordinal")).join(
        better, ["scene_id", "ordinal"], "left_anti"
    )
    return open_.join(free, ["scene_id", "ordinal"], "left_semi")


def leader_groups(candidates: DataFrame) -> DataFrame:
    """Group id of each review candidate; others are GRP_UNASSIGNED.

    ``candidates``: scene_id, candidate_id, ordinal, ring, orientation_deg,
    contrast_db, score, in_review. Rounds run until nothing is open; each is
    checkpointed, and the best open candidate of a scene always decides, so the
    loop ends. Only counts reach the driver.
    """
    review = cut_lineage(prepared(candidates.filter("in_review")))
    open_, leaders = review, None
    while open_.limit(1).count():
        fresh = cut_lineage(_new_leaders(open_))
        leaders = fresh if leaders is None else leaders.unionByName(fresh)
        claimed = close_pairs(fresh, open_).select("scene_id", "ordinal").unionByName(
            fresh.select("scene_id", "ordinal")
        ).distinct()
        open_ = cut_lineage(open_.join(claimed, ["scene_id", "ordinal"], "left_anti"))
    if leaders is None:
        return candidates.select(
            "scene_id", "candidate_id", F.lit("GRP_UNASSIGNED").alias("assigned_group"), F.lit(None).cast("string").alias("leader_id")
        )
    claims = close_pairs(leaders, review.join(leaders, ["scene_id", "ordinal"], "left_anti"))
    best = claims.groupBy("scene_id", "candidate_id").agg(
        F.min(F.struct(_rank_key("l_").alias("k"), F.col("l_candidate_id").alias("id"))).alias("_b")
    ).select("scene_id", "candidate_id", F.col("_b.id").alias("leader_id"))
    own = leaders.select("scene_id", "candidate_id", F.col("candidate_id").alias("leader_id"))
    numbered = distributed_rank(
        leaders.select("scene_id", F.col("candidate_id").alias("leader_id"), "score", "ordinal"),
        ["scene_id"],
        [geo.rnd("score", 2)],
        ["desc"],
        [F.col("score").desc(), F.col("ordinal")],
        out="_n",
    )
    text = F.col("_n").cast("string")
    named = numbered.select(
        "scene_id",
        "leader_id",
        F.concat(F.lit("GRP"), F.when(F.length(text) >= 3, text).otherwise(F.lpad(text, 3, "0"))).alias("assigned_group"),
    )
    member = best.unionByName(own).join(named, ["scene_id", "leader_id"])
    return candidates.select("scene_id", "candidate_id").join(
        member, ["scene_id", "candidate_id"], "left"
    ).withColumn("assigned_group", F.coalesce("assigned_group", F.lit("GRP_UNASSIGNED")))
