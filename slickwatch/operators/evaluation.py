"""Segmentation and classifier metrics, dataset audits, splits and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slickwatch.functions.text import event_id
from slickwatch.operators.ordered import distributed_rank

# Smoothing term and default limits of the metrics.
EPS = 1e-6
OIL_FRACTION_LIMIT = 0.01
SPLITS = ("train", "val", "test")


def _confusion(pred: Column, truth: Column) -> list[Column]:
    return [
        F.count_if(pred & truth).alias("tp"),
        F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"),
        F.count_if(~pred & ~truth).alias("tn"),
    ]


def overlap_metrics(df: DataFrame) -> DataFrame:
    """Dice, IoU, precision and recall from pixel counts."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return (
        df.withColumn("dice", (2 * tp + EPS) / (2 * tp + fp + fn + EPS))
        .withColumn("iou", (tp + EPS) / (tp + fp + fn + EPS))
        .withColumn("precision", (tp + EPS) / (tp + fp + EPS))
        .withColumn("recall", (tp + EPS) / (tp + fn + EPS))
    )


def confusion(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    pred = F.col("p") >= threshold
    counts = df.groupBy(*(by or [])).agg(*_confusion(pred, F.col("truth")))
    return overlap_metrics(counts)


def category_report(df: DataFrame, threshold: float, limit: float = OIL_FRACTION_LIMIT) -> DataFrame:
    """Metrics overall and for oil, false-positive rates for the rest.

    Scene-level counts come first, so the category level aggregates one row per
    scene; grouping sets give the overall row in the same pass.
    """
    pred = F.col("p") >= threshold
    scenes = df.groupBy("category", "scene_id").agg(
        *_confusion(pred, F.col("truth")), F.avg(pred.cast("double")).alias("share")
    )
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")]
    rolled = scenes.rollup("category").agg(
        *sums,
        F.count(F.lit(1)).alias("sample_count"),
        F.avg((F.col("share") > 0).cast("double")).alias("fp_scene_rate"),
        F.avg("share").alias("mean_fraction"),
        F.max("share").alias("max_fraction"),
        (F.avg((F.col("share") > limit).cast("double")) * 100).alias("pct_above_limit"),
        F.grouping("category").alias("_all"),
    )
    rolled = overlap_metrics(rolled)
    overall = F.col("_all") == 1
    metric = overall | (F.col("category") == "oil")
    out = [F.when(overall, "ALL").otherwise(F.col("category")).alias("category"), "sample_count"]
    out += [F.when(metric, F.col(c)).alias(c) for c in ("dice", "iou", "precision", "recall")]
    out += [
        F.when(~metric, F.col(c)).alias(c)
        for c in ("fp_scene_rate", "mean_fraction", "max_fraction", "pct_above_limit")
    ]
    return rolled.select(*out)


def classifier_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and false-positive rate; null, never a stored
    number, when nothing was predicted positive."""
    counts = df.groupBy(*(by or [])).agg(*_confusion(F.col("pred"), F.col("truth")))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    some = (tp + fp) > 0
    df = (
        counts.withColumn("precision", F.when(some, tp / (tp + fp + EPS)))
        .withColumn("recall", F.when(some, tp / (tp + fn + EPS)))
        .withColumn("false_positive_rate", F.when(some, fp / (fp + tn + EPS)))
    )
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", 2 * p * r / (p + r + EPS))


def pair_by_stem(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images and masks by stem: paired, image only, or mask only."""
    j = images.withColumn("_i", F.lit(True)).join(masks.withColumn("_m", F.lit(True)), "stem", "full_outer")
    state = (
        F.when(F.col("_i").isNull(), "MASK_ONLY").when(F.col("_m").isNull(), "IMAGE_ONLY").otherwise("PAIRED")
    )
    return j.withColumn("pairing", state).drop("_i", "_m")


def dataset_audit(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts over paired, unmatched, mismatched and empty samples."""
    paired = F.col("pairing") == "PAIRED"
    empty = paired & (F.col("positive_pixels") == 0)
    df = pairs.groupBy(*(by or [])).agg(
        F.count_if(F.col("pairing") != "MASK_ONLY").alias("image_count"),
        F.count_if(F.col("pairing") != "IMAGE_ONLY").alias("mask_count"),
        F.count_if(paired).alias("paired_samples"),
        F.count_if(F.col("pairing") == "IMAGE_ONLY").alias("unmatched_images"),
        F.count_if(F.col("pairing") == "MASK_ONLY").alias("unmatched_masks"),
        F.count_if(paired & (F.col("image_pixels") != F.col("mask_pixels"))).alias("shape_mismatches"),
        F.count_if(empty).alias("empty_masks"),
        F.coalesce(F.sum(F.when(paired, F.col("positive_pixels"))), F.lit(0)).cast("bigint").alias("oil_pixels"),
        F.coalesce(F.sum(F.when(paired, F.col("mask_pixels"))), F.lit(0)).cast("bigint").alias("total_pixels"),
    )
    return df.withColumn(
        "empty_masks_pct", F.coalesce(F.try_divide("empty_masks", "paired_samples"), F.lit(0.0)) * 100
    ).withColumn("oil_pixel_pct", F.coalesce(F.try_divide("oil_pixels", "total_pixels"), F.lit(0.0)) * 100)


def split_keys(samples: DataFrame) -> DataFrame:
    """Scene and event identity of each sample, long, once per split."""
    return (
        samples.select(
            "split",
            F.explode(
                F.array(
                    F.struct(F.lit("scene").alias("kind"), F.col("scene_id").alias("key")),
                    F.struct(F.lit("event").alias("kind"), event_id("acquired", "scene_id").alias("key")),
                )
            ).alias("_k"),
        )
        .select("split", "_k.kind", "_k.key")
        .distinct()
    )


def split_leakage(samples: DataFrame) -> DataFrame:
    """Keys seen in more than one split, per pair of splits.

    A key belongs to at most three splits, so one group-by over the distinct
    keys finds every overlap without joining splits to each other.
    """
    seen = split_keys(samples).groupBy("kind", "key").agg(F.collect_set("split").alias("in"))
    pairs = [
        F.when(F.array_contains("in", a) & F.array_contains("in", b), f"{a}_{b}")
        for i, a in enumerate(SPLITS)
        for b in SPLITS[i + 1 :]
    ]
    return seen.withColumn("pair", F.explode(F.array_compact(F.array(*pairs)))).select("kind", "pair", "key")


def leakage_summary(samples: DataFrame) -> DataFrame:
    return split_leakage(samples).groupBy("kind", "pair").agg(F.count(F.lit(1)).alias("leaked"))


def seeded_split(samples: DataFrame, key: str, seed: str, val_fraction: float = 0.2) -> DataFrame:
    """Shuffle by a hash of key and seed, cut once; both sides get at least one.

    The order is by hash, bucketed by its first four digits, so the exact global
    rank needs no single-task sort.
    """
    h = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)), 256)
    hashed = samples.withColumn("_h", h)
    ranked = distributed_rank(
        hashed, [], [F.substring("_h", 1, 4)], ["asc"], [F.col("_h"), F.col(key)], total="_n"
    )
    n_val = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * val_fraction)))
    return ranked.withColumn(
        "split", F.when(F.col("rank") <= F.col("_n") - n_val, "train").otherwise("val")
    ).drop("_h", "_n")
