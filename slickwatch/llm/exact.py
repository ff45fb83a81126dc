"""Exact dedup by skew-safe combining, in DataFrame operations only.

1. *Locally*: the aggregate on the whole text runs inside each task before any
   shuffle, so a task sends one row for each different text it has seen.
2. *Salted*: digests with more than ``1 / SHARE`` of all rows (at most ``SHARE``
   of them at any size) are dealt over ``SALTS`` partitions each.
3. *Globally*: the salt winners of those few digests are combined.

Each stage groups by digest **and** whole text, so that two texts of one digest
never merge. Rows get their group back by digest; only for a digest that was
seen with several texts is the text compared again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwatch.llm.common import rows_named, table
from slickwatch.session import staged

#: A digest is hot beyond this share of all rows, so there are at most 4,096 hot ones.
SHARE = 4096
SALTS = 16


def winners(docs: DataFrame, share: int = SHARE, salts: int = SALTS) -> DataFrame:
    """One row for each different text: digest, text, keep_id, group_size, texts.

    ``docs`` has doc_id, text (not null) and digest; ``texts`` counts the
    different texts of the digest (1 unless the digest collides).
    """
    total = docs.count()
    hot = (
        docs.groupBy("digest").agg(F.count("*").alias("n"))
        .filter(F.col("n") * share > total)
        .select("digest", F.lit(True).alias("hot"))
    )
    dealt = docs.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(F.lit(-1))
    )
    merged = dealt.groupBy("digest", "text", "salt").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    combined = (
        merged.filter("salt >= 0").groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    cold = merged.filter("salt < 0").drop("salt")
    return cold.unionByName(combined)


def exact_groups(docs: DataFrame, share: int = SHARE, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Texts are compared as they are; null counts as empty, so null and empty
    texts form one group. The largest doc_id of a group stays; a null doc_id
    loses to any other, and a group of null ids only has keep_id null. Rows that
    repeat both doc_id and text are all marked as kept (they are one document).
    Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    groups = winners(rows, share, salts)
    one = staged(
        groups.groupBy("digest").agg(
            F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        ),
        "digests",
    )
    found = rows.select("doc_id", "digest").join(one.filter("texts = 1").drop("texts"), "digest")
    if one.filter("texts > 1").limit(1).count():
        clash = one.filter("texts > 1").select("digest")
        apart = rows.join(clash, "digest").join(groups.join(clash, "digest"), ["digest", "text"])
        found = found.unionByName(apart.drop("text").select(*found.columns))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, one for each different text.

    Decided by :func:`exact_groups`; of rows that repeat doc_id and text, one
    stays. Rows without doc_id stay if no row of their text has one.
    """
    kept = exact_groups(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return rows_named(docs, kept)


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``documents`` with the row of its text that stays."""
    return exact_groups(table(spark, folder, "documents"))


ORACLE_OP4 = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
