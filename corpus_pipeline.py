"""A training corpus from ``documents``: each stage takes what its predecessor kept.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which the caller writes as Parquet and rereads as the
next one's ``docs``. All but the last return the columns of ``docs``. Models are
learnt from the tables of ``sf_dir``; decisions fall on ``docs`` alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slickwatch.llm import exact, language, packing, quality, simhash
from slickwatch.session import prepare, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above poor is one half or more stay."""
    return quality.selected(docs, quality.model_of(spark, sf_dir))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit the learnt languages stay, if their main language wrote half of the words or more."""
    return language.selected(docs, language.model_of(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each different text stays."""
    return exact.deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id."""
    return simhash.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens in the mixture of the sources, one row for each piece."""
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("packing", pack),
]

#: The classifiers and the packing are models and token ids, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is a written table."""
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
