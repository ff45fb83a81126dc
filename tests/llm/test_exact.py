"""Exact dedup: the whole table against the oracle, planted collisions, odd rows."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from slickwatch.llm import exact

SCHEMA = "doc_id long, text string, keep_id string"


def by_hand(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (3, None, "z"), (4, "", "z"), (None, "b", None), (5, "A", None), (6, "é" * 50000, None), (None, "a", None)]
    got = exact.exact_groups(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)
    left = exact.deduplicated(spark.createDataFrame(rows, SCHEMA))
    assert left.columns == ["doc_id", "text", "keep_id"]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        [(2, "a"), (4, ""), (None, "b"), (5, "A"), (6, "é" * 50000)], key=repr
    )


def test_salting_changes_nothing(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 40}", None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, exact.exact_groups(docs, share=4, salts=5).collect()), key=repr)
    assert got == by_hand(rows)


def test_texts_of_one_digest_stay_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").withColumn("digest", F.lit("d"))
    got = {(r.text, r.keep_id, r.group_size) for r in exact.winners(docs, share=1).collect()}
    assert got == {("a", 3, 2), ("b", 2, 1)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.exact_groups(empty).collect() == []
    assert exact.deduplicated(empty).collect() == []


def test_query_matches_oracle(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact.ORACLE_OP4})").fetchall()
    got = exact.op4_exact_dedup(spark, folder).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
