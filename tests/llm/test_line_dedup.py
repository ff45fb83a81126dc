"""Line dedup: brute force with hot lines and odd rows, the whole table against the oracle."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from slickwatch.llm import line_dedup

SCHEMA = "doc_id long, text string, lines string, pos int, _t1 string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def by_hand(rows, min_chars=10, min_docs=2):
    """(doc_id, n_lines, n_dropped, kept) of each row; the document without id is the last of all."""
    held = defaultdict(set)
    order = lambda i: (i is None, i or 0)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := key(x)) >= min_chars and len(held[k]) >= min_docs and doc_id != min(held[k], key=order))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def odd_rows():
    rng = random.Random(8)
    shared = [f"This line number {i} is shared by several" for i in range(30)]
    rows = [(i, "\n".join(rng.choice([f"own line of document {i} {j}", rng.choice(shared), "THE HOT LINE of all", "short", "  "]) for j in range(rng.randrange(1, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "the hot line of ALL\r\n\tthe hot line of all \x0b"), (None, "the hot line of all\nnone has this one"), (None, "none has this one\nnor this one here")]
    rows += [(204, "own twice, own twice\nown twice, own twice"), (205, "ÄÖÜ ÄÖÜ ÄÖ"), (206, "äöü äöü äö"), (207, "ÄÖÜ ÄÖÜ ÄÖ"), (208, "ÄÖÜÄÖÜÄÖÜ"), (209, "ÄÖÜÄÖÜÄÖÜ")]
    rows += [(210, " padded with another space"), (211, "padded with another space"), (212, "123456789"), (213, "123456789"), (214, "1234567890"), (215, "1234567890 ")]
    rows += [(216, "repeated row, repeated row\nx"), (216, "repeated row, repeated row\nx"), (217, "another text of one id\nshared by both rows"), (217, "shared by both rows")]
    rows += [(218, "\n".join(f"line {i} of a very long text" for i in range(70_000))), (219, "line 69999 of a very long text\nz" + "y" * 300_000)]
    rng.shuffle(rows)
    return [(*r, "kept as it is", 7, None) for r in rows]


@pytest.mark.parametrize("share", [1, 50, 4096])
def test_brute_force_and_odd_rows(spark, share):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = line_dedup.deduplicated(df, share=share)
    assert out.columns == ["doc_id", "text", "lines", "pos", "_t1", "lines_"]
    found = out.filter("lines = 'kept as it is' AND pos = 7").select("doc_id", "lines_.n_lines", "lines_.n_dropped", "lines_.kept").collect()
    assert order(map(tuple, found)) == order(by_hand(rows))


def test_other_limits(spark):
    rows = odd_rows()
    found = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA), min_chars=3, min_docs=5).select("doc_id", "lines_.n_lines", "lines_.n_dropped", "lines_.kept")
    assert order(map(tuple, found.collect())) == order(by_hand(rows, 3, 5))


def test_empty(spark):
    out = line_dedup.deduplicated(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[-1] == "lines_"
    assert line_dedup.deduplicated(spark.createDataFrame([(1, None)], "doc_id long, text string")).select("lines.*").collect() == [("", 1, 0)]


def test_hot_line_is_not_shuffled_by_its_hash(spark):
    rows = [(i, "the line that stands in every text\nown " + str(i) * 12) for i in range(300)]
    goes = line_dedup.dropped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert goes.count() == 299 and goes.filter(F.size("drops") == 1).count() == 299
    plan = goes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_query_against_oracle(spark):
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(line_dedup.ORACLE_OP12).fetchall()
    found = sorted(map(tuple, line_dedup.op12_line_dedup(spark, folder).collect()))
    assert found == sorted(want)
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert found == sorted((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in by_hand(rows))
