"""Cross-entropy difference against dictionaries of counts."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from slickwatch.llm import cross_entropy as ce
from slickwatch.llm.common import flat

SCHEMA = "doc_id long, text string, lm_ string, chunk int, _good int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, good):
    """[(n, loss_target, loss_background)] of each row, with plain dictionaries."""
    texts = [(i, words_of(t)) for i, t in docs]
    vocabulary = len({w for _, t in texts for w in t})
    tables = []
    for pick in (lambda i: i in good, lambda i: True):
        one = Counter(w for i, t in texts if pick(i) for w in t)
        two = Counter(p for i, t in texts if pick(i) for p in zip(t, t[1:]))
        tables.append((one, two, sum(one.values())))

    def loss(k, before, w):
        one, two, total = tables[k]
        p = (one[w] + ce.STRENGTH / vocabulary) / (total + ce.STRENGTH)
        return -math.log(p if before is None else (two[before, w] + ce.STRENGTH * p) / (one[before] + ce.STRENGTH))

    out = []
    for _, t in texts:
        out.append((len(t), *(sum(loss(k, b, w) for b, w in zip([None, *t], t)) / max(1, len(t)) for k in (0, 1))))
    return out


def same(got, want):
    """``got``: rows sorted like the documents."""
    assert len(got) == len(want)
    for r, (n, a, b) in zip(got, want):
        assert r.n_tokens == n
        assert abs(r.loss_target - a) < 1e-9 and abs(r.loss_background - b) < 1e-9
        assert abs(r.score - (r.loss_target - r.loss_background)) < 1e-12


@pytest.mark.parametrize("chunk_bytes", [40, 1000, 1 << 25])
def test_small_corpus(spark, chunk_bytes):
    rows = [(1, "Good text, good words."), (2, "BAD!!! *** | |"), (3, None), (4, ""), (5, "é日本 " * 50), (6, "good again " * 9), (7, "x" * 3000), (8, " \x0b\n"), (9, "Привет мир\x0bпривет"), (9, "Привет мир\x0bпривет"), (None, "good words")]
    docs = spark.createDataFrame([(*r, "x", 3, None) for r in rows], SCHEMA).repartition(3)
    target = spark.createDataFrame([(1,), (6,), (6,), (99,), (None,)], "doc_id long")
    got = ce.scored(docs, target, chunk_bytes=chunk_bytes)
    assert got.columns == [*docs.columns, "lm"] and got.filter("lm_ = 'x' AND chunk = 3 AND _good IS NULL").count() == len(rows)
    order = lambda r: (r[0] is None, r[0] or 0)
    found = sorted(got.select("doc_id", "lm.*").collect(), key=order)
    same(found, brute(sorted(rows, key=order), {1, 6}))
    assert min(found, key=lambda r: r.score).doc_id in (1, 6)


def test_very_long_text_and_steps(spark):
    rng = np.random.default_rng(1)
    text = " ".join(f"w{k}" for k in rng.integers(0, 500, 300_000))
    rows = [(1, text), (2, "w1 w2 w3 " * 100), (3, "w1 w2")]
    got = ce.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(2,)], "doc_id long"))
    same(got.select("doc_id", "lm.*").orderBy("doc_id").collect(), brute(rows, {2}))


def test_words_and_pairs():
    hashes, rows = ce.words(*flat(pa.array(["The cat the", None, "cat  THE\tcat", "c at"])))
    assert rows.tolist() == [0, 0, 0, 2, 2, 2, 3, 3]
    assert len(set(hashes.tolist())) == 4 and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3]
    both = ce.pairs(hashes, rows)
    assert (both == 0).tolist() == [True, False, False] * 2 + [True, False]
    assert both[1] == both[4 + 1] and both[2] == both[4] and (both[both > 0] >= ce.PAIR).all()


def test_what_is_gathered_grows_with_the_corpus(spark):
    """Other letters, digits and words give other counts: no fixed classes bound the vocabulary."""
    sizes = []
    for n in (200, 2000):
        docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', 'слово', id, concat('W', id * 7919), 'same') AS text")
        ids = spark.createDataFrame([(0, 3)], "chunk long, wanted_id long")
        rows = docs.selectExpr("doc_id * 0 AS chunk", "doc_id", "text").groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(lambda a, b: ce._asked(1)(a, b), ce.ASKED)
        sizes.append(rows.selectExpr("sum(length(grams)) / 8 AS n").first().n)
    assert sizes[1] > 9 * sizes[0]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    same(ce.op6_lm_scoring(spark, folder).orderBy("doc_id").collect(), brute(docs, good))


def test_empty_and_taken_name(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ce.scored(empty, empty).collect() == []
    with pytest.raises(ValueError, match="already has"):
        ce.scored(empty.selectExpr("*", "1 AS LM"), empty)
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    same(ce.scored(one, empty).select("lm.*").collect(), brute([(1, "a b")], set()))
