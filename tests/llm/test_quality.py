"""The ordinal model: gradient, order of cuts, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from slickwatch.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_features_by_hand():
    data = np.frombuffer("ab ab!Cd".encode() + "x".encode(), np.uint8)
    grams, rows, words, owner = quality.features(data, np.array([0, 8, 8, 9]))
    assert rows.tolist() == [0] * 8 + [2]
    assert owner.tolist() == [0, 0, 2]  # ab, ab!Cd, x
    assert grams[0] == grams[3 - 3] and grams[8] != grams[7]
    again = quality.features(np.frombuffer(b"to to", np.uint8), np.array([0, 5]))[2]
    assert again.tolist() == [0, 1]  # the second repeats the first


def test_fit_orders_cuts_and_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    grades = np.digitize(x[:, 0] * 2 + rng.normal(size=600) * 0.2, [-1.0, 0.5, 1.5])
    model = quality.fit(x, grades, 4)
    assert (np.diff(model.cuts) > 0).all()
    tails = model.tails(x.astype(float) @ model.weights)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert ((tails >= 0.5).sum(1) == grades).mean() > 0.9


def test_sample_bound_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    train = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    model = quality.trained(docs, quality.grades(train), quality.LEVELS)
    test = docs.join(labels.withColumnRenamed("quality", "good"), "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    rows = quality.scored(test, model).select("doc_id", "quality.tail", "good").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([(r.tail >= 0.5) == (r.good == 1) for r in rows]) > 0.93


def test_odd_rows(spark):
    model = quality.Model(np.linspace(-1, 1, quality.FEATURES), np.array([-0.5, 0.5]))
    rows = [(1, None, "q"), (2, "", "q"), (3, " ", "q"), (4, "é" * 900_000, "q"), (5, "same", "q"), (5, "same", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _quality string")
    got = quality.scored(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.quality.tail <= 1 and 0 <= r.quality.expected_grade <= 2 for r in got)
    assert got[0].quality == got[1].quality
    alone = quality.linear(pa.array(["é" * 900_000]), model.weights)
    assert np.isclose(quality.linear(pa.array(["x", "é" * 900_000, None]), model.weights)[1], alone[0])
    kept = quality.selected(docs, model)
    assert kept.columns == docs.columns
    empty = spark.createDataFrame([], "doc_id long, text string")
    untaught = quality.trained(empty, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert quality.scored(empty, untaught).collect() == []


def test_whole_texts_teach_and_score(spark):
    """What tells grades apart comes after 40,000 letters; scores equal those of the plain feature rows."""
    filler = "some words of a long and even text. " * 1200
    rows = [(k, filler + ("GOOD 77 " if k % 2 else "poor zz ") * 300, k % 2 * 2) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int").repartition(4)
    model = quality.trained(docs, docs, 3)
    got = {r.doc_id: r.quality.tail for r in quality.scored(docs.select("doc_id", "text"), model).collect()}
    assert all((got[k] > 0.5) == bool(k % 2) for k in got)
    plain = model.tails(quality.dense([r[1] for r in rows]).astype(float) @ model.weights)[:, 0]
    assert np.allclose([got[k] for k in range(40)], plain, atol=1e-4)


def test_clashing_names_fail(spark):
    import pytest

    from slickwatch.llm import language, token_counts, toxicity

    docs = spark.createDataFrame([("a", 1, 2, 3)], "text string, Quality int, score int, language int")
    model = quality.Model(np.zeros(quality.FEATURES), np.zeros(2))
    for run in (lambda: quality.scored(docs, model), lambda: toxicity.scored(docs, None), lambda: language.predicted(docs, ([], np.zeros((1, 0)))), lambda: token_counts.counted(docs, "", "score")):
        with pytest.raises(ValueError, match="already have"):
            run()
