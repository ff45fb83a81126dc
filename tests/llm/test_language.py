"""Language ID: held-out accuracy, mixtures, the set by penalised likelihood, odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from slickwatch.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_leakage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.op9_language_id(spark, FOLDER).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    # The held-out fold's languages teach nothing.
    fold = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
    names, table = language.learnt(docs.filter(f"NOT ({fold})"))
    assert (language.model_of(spark, FOLDER)[1] == table).all() and names == ["de", "en", "es", "fr"]


def test_mixture_proportions_and_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.learnt(docs)
    by = {r.lang: r.text for r in docs.filter("n_chars BETWEEN 3000 AND 9000").orderBy("doc_id").collect()}
    words = lambda x: [w for w in by[x].split() if any(c.isalpha() for c in w)]  # noqa: E731  marks are no words
    de, fr = " ".join(words("de")[:300]), " ".join(words("fr")[:100])
    rows = [(1, f"{de}\n{fr}", 5), (2, de, 5), (3, None, 5), (4, "", 5), (5, "12 ++ 3", 5), (6, "é", 5), (7, de * 300, 5), (8, de, 5), (8, de, 5)]
    got = language.predicted(spark.createDataFrame(rows, "doc_id long, text string, _language int"), model).collect()
    out = {r.doc_id: r.language for r in got}
    assert len(got) == 9
    assert out[1].languages == ["de", "fr"] and abs(out[1].score - 0.75) < 0.05 and out[1].lang_pred == "de"
    assert out[2].languages == ["de"] and out[2].score > 0.99 and out[7].lang_pred == "de"
    assert [out[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and out[6].lang_pred in model[0]
    left = language.selected(spark.createDataFrame(rows, "doc_id long, text string, _language int"), model)
    assert left.columns == ["doc_id", "text", "_language"] and sorted(r.doc_id for r in left.collect()) == [1, 2, 6, 7, 8, 8]


def test_em_matches_a_plain_one():
    rng = np.random.default_rng(2)
    like = np.log(rng.dirichlet(np.ones(3), size=60))
    rows = np.sort(rng.integers(0, 4, 60))
    parts, _ = language.mixed(like, rows, 4, np.ones((4, 3)))
    for d in range(4):
        p, own = np.full(3, 1 / 3), np.exp(like[rows == d])
        for _ in range(language.ROUNDS):
            old = p
            p = (own * p / (own * p).sum(1, keepdims=True)).mean(0)
            if np.abs(p - old).max() <= language.NEAR:
                break
        assert np.allclose(parts[d], p, atol=1e-9)


def test_score_does_not_depend_on_the_other_documents(spark):
    model = language.learnt(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    run = language._predictor(*model)
    together = run(pa.array(texts), pa.array([True] * len(texts))).to_pylist()
    assert together == [run(pa.array([x]), pa.array([True])).to_pylist()[0] for x in texts]


def test_query_says_und_without_a_letter_only(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = ["Öachen 7844", "Привет мир", "Hello xyzzy qqq", "é"]
    rows = language.predicted(spark.createDataFrame([(x,) for x in odd], "text string"), language.learnt(docs)).collect()
    assert all(r.language.lang_pred in ("de", "en", "es", "fr") and 0 < r.language.score <= 1 for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language.op9_language_id(spark, FOLDER).collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))


def test_empty_and_untaught(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.learnt(empty)
    assert language.predicted(empty, model).collect() == []
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.predicted(docs, language.learnt(docs)).first().language.lang_pred == "und"


def test_selection_can_reject(spark):
    """Unlearnt languages, letter noise and even mixtures go; clean documents of the held-out fold stay."""
    model = language.model_of(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    clean = docs.filter("n_chars BETWEEN 1000 AND 9000 AND crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    rng = np.random.default_rng(4)
    noise = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 10)))) for _ in range(100))
    by = {r.lang: r.text.split()[:80] for r in clean.orderBy("doc_id").collect()}
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza",
    ]
    even = "\n".join(" ".join(by[x]) for x in sorted(by))
    assert len(by) == 4
    bad = spark.createDataFrame([(-k, x, None, None) for k, x in enumerate([noise, *foreign, even], 1)], docs.schema)
    assert language.selected(bad, model).collect() == []
    assert language.selected(clean, model).count() >= 0.99 * clean.count() > 0
