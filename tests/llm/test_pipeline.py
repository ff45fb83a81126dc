"""The pipeline stage by stage against brute-force versions of what each stage decides."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from slickwatch.llm import language, quality
from slickwatch.session import staged
from test_packing import check
from test_simhash import brute_groups, brute_print

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model, langs = quality.model_of(spark, FOLDER), language.model_of(spark, FOLDER)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        got = staged(stage(spark, docs, FOLDER), name)
        if name == "quality_classifier":
            tail = model.tails(quality.linear(pa.array([r[1] for r in rows]), model.weights))[:, 0]
            rows = [r for r, t in zip(rows, tail) if t >= quality.KEEP]
            assert np.mean([labels[r[0]] for r in rows if r[0] in labels]) > 0.95
        elif name == "language_id":
            out = language._predictor(*langs)(pa.array([r[1] for r in rows]), pa.array([any(c.isalpha() for c in r[1] or "") for r in rows]))
            rows = [r for r, x in zip(rows, out.to_pylist()) if x["lang_pred"] != "und" and x["score"] >= language.KEEP]
        elif name == "exact_dedup":
            best = {}
            for r in rows:
                best[r[1]] = max(best.get(r[1], r), r)
            rows = list(best.values())
        elif name == "simhash_near_dedup":
            groups = brute_groups([(r[0], brute_print(r[1])) for r in rows])
            rows = [r for r in rows if groups[r[0]] == r[0]]
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            check(library, [r[:2] for r in rows], got.collect())
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()))
            break
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == sorted(rows)
        docs = got
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_rows_with_nulls_and_clashing_columns(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, _quality int, _language string, digest string"
    text = "The quick words of the and that this is. " * 8
    rows = [(1, text, None, None, None, 1, "x", "d"), (2, text, "en", "s", 9, None, None, None), (None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 2, "y", "e"), (4, text + "end", "en", "s", 1, 3, "z", "f"), (4, text + "end", "en", "s", 1, 3, "z", "f")]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, FOLDER), name)
            assert docs.dtypes == spark.createDataFrame([], kind).dtypes
        assert docs.count() <= 2
