"""The string kernel against a plain one, held-out accuracy, gapped words, odd rows."""

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from slickwatch.llm import toxicity
from slickwatch.llm.common import flat

FOLDER = "/root/testdata/sf0.1"


def codes(text):
    return toxicity.words_of(*flat(pa.array([text])))


def plain_kernel(a, b):
    """Sum over shared subsequences of four letters that span SPAN at most, discounted by both spans."""

    def found(x):
        out = {}
        for places in combinations(range(len(x)), 4):
            span = places[-1] - places[0] + 1
            if span <= toxicity.SPAN:
                key = tuple(x[p] for p in places)
                out[key] = out.get(key, 0) + toxicity.DECAY**span
        return out

    left, right = found(a), found(b)
    size = toxicity.norms(np.array([len(a), len(b)]))
    return sum(v * right.get(k, 0) for k, v in left.items()) / size[0] / size[1]


def test_kernels_and_collapsed_weights():
    words = [codes(w)[0] for w in ("stupid", "stuupid", "st.u-pid", "hello", "a", "banana")]
    marks = toxicity.Landmarks([words[0], words[3], words[5]])
    got = marks.kernels(words)
    want = [[plain_kernel(w.tolist(), m.tolist()) for m in (words[0], words[3], words[5])] for w in words]
    assert np.allclose(got, want, atol=1e-5)
    parts = np.array([0.5, -1.0, 0.25])
    flat_codes = np.concatenate(words)
    starts = np.cumsum([0] + [len(w) for w in words])[:-1]
    assert np.allclose(toxicity.decisions(marks.weights(parts), 0.1, flat_codes, starts), got @ parts + 0.1, atol=1e-5)


def test_words_join_spelt_out_letters():
    frame = lambda w: [30, *(ord(c) - 96 for c in w), 31]
    for text in ("idiot", "I.D.I.O.T", "i d i o t", "id-iot"):
        assert codes(text)[0].tolist() == frame("idiot")
    letters, starts, rows = toxicity.words_of(*flat(pa.array(["a b", "c", None, "de f"])))
    assert letters.tolist() == frame("ab") + frame("c") + frame("de") + frame("f") and rows.tolist() == [0, 1, 3, 3]


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.model_of(spark, FOLDER)


def test_held_out_accuracy(spark, model):
    """A few hundred toxic documents teach this much; ten times as many give 0.95 and 1.0 (README)."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    rows = [r for r in toxicity.scored(docs, model).select("doc_id", "toxic", "score").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    flagged = [r for r in rows if r.score >= toxicity.THRESHOLD]
    assert sum(r.toxic for r in flagged) / sum(r.toxic for r in rows) > 0.85
    assert sum(r.toxic for r in flagged) / len(flagged) > 0.65


def test_gaps_and_odd_rows(spark, model):
    rows = [(1, "you idiot"), (2, "you i.d.i.o.t"), (3, "you i d i o t !"), (4, None), (5, ""), (6, "***"), (7, "the of and " * 20000), (8, "é"), (8, "é")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _score string")
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert got[1] == got[2] == got[3] >= toxicity.THRESHOLD
    assert got[4] == got[5] == got[6] < 0.1 and got[7] < 0.5 and got[8] < 0.5


INSERTED = ["idxiot", "ixdiot", "idixot", "idiiiot", "sxtupid", "stuxpid", "stuupid", "mooron", "stu pid", "i diot", "you are an idxiot"]
ALIKE = ["studio", "studied", "idiom", "cupid", "patriot", "stuff and", "the student", "stupor", "rapid", "period", "radio", "ideal", "insipid", "chariot"]


def test_inserted_letters(model):
    """A foreign letter at any place, a letter repeated and a space inside; clean look-alikes stay far below."""
    got = dict(zip(INSERTED + ALIKE, model.scores(pa.array(INSERTED + ALIKE)).tolist()))
    assert all(got[w] >= toxicity.THRESHOLD for w in INSERTED), got
    assert all(got[w] < 0.1 for w in ALIKE), got


def test_tolerant_decisions_against_every_copy(model):
    words = ["stupid", "sxtupid", "stuuupid", "aab", "the", "abcdefghij" * 4, "sxtupid"]
    framed = [codes(w)[0] for w in words]
    starts = np.cumsum([0] + [len(w) for w in framed])[:-1]
    got = toxicity.tolerant(model.weights, model.bias, np.concatenate(framed), starts)
    one = lambda w: toxicity.decisions(model.weights, model.bias, np.array(w), np.zeros(1, np.int64))[0]
    for g, w in zip(got, framed):
        w, best = w.tolist(), [one(w)]
        if toxicity.SHORTENED[0] <= len(w) - 2 <= toxicity.SHORTENED[1]:
            best += [one(w[:i] + w[i + 1 :]) - toxicity.LEFT_OUT for i in range(1, len(w) - 1)]
        once = [c for i, c in enumerate(w) if not i or c != w[i - 1]]
        if once != w:
            best.append(one(once) - toxicity.LEFT_OUT)
        assert abs(g - max(best)) < 1e-9


def test_whole_texts_teach(spark):
    """An insult behind 200,000 letters teaches; a third of the documents sets the logistic."""
    filler = " ".join(f"plain words number {k} of the text." for k in range(6000))
    name = lambda i: "".join(chr(97 + (7 * i + 3 * k * k) % 26) for k in range(6))
    rows = [(i, f"{filler} you are a blockhead {name(i)}.", 1) for i in range(24)] + [(100 + i, f"{filler} you are a reader {name(i + 24)}.", 0) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    got = toxicity.trained(df, df).scores(pa.array(["you are a blockhead", "you are a reader", "b.l.o.c.k.h.e.a.d", "a blockxhead", None]))
    assert min(got[[0, 2, 3]]) > 0.7 and max(got[[1, 4]]) < 0.3
    bags = toxicity.sentence_bags("word " * 500 + ". " + "x" * 1000 + ". end it")
    assert len(bags) == 3 and max(len(w) for b in bags for w in b) <= toxicity.LONGEST


def test_untaught(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.trained(empty, empty)
    assert toxicity.scored(empty, model).collect() == []
    assert model.scores(pa.array(["text"]))[0] < 0.01  # no toxic document was seen
