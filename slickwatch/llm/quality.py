"""Quality by ordinal cumulative-link regression on hashed text.

P(grade > k) = 1 / (1 + exp(cut_k - w.x)): one weight vector for all grades and
thresholds cut_0 <= cut_1 <= ... kept in order by fitting their gaps. x is the
share of each hashed feature among those of its kind in the text: byte
trigrams, and what each word is next to its neighbours (the same word as one or
two before, its shape). The fit sees a bounded sample of rated documents; every
document is scored whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwatch.llm.common import annotated, flat, fresh, steps, table

TRIGRAMS, WORDS = 1 << 13, 1 << 7
FEATURES = TRIGRAMS + WORDS
SAMPLE = 4000  # rated documents that the fit sees, at most
ROUNDS, RATE, DECAY = 300, 0.05, 1e-4
SCALE = 30.0  # shares are small; one scale for all

# What each byte is (0 space, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other mark, 6 beyond ASCII).
KINDS = np.full(256, 5, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 0
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:] = 1, 2, 3, 6
KINDS[[ord(c) for c in ".,;:'"]] = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram feature and row of each byte, word feature and row of each word."""
    n = len(data)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = data.astype(np.uint32)
    one, two = np.roll(wide, 1), np.roll(wide, 2)
    at = np.arange(n)
    begins = offsets[:-1][rows] if n else rows
    one[at < begins + 1] = 0
    two[at < begins + 2] = 0
    trigrams = ((wide | one << 8 | two << 16) * np.uint32(2654435761)) >> np.uint32(32 - 13)
    kind = KINDS[data]
    inside = kind > 0
    opens = inside & ((at == begins) | ~np.roll(inside, 1))
    starts = np.flatnonzero(opens)
    if not len(starts):
        return trigrams.astype(np.int64), rows, starts, starts
    closes = inside & (np.append(~inside[1:], True) | (np.append(begins[1:], n) == at + 1))
    ends = np.flatnonzero(closes) + 1
    place = at - starts[np.maximum(np.cumsum(opens) - 1, 0)]
    mixed = wide.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(inside, mixed, np.uint64(0)), dtype=np.uint64)])
    hashes = total[ends] - total[starts]
    owner = rows[starts]

    def seen(back: int) -> np.ndarray:
        out = np.zeros(len(starts), np.int64)
        if len(starts) > back:
            out[back:] = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        return out

    shape = np.zeros(len(starts), np.int64)
    for bit, k in enumerate((2, 3, 5)):
        count = np.concatenate([[0], np.cumsum(kind == k)])
        shape |= ((count[ends] > count[starts]).astype(np.int64)) << bit
    long = np.minimum((ends - starts) // 8, 3)
    return trigrams.astype(np.int64), rows, seen(1) | seen(2) << 1 | shape << 2 | long << 5, owner


def linear(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """w.x of each text; 0 for a text without bytes."""
    data, offsets = flat(texts)
    out = np.zeros(len(offsets) - 1)
    for i, j in steps(offsets):
        part = data[offsets[i] : offsets[j]]
        grams, rows, words, owner = features(part, offsets[i : j + 1] - offsets[i])
        for feature, row in ((grams, rows), (words + TRIGRAMS, owner)):
            count = np.bincount(row, minlength=j - i)
            out[i:j] += np.bincount(row, weights[feature], j - i) / np.maximum(count, 1)
    return out * SCALE


def dense(texts: list[str]) -> np.ndarray:
    """The feature rows of a bounded sample."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for k, text in enumerate(texts):
        data, offsets = flat(pa.array([text]))
        grams, _, words, _ = features(data, offsets)
        for feature in (grams, words + TRIGRAMS):
            if len(feature):
                out[k] += np.bincount(feature, minlength=FEATURES) * (SCALE / len(feature))
    return out


class Model:
    """Weights and ordered cuts."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut, in columns."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))


def fit(x: np.ndarray, grades: np.ndarray, levels: int) -> Model:
    """Maximum likelihood with a small decay, by Adam from zero; deterministic.

    The likelihood of grade g is P(grade > g - 1) - P(grade > g). Cuts are
    cut_0 and gaps exp(.), so that they stay in order.
    """
    counts = np.bincount(grades, minlength=levels) + 0.5
    above = 1 - np.cumsum(counts)[:-1] / counts.sum()
    cuts = -np.log(above / (1 - above))
    state = np.concatenate([np.zeros(x.shape[1]), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    if not len(x):
        return Model(state[: x.shape[1]], cuts)
    features_n, m, v = x.shape[1], np.zeros_like(state), np.zeros_like(state)

    def ordered(s):
        return np.concatenate([s[features_n : features_n + 1], s[features_n] + np.cumsum(np.exp(s[features_n + 1 :]))])

    for step in range(1, ROUNDS + 1):
        cuts = ordered(state)
        score = x @ state[:features_n].astype(np.float32)
        tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -60, 60)))
        full = np.hstack([np.ones((len(x), 1)), tail, np.zeros((len(x), 1))])
        rows = np.arange(len(x))
        p = np.maximum(full[rows, grades] - full[rows, grades + 1], 1e-9)
        slope = full * (1 - full)  # of a tail by the score
        by_score = (slope[rows, grades] - slope[rows, grades + 1]) / p / len(x)
        by_cut = np.zeros((len(x), levels + 1))
        by_cut[rows, grades] -= slope[rows, grades] / p
        by_cut[rows, grades + 1] += slope[rows, grades + 1] / p
        by_cut = by_cut[:, 1:levels].mean(0)
        gaps = np.exp(state[features_n + 1 :])
        later = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([by_score.astype(np.float32) @ x, later[:1], later[1:] * gaps])
        grad[:features_n] -= DECAY * state[:features_n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        state = state + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(state[:features_n], ordered(state))


def trained(docs: DataFrame, ratings: DataFrame, levels: int, sample: int = SAMPLE) -> Model:
    """A model of ``docs`` (doc_id, text) rated by ``ratings`` (doc_id, grade 0 to levels - 1).

    At most ``sample`` rated ids, those of least hash, are drawn, so only a
    bounded table is broadcast. Tasks turn each drawn text, whole, into its shares,
    and only those reach the driver: at most ``FEATURES`` numbers a document. Grades
    out of range, null ids and ids without a text teach nothing; of several grades of
    an id the least counts.
    """
    drawn = (
        ratings.filter(F.col("grade").between(0, levels - 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.select(F.xxhash64("doc_id").alias("a"), F.sha2("text", 256).alias("b"), "grade", F.arrow_udf(_shares, "binary")("text").alias("shares"))
    rows = rows.orderBy("a", "b").limit(sample).collect()
    x = np.zeros((len(rows), FEATURES), np.float32)
    for row, r in zip(x, rows):
        found = np.frombuffer(r.shares, SHARE)
        row[found["at"]] = found["share"]
    return fit(x, np.array([r.grade for r in rows], np.int64), levels)


SHARE = np.dtype([("at", "<u2"), ("share", "<f4")])


def _shares(texts: pa.Array) -> pa.Array:
    """The features of each whole text that are not zero, as bytes."""
    out = []
    for text in texts:
        x = dense([text.as_py()])[0]
        found = np.zeros(np.count_nonzero(x), SHARE)
        found["at"] = np.flatnonzero(x)
        found["share"] = x[found["at"]]
        out.append(found.tobytes())
    return pa.array(out, pa.binary())


def _scorer(model: Model) -> Callable:
    def run(texts: pa.Array) -> pa.Array:
        tails = model.tails(linear(texts, model.weights))
        return pa.StructArray.from_arrays([pa.array(tails.sum(1)), pa.array(tails[:, 0])], ["expected_grade", "tail"])

    return run


def scored(docs: DataFrame, model: Model, name: str = "quality") -> DataFrame:
    """``docs`` with a struct of expected grade and tail P(grade >= 1).

    Null text counts as empty, and a text without bytes scores by the cuts
    alone. Rows, repeated ones too, stay as they are; other columns stay, and a taken ``name`` fails.
    """
    return annotated(docs, name, _scorer(model), "struct<expected_grade: double, tail: double>", "text")


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from labels: 0 poor, 1 good but toxic, 2 good."""
    good, toxic = F.col("quality") == 1, F.coalesce(F.col("toxic"), F.lit(0)) == 1
    grade = F.when(good & toxic, 1).when(good, 2).otherwise(0)
    return labels.filter("quality IS NOT NULL").select("doc_id", grade.alias("grade"))


LEVELS = 3
KEEP = 0.5  # a document stays from this tail probability on


def model_of(spark: SparkSession, folder: str) -> Model:
    """The model of the rated documents of one folder."""
    return trained(table(spark, folder, "documents"), grades(table(spark, folder, "labels")), LEVELS)


def selected(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose tail probability is ``keep`` or more, all columns as they were."""
    name = fresh(docs, "quality")
    return scored(docs, model, name).filter(F.col(name)["tail"] >= keep).drop(name)


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, expected grade, tail probability and the decision for every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = scored(docs, model_of(spark, folder))
    return rows.select("doc_id", "quality.expected_grade", "quality.tail", (F.col("quality.tail") >= KEEP).alias("kept"))
