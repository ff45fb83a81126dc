"""Language ID by multilingual mixture inference.

Each language has a model of byte trigrams within words. A document is a
mixture: expectation-maximisation estimates the part of its words that each language
wrote, from the likelihoods of the words' trigrams. The language set is chosen
by penalised likelihood: from all languages down, the least one goes as long as
the penalised likelihood does not fall.

A text fits by the mean log-likelihood of its trigrams, each word in its best
language. Below a floor between the least ``LOWEST`` of the learning fold and
a model of even trigrams it is in none of the languages.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwatch.llm.common import annotated, flat, fresh, rank_digits, steps, table

BUCKETS = 1 << 16
PRIOR = 0.1  # pseudo-count of each trigram bucket
ROUNDS, NEAR = 25, 1e-4
PENALTY = 6.0  # log-likelihood that a further language must gain, times ln(1 + words) / 2
UNDETERMINED = "und"
LOWEST = 0.01  # part of the learning fold below the upper end of the floor
ROOM = 2.0  # nats a trigram that a text of one word may lie below the floor; falls with the root of the words


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in UTF-8 made small; 0 for bytes that are no letter."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[after] += 32
    out[~(((out >= 97) & (out <= 122)) | (out >= 128))] = 0
    return out


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter byte, the first of each word, and the word's row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    letters = lowered(data).astype(np.uint32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cut = np.append(True, rows[1:] != rows[:-1])
    before, after = np.roll(letters, 1), np.roll(letters, -1)
    before[cut] = 0
    after[np.append(cut[1:], True)] = 0
    inside = letters > 0
    opens = inside & (before == 0)
    code = before << np.uint32(16) | letters << np.uint32(8) | after
    buckets = (code[inside] * np.uint32(2654435761)) >> np.uint32(16)
    first = np.flatnonzero(opens[inside])
    return buckets.astype(np.int64), first, rows[inside][first]


def learnt(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (bucket, language) from ``docs`` (text, lang), all of them.

    Tasks count their own documents; sums by language and bucket move. What the
    driver gets is bounded by the number of languages times ``BUCKETS``.
    """

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = flat(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for i, j in steps(offsets):
                buckets, first, rows = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row = np.repeat(rows, np.diff(np.append(first, len(buckets))))
                names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
                count = np.bincount(code[row] * BUCKETS + buckets, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names):
                    counts[name] = counts.get(name, 0) + count[k]
        for name, count in counts.items():
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(count[seen], pa.int64())], ["lang", "bucket", "n"])

    each = docs.select("text", F.col("lang").cast("string")).filter("lang IS NOT NULL").mapInArrow(run, "lang string, bucket int, n long")
    rows = each.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique().tolist())
    count = np.zeros((BUCKETS, len(names)))
    count[rows["bucket"], rows["lang"].map({x: k for k, x in enumerate(names)})] = rows["n"]
    return names, np.log((count + PRIOR) / (count + PRIOR).sum(0)).astype(np.float32)


def _fits(like: np.ndarray, first: np.ndarray, n_grams: int, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean log-likelihood of each text's trigrams, each word in its best language, and the number of words."""
    size = np.diff(np.append(first, n_grams))
    grams = np.bincount(rows, size, n)
    words = np.bincount(rows, minlength=n)
    best = np.bincount(rows, like.max(1), n) if len(rows) else np.zeros(n)
    return best / np.maximum(grams, 1), words


def _likelihoods(model: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    return np.add.reduceat(model[buckets], first, axis=0).astype(np.float64) if len(first) else np.zeros((0, model.shape[1]))


def floor_of(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> float:
    """Midway between the fit that all but ``LOWEST`` of ``docs`` (text, lang) reach and that of even trigrams.

    All texts that taught the model count; what the driver gets is a histogram in
    hundredths of a nat.
    """
    names, table_ = model
    if not names:
        return -np.inf

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i, j in steps(offsets):
                buckets, first, rows = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                fit, words = _fits(_likelihoods(table_, buckets, first), first, len(buckets), rows, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(fit[words > 0] * 100).astype(np.int64))], ["fit"])

    each = docs.filter("lang IS NOT NULL").select("text").mapInArrow(run, "fit long")
    rows = sorted(map(tuple, each.groupBy("fit").count().collect()))
    if not rows:
        return -np.inf
    reached = np.cumsum([n for _, n in rows])
    low = rows[int(np.searchsorted(reached, LOWEST * reached[-1], "right"))][0] / 100
    return (low - np.log(BUCKETS)) / 2


def mixed(like: np.ndarray, rows: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of each allowed language in each of n documents, and the log-likelihood.

    ``like``: log-likelihood of each word in each language; ``rows``: its
    document, in order. A document stops in the round in which its own parts
    settle, so its result does not depend on the others.
    """
    parts = allowed / allowed.sum(1, keepdims=True)
    total = np.zeros(n)
    live, open_ = np.arange(n), np.ones(n, bool)
    top = like.max(1, keepdims=True)
    weight = np.exp(like - top)
    for _ in range(ROUNDS):
        size = np.bincount(rows, minlength=len(live))
        shared = weight * parts[live][rows]
        mass = shared.sum(1)
        mass = np.where(mass > 0, mass, 1e-300)
        new = np.stack([np.bincount(rows, shared[:, k] / mass, len(live)) for k in range(like.shape[1])], 1)
        new = np.where(size[:, None] > 0, new / np.maximum(size, 1)[:, None], parts[live])
        new /= np.maximum(new.sum(1, keepdims=True), 1e-300)
        moving = np.abs(new - parts[live]).max(1) > NEAR
        total[live[open_]] = np.bincount(rows, np.log(mass) + top[:, 0], len(live))[open_]
        parts[live[open_]] = new[open_]
        open_ &= moving
        if not open_.any():
            break
        if open_.mean() < 0.7:
            keep = open_[rows]
            number = np.cumsum(open_) - 1
            rows, weight, top, live = number[rows[keep]], weight[keep], top[keep], live[open_]
            like, open_ = like[keep], np.ones(len(live), bool)
    return parts, total


def chosen(like: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts and the set of languages of each document by penalised likelihood."""
    allowed = np.ones((n, like.shape[1]))
    parts, total = mixed(like, rows, n, allowed)
    each = PENALTY * np.log1p(np.bincount(rows, minlength=n)) / 2
    open_ = allowed.sum(1) > 1
    while open_.any():
        least = np.argmin(np.where(allowed > 0, parts, np.inf), 1)
        less = allowed.copy()
        less[np.flatnonzero(open_), least[open_]] = 0
        picked = open_[rows]
        number = np.cumsum(open_) - 1
        new, value = mixed(like[picked], number[rows[picked]], int(open_.sum()), less[open_])
        better = value >= total[open_] - each[open_]
        at = np.flatnonzero(open_)[better]
        parts[at], total[at], allowed[at] = new[better], value[better], less[at]
        open_ = np.zeros(n, bool)
        open_[at] = allowed[at].sum(1) > 1
    return parts, allowed > 0


def _predictor(names: list[str], model: np.ndarray, floor: float = -np.inf) -> Callable:
    def run(texts: pa.Array, lettered: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        some = np.array([bool(x) for x in lettered.to_pylist()], bool)
        n = len(offsets) - 1
        lang, score, sets = np.full(n, UNDETERMINED, object), np.zeros(n), [[] for _ in range(n)]
        for i, j in steps(offsets):
            if not names:
                break
            buckets, first, rows = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            like = _likelihoods(model, buckets, first)
            fit, words = _fits(like, first, len(buckets), rows, j - i)
            known = some[i:j] & (fit >= floor - ROOM / np.sqrt(np.maximum(words, 1)))
            parts, picked = chosen(like, rows, j - i)
            best = parts.argmax(1)
            for k in np.flatnonzero(known).tolist():
                lang[i + k], score[i + k] = names[best[k]], min(1.0, parts[k, best[k]])
                sets[i + k] = [names[x] for x in np.flatnonzero(picked[k])]
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], ["lang_pred", "score", "languages"]
        )

    return run


def predicted(docs: DataFrame, model: tuple, name: str = "language") -> DataFrame:
    """``docs`` with the main language, its part of the words and the set of languages.

    ``model``: languages, log-probabilities and, if texts that fit none are to be
    found, the floor. Null texts, texts without a letter and texts below the floor are
    ``und`` with score 0, as are all texts if nothing was learnt. Ties go to the first language by name. Rows,
    repeated ones too, stay as they are; other columns stay, and a taken ``name`` fails.
    """
    kind = "struct<lang_pred: string, score: double, languages: array<string>>"
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return annotated(docs, name, _predictor(*model), kind, F.col("text"), lettered)


def model_of(spark: SparkSession, folder: str) -> tuple[list[str], np.ndarray, float]:
    """What the documents outside the held-out fold teach."""
    docs = table(spark, folder, "documents").filter(~rank_digits("doc_id", 4, 2))
    model = learnt(docs)
    return *model, floor_of(docs, model)


KEEP = 0.5  # a document stays if its main language wrote this part of it


def selected(docs: DataFrame, model: tuple, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose main language is known and wrote ``keep`` or more, all columns as they were."""
    name = fresh(docs, "language")
    rows = predicted(docs, model, name)
    return rows.filter((F.col(name)["lang_pred"] != UNDETERMINED) & (F.col(name)["score"] >= keep)).drop(name)


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Main language of every document, learnt outside the held-out fold; ``und`` without a letter only."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = predicted(docs, learnt(table(spark, folder, "documents").filter(~rank_digits("doc_id", 4, 2))))
    held = rank_digits("doc_id", 4, 2).alias("held_out")
    return rows.select("doc_id", held, "language.lang_pred", "language.score", "language.languages")
