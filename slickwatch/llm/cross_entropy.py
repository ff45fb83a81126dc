"""LM scoring by cross-entropy difference of two matched n-gram models.

Both models, of the target text (documents labelled good) and of the background
(all documents), are bigrams over one vocabulary: every word of every document.
Vocabulary and counts grow with the corpus; they are never on the driver nor
whole in a task. A document's score is the mean over its words of the target's
loss less the background's: lower is more like the target.

1. *Ask*: documents are dealt to chunks of about ``CHUNK_BYTES``. A task reduces a
   chunk to its different words and pairs of words, with their counts, and sends
   them by bucket of their hash.
2. *Count*: a task adds up one bucket of all chunks and writes each chunk's answer
   beside its question: the corpus-wide counts, in the order of the question.
3. *Score*: chunks meet their answers and turn counts into losses.

A word or pair is one entry in a chunk however often it comes, so a frequent one
weighs no more than any other. Documents are dealt by id, those without one by text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from slickwatch.llm.common import flat, fresh, steps, table
from slickwatch.session import staged

CHUNK_BYTES = 1 << 23
STRENGTH = 8.0  # pseudo-counts that the next lower order gets

# What parts words, and the small letters of A to Z.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
PAIR = np.uint64(1 << 63)  # marks the hash of a pair of words


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z made small) below 2^63, and its text's row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = ~SPACES[data]
    opens = inside & np.append(True, ~inside[:-1] | (rows[1:] != rows[:-1]))
    letters = np.flatnonzero(inside)
    if not len(letters):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(opens[letters])
    sizes = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        each = _mixed((SMALL[data[letters]].astype(np.uint64) << np.uint64(40) | place.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
        total = _mixed(np.add.reduceat(each, first))
    return total & ~PAIR, rows[letters[first]]


def pairs(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hash of each word with the word before it, at 2^63 or above; 0 for the first of a text."""
    with np.errstate(over="ignore"):
        both = _mixed(np.append(np.uint64(0), hashes[:-1]) * np.uint64(0x9E3779B97F4A7C15) + hashes) | PAIR
    if len(both):
        both[np.append(True, rows[1:] != rows[:-1])] = 0
    return both


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, pair hashes and rows of all words of some texts."""
    data, offsets = flat(texts)
    out = []
    for i, j in steps(offsets):
        w, rows = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out.append((w, pairs(w, rows), rows + i))
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(none, *out))


def _packed(x: np.ndarray) -> bytes:
    """Counts, most of them small, in few bytes."""
    return zlib.compress(x.astype("<u8").tobytes(), 1)


def _counts(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), "<u8")


def _column(t: pa.Table, name: str) -> pa.Array:
    column = t.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _asked(buckets: int):
    """Different grams of a chunk (chunk, doc_id, text) with their counts, one row a bucket; ``wanted`` has the ids of the target."""

    def run(t: pa.Table, wanted: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("grams", "n", "wanted")}})
        w, p, rows = _grams(_column(t, "text"))
        known = pc.is_in(_column(t, "doc_id"), value_set=_column(wanted, "wanted_id"), skip_nulls=True)
        wanted = known.to_numpy(zero_copy_only=False)[rows] if len(rows) else np.zeros(0, bool)
        every, twice = np.concatenate([w, p[p > 0]]), np.concatenate([wanted, wanted[p > 0]])
        grams, at = np.unique(every, return_inverse=True)
        total, target = np.bincount(at, minlength=len(grams)), np.bincount(at, twice, len(grams)).astype(np.int64)
        bucket = (grams % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = [[], [], [], []]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = order[cuts[b] : cuts[b + 1]]
            for column, x in zip(out, (b, grams[part].tobytes(), _packed(total[part]), _packed(target[part]))):
                column.append(x)
        number = t.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array([number] * len(out[0]), pa.int64()), "bucket": pa.array(out[0], pa.int64()), **{c: pa.array(v, pa.binary()) for c, v in zip(("grams", "n", "wanted"), out[1:])}})

    return run


ASKED = "chunk long, bucket long, grams binary, n binary, wanted binary"
ANSWERS = "chunk long, bucket long, n binary, wanted binary, words long, tokens long, wanted_tokens long"


def _answered(t: pa.Table) -> pa.Table:
    """Counts over all chunks of the grams of one bucket, for each chunk in the order it asked; the first row has the bucket's sums."""
    raw = {c: [read(x.as_py()) for x in t.column(c)] for c, read in (("grams", lambda x: np.frombuffer(x, "<u8")), ("n", _counts), ("wanted", _counts))}
    grams, at = np.unique(np.concatenate(raw["grams"]), return_inverse=True)
    n, wanted = (np.bincount(at, np.concatenate(raw[c]), len(grams)) for c in ("n", "wanted"))
    ends = np.cumsum([len(g) for g in raw["grams"]])
    one = grams < PAIR
    sums = [int(one.sum()), int(n[one].sum()), int(wanted[one].sum())]
    none = [0] * (len(ends) - 1)
    return pa.table({
        "chunk": t.column("chunk"), "bucket": t.column("bucket"),
        **{c: pa.array([_packed(v[at[e - len(g) : e]]) for e, g in zip(ends, raw["grams"])], pa.binary()) for c, v in (("n", n), ("wanted", wanted))},
        **{c: pa.array([s, *none], pa.int64()) for c, s in zip(("words", "tokens", "wanted_tokens"), sums)},
    })


def losses(pair: np.ndarray, before: np.ndarray, word: np.ndarray, tokens: float, vocabulary: float) -> np.ndarray:
    """Loss in nats of words, from the counts of each with the word before it (-1: a text's first), of the word before, and its own.

    Each order gives ``STRENGTH`` pseudo-counts to the next lower one, down to
    the uniform distribution over the vocabulary, so that no loss is infinite.
    """
    alone = (word + STRENGTH / max(vocabulary, 1.0)) / (tokens + STRENGTH)
    p = np.where(pair < 0, alone, (np.maximum(pair, 0) + STRENGTH * alone) / (before + STRENGTH))
    return -np.log(p)


def _scores(buckets: int, text: str, totals: tuple[int, int, int], drop: list[str]):
    vocabulary, tokens, wanted_tokens = totals

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return docs.drop_columns(drop).append_column("lm", pa.array([], pa.struct([pa.field(x, pa.int64() if x == "n_tokens" else pa.float64()) for x in NAMES])))
        w, p, rows = _grams(_column(docs, text))
        size = docs.num_rows
        every = np.concatenate([w, p[p > 0]])
        grams, at = np.unique(every, return_inverse=True)
        held = np.zeros((2, len(grams)))
        bucket = (grams % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, *values in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "wanted"))):
            for k, v in enumerate(values):
                held[k, order[cuts[b] : cuts[b + 1]]] = _counts(v)
        out = []
        for k, total in ((1, wanted_tokens), (0, tokens)):
            own = held[k, at[: len(w)]]
            both = np.full(len(w), -1.0)
            both[p > 0] = held[k, at[len(w) :]]
            out.append(np.bincount(rows, losses(both, np.append(0.0, own[:-1]), own, total, vocabulary), size) if len(w) else np.zeros(size))
        n = np.bincount(rows, minlength=size)
        mean = [x / np.maximum(n, 1) for x in out]
        found = pa.StructArray.from_arrays([pa.array(n), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], NAMES)
        kept = docs.drop_columns(drop)
        return kept.append_column("lm", found)

    return run


NAMES = ["n_tokens", "loss_target", "loss_background", "score"]
KIND = StructType([StructField(n, LongType() if n == "n_tokens" else DoubleType()) for n in NAMES])


def scored(docs: DataFrame, target: DataFrame, name: str = "lm", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with number of words, both mean losses and their difference, in a struct ``name``.

    The background are all rows of ``docs``, the target those whose doc_id is in
    ``target``. Null and empty texts have no word, losses 0 and score 0; an empty
    target gives every word the uniform loss there. Rows, repeated ones too, stay as
    they are and count each; null ids are never in the target. Other columns stay; a
    taken ``name`` fails.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has a column {name}")
    chunk = fresh(docs, "chunk")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // chunk_bytes))
    number = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(parts))
    rows = docs.withColumn(chunk, number)
    keys = target.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("wanted_id")).filter("wanted_id IS NOT NULL").distinct()
    keys = keys.withColumn("chunk", F.pmod(F.xxhash64("wanted_id"), F.lit(parts)))
    ask, answer = _asked(parts), _answered
    texts = rows.select(F.col(chunk).alias("chunk"), "doc_id", "text").groupBy("chunk")
    asked = texts.cogroup(keys.groupBy("chunk")).applyInArrow(lambda a, b: ask(a, b), ASKED)
    answers = staged(asked.groupBy("bucket").applyInArrow(lambda t: answer(t), ANSWERS), "answers")
    totals = tuple(int(x or 0) for x in answers.agg(*[F.sum(c) for c in ("words", "tokens", "wanted_tokens")]).first())
    score = _scores(parts, "text", totals, [chunk])
    kind = StructType([*docs.schema.fields, StructField("lm", KIND)])
    met = rows.groupBy(chunk).cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: score(a, b), kind)
    return met.withColumnRenamed("lm", name)


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-entropy difference of every document; the target are those labelled good and not toxic."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    target = table(spark, folder, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0")
    rows = scored(docs, target)
    return rows.select("doc_id", "lm.n_tokens", "lm.loss_target", "lm.loss_background", "lm.score")
