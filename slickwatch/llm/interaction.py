"""Filter interaction audit by min-plus removal ranks.

A document is a row of a mask matrix: for each filter 0 if it fails it, else
infinity. An order of the filters is a column of a position matrix: the step at
which each filter comes, which is the inverse of the permutation. The min-plus
product of the two (the minimum over the filters of mask + position) is the step
at which the document is removed, or none if it fails nothing.

Documents with the same part and mask are alike, so Spark first adds them up:
at most 2^filters rows a part, whatever a part's size. The product is needed once
for each mask and order; the counts of a part are then scattered to its steps.

Copies are found by the SHA-256 of the whole text. No join has the digest alone
as its key, so a large group of copies is never one task: the least id of a digest
is an aggregate with map-side combining, and goes back to the one document that
has that id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwatch.llm.common import table
from slickwatch.session import staged

# Fixed values of the five filters, in the order of their bits.
LETTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"
SPACES = " \t\n\x0b\x0c\r"

#: Parts whose steps are worked out at once inside a task.
PARTS_AT_ONCE = 64

SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def own_failures(text) -> F.Column:
    """Bits A to D of the filters that one text (not null) fails by itself."""
    core = F.btrim(text, F.lit(SPACES))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, "[\\x20\\x09-\\x0D]+", -1))
    total, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        total < MIN_WORDS,
        100 * distinct.cast("long") < MIN_DISTINCT_PERCENT * total.cast("long"),
        100 * capitals.cast("long") > MAX_CAPITALS_PERCENT * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail.

    Null text counts as empty, null source as the empty part. A row is a copy
    (filter E) if a row with a smaller doc_id has the same text; a row without
    doc_id neither is one nor makes one, and has no labels. Rows that repeat
    count each. An id is good (toxic) if any of its label rows has a 1. Columns
    other than doc_id, text, source, quality and toxic are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), own_failures(text).alias("mask"))
    rows = staged(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "masks")
    nameless, named = rows.filter("doc_id IS NULL"), rows.filter("doc_id IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad")
    )
    told = named.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select(
        "part",
        (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E"))).alias("mask"),
        "n",
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("bad", F.lit(0)).alias("bad"),
    )
    whole = told.unionByName(nameless.select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("bad")))
    return whole.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic")
    )


class Orders:
    """All orders of some filters, and the removal step of every mask under each."""

    def __init__(self, letters: str):
        k = len(letters)
        self.names = ["".join(p) for p in permutations(letters)]
        order = np.array(list(permutations(range(k))))  # the filter at each step
        self.order = order
        self.position = np.argsort(order, axis=1).T  # filters x orders, the inverse permutations
        self.fails = (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(bool)
        cost = np.where(self.fails, 0, k)  # k, the step after the last, stands for infinity
        self.step = np.full((1 << k, len(order)), k)
        for f in range(k):
            np.minimum(self.step, cost[:, f, None] + self.position[f], out=self.step)

    def scattered(self, weights: np.ndarray) -> np.ndarray:
        """Weights (parts x masks) added up at each mask's removal step: parts x orders x (steps + 1)."""
        k = self.order.shape[1]
        out = np.zeros((len(self.order), k + 1, len(weights)), np.int64)
        orders = np.broadcast_to(np.arange(len(self.order)), self.step.shape)
        np.add.at(out, (orders, self.step), weights.T[:, None, :])
        return out.transpose(2, 0, 1)

    def redundant(self, weights: np.ndarray) -> np.ndarray:
        """Weights of the masks that fail the filter of a step but were removed before it: parts x orders x steps."""
        out = np.zeros((len(weights), *self.order.shape), np.int64)
        for s in range(self.order.shape[1]):
            before = self.fails[:, self.order[:, s]] & (self.step < s)
            out[:, :, s] = weights @ before.astype(np.int64)
        return out


def _tables(parts: list, rows: list, orders: Orders) -> pa.RecordBatch:
    """The result rows of some parts, from their (mask, n, good, toxic) entries."""
    k, count = orders.order.shape[1], len(parts)
    held = np.zeros((3, count, 1 << k), np.int64)
    for i, entries in enumerate(rows):
        for e in entries:
            held[:, i, e["mask"]] += e["n"], e["good"], e["toxic"]
    n = held[0]
    removed = orders.scattered(n)[:, :, :k]
    kept = n.sum(1)[:, None, None] - np.cumsum(removed, axis=2)
    only = n[:, 1 << np.arange(k)]
    by_filter = np.take_along_axis(removed, orders.position.T[None], axis=2).sum(1)
    each = lambda x: x[:, orders.order]
    columns = [kept, removed, orders.redundant(n), each(only), *(orders.scattered(x)[:, :, :k] for x in held[1:]), each(by_filter)]
    size = len(orders.names) * k
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array(parts, object), size), pa.string()),
            pa.array(np.tile(np.repeat(np.array(orders.names, object), k), count), pa.string()),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders.names) * count)),
            *(pa.array(np.ascontiguousarray(x).reshape(-1)) for x in columns),
        ],
        ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    )


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The effect of each filter at each step of every order, for each part.

    ``counts`` has part (not null), mask (bit i: fails ``letters[i]``), n, good
    and toxic, one row or more for a part and mask; other columns are not read.
    A part gets ``len(letters)! * len(letters)`` rows, zeros included; an empty
    table gives none. Columns are those of ``SCHEMA``.
    """
    summed = counts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(letters)
        for batch in batches:
            names, entries = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(names), PARTS_AT_ONCE):
                yield _tables(names[i : i + PARTS_AT_ONCE], entries[i : i + PARTS_AT_ONCE], orders)

    return parts.mapInArrow(worked, SCHEMA)


def op11_filter_interaction(spark: SparkSession, folder: str) -> DataFrame:
    """All orders of the five filters over every document, by source."""
    return audit(masks(table(spark, folder, "documents"), table(spark, folder, "labels")))


ORACLE_OP11 = r"""
WITH base AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
flags AS (
    SELECT doc_id, part,
           [len(w) < 50,
            100 * len(list_distinct(w)) < 65 * len(w),
            100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
            regexp_matches(t, '[#$%&*|]'),
            coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails
    FROM base
),
marks AS (
    SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic
    FROM labels GROUP BY doc_id
),
cells AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM flags LEFT JOIN marks USING (doc_id) GROUP BY part, fails
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 3, 4, 5]) AS bit),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS o
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
gone AS (
    SELECT part, fails, n, good, toxic, o,
           list_min([CASE WHEN fails[i] THEN strpos(o, chr(64 + i)) ELSE 6 END FOR i IN [1, 2, 3, 4, 5]]) AS s
    FROM cells, orders
),
steps AS (
    SELECT part, o AS filter_order, bit AS step, substr(o, bit, 1) AS letter,
           coalesce(sum(n) FILTER (s > bit), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (s = bit), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (s < bit AND fails[ascii(substr(o, bit, 1)) - 64]), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (fails[ascii(substr(o, bit, 1)) - 64] AND fails[1]::INT + fails[2]::INT + fails[3]::INT + fails[4]::INT + fails[5]::INT = 1), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (s = bit), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (s = bit), 0)::BIGINT AS toxic_lost
    FROM gone, letters
    GROUP BY part, o, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""
