"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in 3 bits have no middle at a whole number of
flips from both. So each fingerprint is hashed four times, each time with one of
four 16-bit blocks erased: some erasure leaves at most two differing bits, and
two such words meet in a variant at one flip from either. Every fingerprint
emits the 49 variants of each erasure (196 rows) and the shuffle runs on the
variants.

Fingerprints that share a variant (a bucket) differ in at most two kept bits, and
in the 16 bits of the erased block. They are verified without pairing a bucket
with itself: its distinct block values, at most 2^16, are marked on a bitmap and
flooded along the flips that keep two of them within 3 bits in all,

* one flip of the block in any bucket (all who share a value are linked as well);
* three flips among the unflipped, whose kept bits agree.

Each fingerprint then gets at most one link in each case: to the least of its block
value, and that one to a neighbour from which the flood came. So a bucket gives no
more links than it has rows, and every link is within 3 bits. Every pair within 3
bits falls under one of the two cases. Copies share a fingerprint, which counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwatch.llm.common import annotated, components, rows_named, table
from slickwatch.session import staged

BLOCKS, BLOCK_BITS = 4, 16
WORDS, SEED = 3, 42


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of the shingles of one text, unsigned; 0 if it has no word."""
    parts = text.lower().split()  # bytes: A-Z only, and the six ASCII separators
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) < words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(parts) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], SEED) for i, j in zip(starts, ends[words - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        block = np.array(hashes[i : i + 65536], np.uint64)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    prints = [fingerprint(t.encode()) if t else 0 for t in texts.to_pylist()]
    return pa.array(np.array(prints, np.uint64).view(np.int64))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _masks(block: int) -> tuple[list[int], list[int]]:
    """Bits of a block and the bits outside it."""
    inside = range(block * BLOCK_BITS, (block + 1) * BLOCK_BITS)
    return [1 << i for i in inside], [1 << i for i in range(64) if i not in inside]


def variants(prints: DataFrame) -> DataFrame:
    """block, near, flip, fp: the ball of one flip around ``fp`` with each block erased."""
    rows = []
    for block in range(BLOCKS):
        inside, outside = _masks(block)
        for flip in [0, *outside]:
            rows.append(
                F.struct(
                    F.lit(block).cast("tinyint").alias("block"),
                    F.lit(_signed(sum(outside))).alias("keep"),
                    F.lit(_signed(flip)).alias("flip"),
                )
            )
    each = prints.select("fp", F.explode(F.array(*rows)).alias("v"))
    near = F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip"))
    return each.select(F.col("v.block").alias("block"), near.alias("near"), (F.col("v.flip") == 0).alias("own"), "fp")


def _met(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows that are not alone under their keys."""
    order = Window.partitionBy(*keys).orderBy("fp")
    both = rows.withColumn("_b", F.lag("fp").over(order)).withColumn("_a", F.lead("fp").over(order))
    return both.filter("_b IS NOT NULL OR _a IS NOT NULL").drop("_b", "_a")


def _flips(bits: int) -> np.ndarray:
    """All 16-bit words of at most ``bits`` ones, but zero."""
    return np.array([sum(1 << i for i in c) for k in range(1, bits + 1) for c in combinations(range(BLOCK_BITS), k)], np.int64)


def flooded(values: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """For each of the distinct block values, the place of the one it was reached from by a flip; -1 for the first of a set."""
    at = np.full(1 << BLOCK_BITS, -1, np.int32)
    at[values] = np.arange(len(values))
    source, open_ = np.full(len(values), -1, np.int64), np.ones(len(values), bool)
    for start in range(len(values)):
        if not open_[start]:
            continue
        front, open_[start] = np.array([start]), False
        while len(front):
            met = at[values[front][:, None] ^ flips]
            row, col = np.nonzero((met >= 0) & open_[met])
            reached, first = np.unique(met[row, col], return_index=True)
            source[reached] = front[row[first]]
            open_[reached] = False
            front = reached
    return source


def _linked(fp: np.ndarray, value: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the members of one bucket, whose block values meet by ``flips``."""
    distinct, at = np.unique(value, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, at, fp)
    source = flooded(distinct, flips)
    same, led = fp != least[at], source >= 0
    return np.concatenate([fp[same], least[led]]), np.concatenate([least[at][same], least[source[led]]])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets whose rows (block, near, own, fp) come together; only an open bucket is kept between batches."""
    one, three = _flips(1), _flips(3)
    held: list[np.ndarray] | None = None

    def closed(columns: list[np.ndarray]) -> pa.RecordBatch:
        block, near, own, fp = columns
        starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (near[1:] != near[:-1])]))
        ends = np.append(starts[1:], len(fp))
        value = (fp.view(np.uint64) >> (block.astype(np.uint64) * np.uint64(BLOCK_BITS))).astype(np.int64) & (1 << BLOCK_BITS) - 1
        two = ends - starts == 2
        i = starts[two]
        apart = np.bitwise_count(value[i] ^ value[i + 1])
        near_two = (apart <= 1) | (own[i] & own[i + 1] & (apart <= 3))
        i = i[near_two]
        a, b = [np.maximum(fp[i], fp[i + 1])], [np.minimum(fp[i], fp[i + 1])]
        for s, e in zip(starts[~two].tolist(), ends[~two].tolist()):
            mine = own[s:e]
            for rows, flips in ((slice(s, e), one), (s + np.flatnonzero(mine), three)):
                if len(fp[rows]) > 1:
                    more = _linked(fp[rows], value[rows], flips)
                    a.append(more[0])
                    b.append(more[1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = int(np.argmax(last))  # buckets come together, so the first row of the last one
        held = [x[cut:] for x in rows]
        if cut:
            yield closed([x[:cut] for x in rows])
    if held is not None:
        yield closed(held)


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all fingerprints within 3 bits, and no others; ``prints`` has distinct fp."""
    met = _met(variants(prints), "block", "near")
    ordered = met.select(F.col("block").cast("int").alias("block"), "near", "own", "fp").sortWithinPartitions("block", "near")
    return ordered.mapInArrow(_bucket_links, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text), fp (signed), component_id for each row of ``docs``.

    Null text counts as empty; a text without words has fingerprint zero, which
    links like any other. Rows that repeat each get a row. component_id is the
    smallest doc_id reachable (null if all are null). Empty in, empty out; other
    columns are not read.
    """
    rows = docs.select("doc_id", "text")
    rows = annotated(rows, "fp", _fingerprints, "long", "text")
    prints = staged(rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "fp"), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest doc_id; all columns.

    Ties (rows of one id, or a group without ids) go to the least digest.
    """
    groups = near_groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")
    best = groups.groupBy("root").agg(F.min(order).alias("x")).select("x.doc_id", "x.digest")
    again = groups.select("doc_id", "digest").join(
        best.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d")),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_d")),
        "left_semi",
    )
    return rows_named(docs, again)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
