"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwatch.session import prepare

#: Bytes of text that a vectorised step holds at once; one longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name += "_"
    return name


def annotated(df: DataFrame, name: str, fn: Callable, kind: str, *columns) -> DataFrame:
    """``df`` with a column computed by ``fn`` from Arrow arrays, once for each row.

    The function counts as nondeterministic, so that a later filter on the new
    column does not run it a second time. A name that ``df`` already has fails:
    no column of the caller's is replaced.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the rows already have a column {name}")
    udf = F.arrow_udf(fn, kind).asNondeterministic()
    return df.withColumn(name, udf(*columns))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row's range; 0 for an empty range."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:]), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def rank_digits(column: str, modulus: int, value: int):
    """True where crc32 of the id as text has that remainder: the fold of a row."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == value, F.lit(False))


def checkpoint_folder(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder; a test on one machine gets its own."""
    from slickwatch.session import scratch_folder

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_folder(spark, "checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_named(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``names`` (doc_id, digest of the text) lists, all columns.

    A null id names rows without id. Rows that repeat both give one row. The
    texts are shuffled once.
    """
    n, key, digest, other = (fresh(docs, x) for x in ("n", "id", "digest", "other"))
    listed = names.groupBy(F.col("doc_id").alias(key), F.col("digest").alias(other)).agg(F.count("*").alias(n))
    rows = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    stay = rows.join(listed, (F.col(digest) == F.col(other)) & rows["doc_id"].eqNullSafe(listed[key]))
    rest = [F.first(c).alias(c) for c in docs.columns if c != "doc_id"]
    repeated = stay.filter(F.col(n) > 1).groupBy("doc_id", digest).agg(*rest)
    return stay.filter(F.col(n) == 1).select(*docs.columns).unionByName(repeated.select(*docs.columns))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph with edges (a, b); root is the smallest node reachable.

    Alternates large and small stars until the edges stay the same. The least
    neighbour of a node is an aggregate with map-side combining, joined back, so
    a hub is never one task. Each round is checkpointed; only a count and a hash
    sum of the edges reach the driver.
    """

    def least(pairs: DataFrame, spread) -> DataFrame:
        lows = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return spread(pairs.join(lows.withColumn("m", F.least("a", "m")), "a")).filter("a <> b").distinct()

    def large(pairs: DataFrame) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return least(both, lambda x: x.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small(pairs: DataFrame) -> DataFrame:
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return least(
            down,
            lambda x: x.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(x.select("a", F.col("m").alias("b"))),
        )

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while before != (held := state(now)):
        before = held
        now = checkpointed(small(large(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
