"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to the cell of ``FUNCTIONS`` Gaussian
projections, cut into steps of a width that follows the distance of neighbours in
a bounded sample. A query visits, in each table, the ``PROBES`` cells of least
squared distance between the query and the borders to be crossed, the order
of estimated success. All tables' candidates are merged and ranked by exact
distance in double precision.

A query is settled once it has ``KEPT`` ids and the visited cells hold a vector as
far away as the last of them with a probability of ``SURE``, which follows from the
Gaussian projections. All others go on to cells ``GROWTH`` times as wide, up to
``LEVELS`` times, and what is still open then is compared with every vector of its
length. Only an id with several different vectors may still list fewer than there are,
as its own rows can fill the ``KEPT`` places.

Equal vectors are indexed once, with their ``KEPT`` least ids, which is all that a
list of ten can show. Full cells are cut into blocks on both sides, so no task
holds more than a block of vectors and a block of queries; the pairs are compared
inside the tasks and only each query's nearest leave them.
"""

from __future__ import annotations

from itertools import product
from math import erf

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slickwatch.llm.common import table
from slickwatch.session import staged

TABLES, FUNCTIONS, PROBES, STEP = 6, 4, 45, 1.1
NEAREST, KEPT = 10, 11
LEVELS, GROWTH, SURE = 3, 4.0, 0.95
BLOCK, QUERY_BLOCK = 4096, 512
SAMPLE, SEED = 2000, 20


class Hashes:
    """Projections of all tables for vectors of one length."""

    def __init__(self, size: int, width: float):
        rng = np.random.default_rng([SEED, size])
        self.width = width
        self.lines = rng.normal(size=(size, TABLES * FUNCTIONS))
        self.shift = rng.uniform(0, 1, TABLES * FUNCTIONS)
        self.moves = np.array(list(product((0, -1, 1), repeat=FUNCTIONS)), np.int64)
        self.factors = np.random.default_rng([SEED, 1]).integers(1, 1 << 62, FUNCTIONS) | 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """Place of each vector on each line, in steps: (vectors, tables, functions)."""
        return (x @ self.lines / self.width + self.shift).reshape(len(x), TABLES, FUNCTIONS)

    def key(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.factors).sum(-1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Key of each vector's cell in each table."""
        return self.key(np.floor(self.places(x)).astype(np.int64))

    def probes(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Keys of the cells that each vector visits in each table, best first."""
        place = self.places(x)
        cell = np.floor(place).astype(np.int64)
        inside = (place - cell)[:, :, None, :]
        border = np.where(self.moves < 0, inside, 1 - inside)
        cost = np.where(self.moves == 0, 0.0, border**2).sum(-1)
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
        return self.key(cell[:, :, None, :] + self.moves[best])

    def covered(self, x: np.ndarray, far: np.ndarray, probes: int) -> np.ndarray:
        """Probability that a vector at distance ``far`` of each query lies in a cell the query visits."""
        place = self.places(x)
        inside = place - np.floor(place)
        border = np.where(self.moves < 0, inside[:, :, None, :], 1 - inside[:, :, None, :])
        cost = np.where(self.moves == 0, 0.0, border**2).sum(-1)
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
        edges = np.arange(-1, 3) - inside[..., None]
        below = _normal(edges / np.maximum(far / self.width, 1e-12)[:, None, None, None])
        step = np.diff(below, axis=3)  # of moves -1, 0, 1 on each line
        each = np.ones(cost.shape)
        for k in range(FUNCTIONS):
            each *= step[:, :, k][:, :, self.moves[:, k] + 1]
        return 1 - np.prod(1 - np.take_along_axis(each, best, 2).sum(2), axis=1)


def _normal(x: np.ndarray) -> np.ndarray:
    """Distribution function of the standard normal."""
    return (1 + np.vectorize(erf, otypes=[float])(x / np.sqrt(2))) / 2


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).filter("vec_id IS NOT NULL").filter(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.withColumn("v", F.transform("v", lambda x: x + 0.0)).distinct()


def typical(distinct: DataFrame) -> dict[int, float]:
    """Median distance of the tenth neighbour by vector length, in a bounded sample of least hash."""
    sizes = [r[0] for r in distinct.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(100).collect()]
    rows = distinct.orderBy(F.xxhash64("v"), "rep").limit(SAMPLE).select("v").collect()
    out = {}
    for size in sizes:
        x = np.array([r.v for r in rows if len(r.v) == size])
        if len(x) < 2:
            out[size] = 1.0
            continue
        square = (x**2).sum(1)
        far = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0))
        out[size] = float(np.median(np.sort(far, 1)[:, min(NEAREST, len(x) - 1)])) or 1.0
    return out


def _arrays(column) -> list[np.ndarray]:
    """Vectors of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(pa.compute.list_value_length(column).to_pylist())])
    return [values[i:j] for i, j in zip(ends, ends[1:])]


def _keyed(widths: dict[int, float], probes: int, wider: float):
    """(rep, v) to one row for each table (probes 0: its own cell) or probe; cells ``wider`` times as wide."""

    def run(batches):
        made: dict[int, Hashes] = {}
        for batch in batches:
            vectors = _arrays(batch.column(1))
            for size in {len(v) for v in vectors}:
                hashes = made.setdefault(size, Hashes(size, widths.get(size, 1.0) * STEP * wider))
                at = np.array([k for k, v in enumerate(vectors) if len(v) == size])
                for i in range(0, len(at), 512):
                    part = at[i : i + 512]
                    x = np.array([vectors[k] for k in part])
                    keys = hashes.probes(x, probes) if probes else hashes.cells(x)[:, :, None]
                    row = np.repeat(part, keys[0].size)
                    tables = np.tile(np.repeat(np.arange(TABLES), keys.shape[2]), len(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tables, pa.int32()), pa.array(keys.reshape(-1)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                        ["t", "cell", "rep", "v"],
                    )

    return run


def _unsettled(widths: dict[int, float], probes: int, wider: float):
    """(rep, v, n, far) to (rep, v) of the queries with too few ids, or a last one farther than the visited cells reach."""

    def run(batches):
        made: dict[int, Hashes] = {}
        for batch in batches:
            vectors, n = _arrays(batch.column(1)), batch.column(2).to_numpy()
            far, stay = batch.column(3).to_numpy(zero_copy_only=False), n < KEPT
            for size in {len(v) for v in vectors}:
                hashes = made.setdefault(size, Hashes(size, widths.get(size, 1.0) * STEP * wider))
                at = np.array([k for k, v in enumerate(vectors) if len(v) == size and not stay[k]], np.int64)
                for i in range(0, len(at), 512):
                    part = at[i : i + 512]
                    stay[part] = hashes.covered(np.array([vectors[k] for k in part]), far[part], probes) < SURE
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["rep", "v"]).filter(pa.array(stay))

    return run


def _nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """The nearest vectors of a block (right) to each query of a block (left), exact distances."""
    kind = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
    q, v = _arrays(left["v"]), _arrays(right["v"])
    queries, reps = left["rep"].to_numpy(), right["rep"].to_numpy()
    out = ([], [], [])
    for size in {len(x) for x in q} & {len(x) for x in v}:
        a, b = ([k for k, x in enumerate(y) if len(x) == size] for y in (q, v))
        x, y = np.array([q[k] for k in a]), np.array([v[k] for k in b])
        near = (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T
        for i, row in enumerate(near):
            edge = np.partition(row, KEPT - 1)[KEPT - 1] if len(row) > KEPT else np.inf
            # Room for the rounding of the expanded square; the measure itself is computed next.
            pick = np.flatnonzero(row <= edge + 1e-9 * (1 + (x[i] ** 2).sum())) if len(row) > KEPT else np.arange(len(row))
            exact = np.sqrt(((y[pick] - x[i]) ** 2).sum(1))
            ids = reps[np.array(b)[pick]]
            best = np.lexsort((ids, exact))[:KEPT]
            out[0].extend([queries[a[i]]] * len(best))
            out[1].extend(ids[best].tolist())
            out[2].extend(exact[best].tolist())
    return pa.table([pa.array(x, k.type) for x, k in zip(out, kind)], schema=kind)


def _compared(index: DataFrame, visits: DataFrame) -> DataFrame:
    """query, rep, score: the nearest vectors of ``index`` to each of ``visits`` in the cells both have, by block."""
    cells = index.groupBy("t", "cell").agg(F.count("*").alias("n"))
    cells = cells.join(visits.groupBy("t", "cell").agg(F.count("*").alias("m")), ["t", "cell"])
    cells = staged(cells.select("t", "cell", F.ceil(F.col("n") / BLOCK).alias("n"), F.ceil(F.col("m") / QUERY_BLOCK).alias("m")), "cells")
    each = F.sequence(F.lit(0).cast("long"), F.col("m") - 1)
    right = index.join(cells, ["t", "cell"]).withColumn("b", F.pmod(F.xxhash64("rep"), "n")).withColumn("c", F.explode(each))
    each = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    left = visits.join(cells, ["t", "cell"]).withColumn("c", F.pmod(F.xxhash64("rep"), "m")).withColumn("b", F.explode(each))
    keys, columns = ["t", "cell", "b", "c"], ["t", "cell", "b", "c", "rep", "v"]
    return left.select(*columns).groupBy(*keys).cogroup(right.select(*columns).groupBy(*keys)).applyInArrow(
        _nearest, "query long, rep long, score double"
    )


def _ids(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """query, score, vec_id: the ``KEPT`` nearest ids of each query."""
    found = found.groupBy("query", "rep").agg(F.min("score").alias("score"))
    found = found.join(distinct.select("rep", F.col("ids")[0].alias("least"), "ids"), "rep")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "least"))
    found = found.withColumn("k", place).filter(F.col("k") <= KEPT).select("query", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("k", place).filter(F.col("k") <= KEPT).drop("k")


def neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` found for each query, nearest first, ties to the smaller id.

    ``vectors`` and ``queries`` have vec_id and embedding; a query's own id is no
    candidate. Vectors null, zero, or holding null or non-finite components, and null
    ids, take no part; rows that repeat count once; an id with two vectors counts
    with each. Vectors of different lengths are never compared. ``nearest`` is
    at most ``KEPT`` - 1. Other columns are not read; empty in, empty out.
    """
    if nearest >= KEPT:
        raise ValueError(f"at most {KEPT - 1} neighbours")
    rows = staged(usable(vectors), "vectors")
    order = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= KEPT)
    same = staged(members.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "distinct")
    # Two vectors may share an id; the content tells them apart.
    distinct = same.select(F.xxhash64("v", "rep").alias("rep"), "v", "ids")
    asked = usable(queries).select("vec_id", "v")
    widths = typical(distinct)
    asked = asked.withColumn("query", F.xxhash64("v"))
    asking = asked.groupBy("query", "v").agg(F.min("vec_id").alias("_")).select(F.col("query").alias("rep"), "v")
    schema = "t int, cell long, rep long, v array<double>"
    open_, found = staged(asking, "asking"), None
    for level in range(LEVELS + 1):
        wider = GROWTH**level
        if level < LEVELS:
            index = staged(distinct.select("rep", "v").mapInArrow(_keyed(widths, 0, wider), schema), "index")
            visits = staged(open_.mapInArrow(_keyed(widths, probes, wider), schema), "visits")
        else:
            whole = (F.lit(0).alias("t"), F.size("v").cast("long").alias("cell"), "rep", "v")
            index, visits = distinct.select(*whole), open_.select(*whole)
        new = staged(_compared(index, visits), "found")
        found = new if found is None else found.unionByName(new)
        if level == LEVELS:
            break
        reach = _ids(found, distinct).groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("far"))
        rows = open_.join(reach.withColumnRenamed("query", "rep"), "rep", "left").select("rep", "v", F.coalesce("n", F.lit(0)).alias("n"), "far")
        open_ = staged(rows.mapInArrow(_unsettled(widths, probes, wider), "rep long, v array<double>"), "open")
        if open_.isEmpty():
            break
    found = _ids(found, distinct)
    pairs = asked.select(F.col("vec_id").alias("query_id"), "query").join(found, "query").filter("query_id <> vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", place).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest found for each vector whose id 100 divides, against all vectors."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return neighbours(vectors, vectors.filter("vec_id % 100 = 0"))
