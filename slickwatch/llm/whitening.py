"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become integers, so sums and centred products are added up exactly, in
any order of tasks and after any repetition of them:

1. *Sums*: rows and sums of each dimension.
2. *Scatter*: products of vectors centred on the rounded mean. What is left of
   the mean is taken off afterwards in whole numbers, so n * n * V is exact.
3. *Factor*: V = L L' by Cholesky with the largest remaining variance as pivot,
   which stops at V's rank. One-sided Jacobi then rotates the columns of L itself
   until they are orthogonal: V is never handed to an eigensolver. Squared column
   norms are the eigenvalues, normalised columns the components.
4. *Check*: the covariance of the whitened vectors, measured over all rows.

Tasks send one row for each pair of dimensions; Spark adds them up, and the driver
gets a matrix of dimension x dimension at any number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slickwatch.llm.common import annotated, fresh, table

# Fixed values of the integer scale.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Scaled entries are kept within these bounds; only magnitudes of over 10^12 reach them.
LARGEST = 1 << 50
#: Variance left of a dimension, as a share of its own, below which it is no pivot.
RANK_TOLERANCE = 1e-13
#: Columns count as orthogonal below this cosine; sweeps end there (ten suffice) or here.
ORTHOGONAL, SWEEPS = 1e-15, 60


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: components in columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = float("nan")

    @property
    def size(self) -> int:
        return len(self.sums)


def integers(flat: np.ndarray) -> np.ndarray:
    """Entries as longs: floor(1024 c) + 100000."""
    return np.clip(np.floor(SCALE * flat.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer matrix of the vectors of ``size`` finite entries, and which rows they are."""
    kind = pa.large_list(pa.float64())
    whole = vectors.cast(kind)
    offsets = whole.offsets.to_numpy()
    flat = whole.values.to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    there = whole.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == size)
    rows = np.flatnonzero(there)
    x = flat[offsets[rows][:, None] + np.arange(size)] if len(rows) else np.zeros((0, size))
    good = np.isfinite(x).all(axis=1)
    return integers(x[good]), rows[good]


def _product(y: np.ndarray) -> np.ndarray:
    """y' y of integers, exact: in doubles where every sum stays below 2^53, else in Python integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < 1 << 53:
        return (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64).astype(object)
    if len(y) > 64:
        half = len(y) // 2
        return _product(y[:half]) + _product(y[half:])
    wide = y.astype(object)
    return wide.T @ wide


def _added(frames: DataFrame, size: int, work) -> dict:
    """Sums over all tasks of what ``work`` makes of their integer matrices: {(i, j): whole number}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, value in work(matrix(batch.column(0), size)[0]).items():
                held[key] = held.get(key, 0) + value
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([str(held[k]) for k in keys])], ["i", "j", "v"]
            )

    parts = frames.mapInArrow(run, "i int, j int, v string")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return {(r.i, r.j): int(r.v) for r in total.collect()}


def cholesky(v: np.ndarray, tolerance: float = RANK_TOLERANCE) -> np.ndarray:
    """L (size x rank) with v = L L', by falling pivots; its rows are in the order of v."""
    size = len(v)
    left, factor, order = v.diagonal().copy(), np.zeros((size, size)), np.arange(size)
    least, rank = tolerance * left, 0
    while rank < size:
        open_ = order[rank:]
        p = rank + int(np.argmax(np.where(left[open_] > least[open_], left[open_], 0)))
        if left[order[p]] <= least[order[p]]:
            break
        order[[rank, p]] = order[[p, rank]]
        pivot, rest = order[rank], order[rank + 1 :]
        root = np.sqrt(left[pivot])
        factor[pivot, rank] = root
        factor[rest, rank] = (v[rest, pivot] - factor[rest, :rank] @ factor[pivot, :rank]) / root
        left[rest] -= factor[rest, rank] ** 2
        rank += 1
    return factor[:, :rank]


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and components (columns) of factor factor', by rotating its columns.

    Equal eigenvalues keep the order of their columns. Of each component, the
    entry of greatest magnitude (the first of several) is positive.
    """
    a = factor.copy()
    rank = a.shape[1]
    for _ in range(SWEEPS):
        still = True
        for p in range(rank - 1):
            for q in range(p + 1, rank):
                alpha, beta, gamma = a[:, p] @ a[:, p], a[:, q] @ a[:, q], a[:, p] @ a[:, q]
                if abs(gamma) <= ORTHOGONAL * np.sqrt(alpha * beta):
                    continue
                still = False
                zeta = (beta - alpha) / (2 * gamma)
                t = np.copysign(1.0, zeta) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * (a[:, p] - t * a[:, q]), c * (a[:, q] + t * a[:, p])
        if still:
            break
    norms = np.sqrt((a**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    parts = a[:, order] / norms[order]
    signs = np.sign(parts[np.abs(parts).argmax(0), np.arange(rank)]) if rank else np.zeros(0)
    return norms[order] ** 2, parts * signs


def fitted(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors of a column, at most ``components`` of V's rank; None if there are none.

    Vectors that are null or hold null or non-finite entries take no part, nor
    do those of another length than the commonest (of several, the longest).
    Repeated rows count each.
    """
    own = vectors.select(F.col(column).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sizes = own.filter(F.col("v").isNotNull() & ~odd & (F.size("v") > 0)).groupBy(F.size("v").alias("d")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not first:
        return None
    size = first[0]["d"]

    def sums(x):
        return {(i, 0): int(t) for i, t in enumerate(x.astype(object).sum(0))} | {(size, 0): len(x)} if len(x) else {}

    found = _added(own, size, sums)
    n = found[size, 0]
    totals = [found[i, 0] for i in range(size)]
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    upper = np.triu_indices(size)

    def products(x):
        p = _product(x - centre)
        return dict(zip(zip(*(k.tolist() for k in upper)), p[upper])) if len(x) else {}

    scatter = _added(own, size, products)
    over = [s - n * int(c) for s, c in zip(totals, centre)]
    v = np.zeros((size, size))
    for (i, j), p in scatter.items():
        v[i, j] = v[j, i] = float(Fraction(n * p - over[i] * over[j], n * n))
    values, parts = jacobi(cholesky(v))
    kept = min(components, len(values))
    model = Whitening(n, totals, values[:kept], parts[:, :kept], float(np.trace(v)))
    return replace(model, identity_error=identity_error(own, model))


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """x - S/n on each component, over the root of its eigenvalue."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % model.n / model.n for s in model.sums])
    return ((x - whole) - rest) @ model.components / np.sqrt(model.values)


def identity_error(own: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; 0 without components.

    Each task adds up its own rows; Spark adds up the tasks. The whitened mean
    is measured too, not taken as zero.
    """
    size, k = model.size, len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = _projected(matrix(batch.column(0), size)[0], model)
            w = np.hstack([w, np.ones((len(w), 1))])
            held += w.T @ w
        i, j = np.indices(held.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x.reshape(-1)) for x in (i, j, held)], ["i", "j", "v"])

    if not k:
        return 0.0
    total = np.zeros((k + 1, k + 1))
    for r in own.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[:k, k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n x - S)^2; None beyond a long."""
    sums = np.array(model.sums, object)
    whole = [s // model.n for s in model.sums]
    most = model.n * (int(np.abs(x - np.array(whole, np.int64)).max(initial=0)) + 1)
    if most * most * max(model.size, 1) < 1 << 63:
        over = np.array([s - w * model.n for s, w in zip(model.sums, whole)], np.int64)
        return ((model.n * (x - np.array(whole, np.int64)) - over) ** 2).sum(1).tolist()
    exact = ((model.n * x.astype(object) - sums) ** 2).sum(1)
    return [int(e) if e < 1 << 63 else None for e in exact]


def _writer(model: Whitening):
    def run(vectors: pa.Array) -> pa.Array:
        x, rows = matrix(vectors, model.size)
        deviation = np.full(len(vectors), None, object)
        deviation[rows] = np.array(_deviations(x, model), object)
        place = np.zeros(len(vectors) + 1, np.int64)
        k = len(model.values)
        place[1:][rows] = k
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(place).astype(np.int32)), pa.array(_projected(x, model).reshape(-1)))
        used = np.zeros(len(vectors), bool)
        used[rows] = True
        return pa.StructArray.from_arrays([pa.array(used), pa.array(deviation, pa.int64()), lists], ["used", "deviation", "whitened"])

    return run


def whitened(vectors: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """The rows whose vector takes part, with columns ``deviation`` and ``whitened`` (one entry a component).

    Names already taken get underscores. Without a model no row takes part.
    Other columns stay, null ids and repeated rows too. ``deviation`` is null
    where it exceeds a long.
    """
    names = []
    for name in ("deviation", "whitened"):
        while name in {c.lower() for c in vectors.columns}:
            name += "_"
        names.append(name)
    if model is None:
        return vectors.withColumn(names[0], F.lit(None).cast("long")).withColumn(names[1], F.lit(None).cast("array<double>")).filter(F.lit(False))
    out = fresh(vectors, "whitening")
    kind = "used boolean, deviation long, whitened array<double>"
    rows = annotated(vectors, out, _writer(model), kind, F.col(column).cast("array<double>")).filter(F.col(out)["used"])
    return rows.select(*vectors.columns, F.col(out)["deviation"].alias(names[0]), F.col(out)["whitened"].alias(names[1]))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable embedding on the first components, one row for each of them."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = fitted(vectors)
    n, error, shares = (model.n, model.identity_error, model.values / model.trace) if model and model.trace else (0, 0.0, [])
    rows = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(s)) for s in shares]).cast("array<double>"), F.col("place") + 1) if len(shares) else F.lit(None).cast("double")
    return rows.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
