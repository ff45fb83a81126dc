"""Embedding whitening against NumPy's eigensolver and whole-number arithmetic."""

import math

import numpy as np
import pyarrow as pa

from slickwatch.llm import whitening

KIND = "vec_id long, embedding array<float>, deviation string, whitened int, _whitening int"


def plain(rows):
    """n, S, V and exact deviations of the usable vectors, by hand."""
    good = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in good], np.int64)
    n, s = len(x), x.sum(0)
    y = x - x.mean(0)
    return [i for i, _ in good], x, n, s, y.T @ y / n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]


def agrees(found, rows, names=("deviation", "whitened")):
    ids, x, n, s, v, deviation = plain(rows)
    values, parts = np.linalg.eigh(v)
    values, parts = values[::-1], parts[:, ::-1]
    k = len(found[0][names[1]])
    assert [(r["vec_id"], r[names[0]]) for r in found] == list(zip(ids, deviation))
    w = np.array([r[names[1]] for r in found])
    want = (x - s / n) @ parts[:, :k] / np.sqrt(values[:k])
    signs = np.sign((w * want).sum(0))
    assert np.allclose(w, want * signs, atol=1e-7)
    assert np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-9
    return values


def test_against_numpy_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), "d", 1, 2) for i, v in enumerate(rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + 30)]
    rows += [(None, rows[3][1], None, None, None), (5, rows[5][1], "r", 0, 0), (5, rows[5][1], "r", 0, 0)]
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] + [1.0] * 11), (904, [1.0] * 11 + [float("inf")]), (905, [1.0] * 12 + [2.0]), (906, [-float("inf")] * 12)]
    df = spark.createDataFrame(rows + [(*o, "o", 0, 0) for o in odd], KIND)
    model = whitening.fitted(df)
    assert model.n == 403 and len(model.values) == 8 and model.identity_error < 1e-10
    out = whitening.whitened(df, model)
    assert out.columns == ["vec_id", "embedding", "deviation", "whitened", "_whitening", "deviation_", "whitened_"]
    found = sorted(out.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    values = agrees(found, rows, ("deviation_", "whitened_"))
    assert np.allclose(model.values, values[:8], rtol=1e-11) and np.isclose(model.trace, values.sum(), rtol=1e-12)
    assert {r.deviation for r in found} == {"d", "r", None}


def test_empty_and_flat_tables(spark):
    for rows in ([], [(1, None)], [(1, []), (2, [float("nan")])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert whitening.fitted(df) is None and whitening.whitened(df, None).count() == 0
    df = spark.createDataFrame([(1, [2.0, 3.0])] * 3, "vec_id long, embedding array<float>")
    model = whitening.fitted(df)  # no variance, so no component
    assert len(model.values) == 0 and [(r.deviation, r.whitened) for r in whitening.whitened(df, model).collect()] == [(0, [])] * 3


def test_rank_below_dimension(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [a, 2 * a, b, 7.0, a]) for i, (a, b) in enumerate((rng.integers(-9, 9, (60, 2)) / 4).tolist())]
    model = whitening.fitted(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(model.values) == 2 and model.identity_error < 1e-12
    assert np.isclose(model.values.sum(), model.trace, rtol=1e-12)


def test_factor_and_rotations():
    rng = np.random.default_rng(2)
    for size, rank in ((1, 1), (6, 6), (30, 30), (30, 4)):
        a = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-2, 3, (size, 1))
        v = a @ a.T
        factor = whitening.cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v, rtol=1e-9, atol=1e-9 * v.max())
        assert all(np.count_nonzero(np.abs(factor[:, k:]).max(1)) <= size - k for k in range(rank))  # triangular up to the order of its rows
        values, parts = whitening.jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9, atol=1e-12 * v.max())
        assert np.allclose(parts.T @ parts, np.eye(rank), atol=1e-12)
        assert np.abs(v @ parts - parts * values).max() < 1e-11 * v.max()
    values, parts = whitening.jacobi(np.eye(4) * 3.0)  # ties
    assert np.allclose(values, 9) and np.allclose(np.abs(parts), np.eye(4))


def test_whole_numbers_at_any_size():
    rng = np.random.default_rng(3)
    for most in (100, 1 << 27, 1 << 50):
        y = rng.integers(-most, most, (300, 3))
        assert (whitening._product(y) == y.astype(object).T @ y.astype(object)).all()
    x = np.array([[1 << 40, 5], [3, 4]], np.int64)
    model = whitening.Whitening(1 << 40, [(1 << 80) + 7, 9], np.zeros(0), np.zeros((2, 0)), 1.0)
    assert whitening._deviations(x[:1], model) == [None]
    small = whitening.Whitening(1 << 33, [3 << 33, (4 << 33) + 5], np.zeros(0), np.zeros((2, 0)), 1.0)
    assert whitening._deviations(x[1:], small) == [25]
    assert whitening.integers(np.array([1e300, -1e300, -0.0001])).tolist() == [(1 << 50) + 100000, 100000 - (1 << 50), 99999]
    rows = pa.array([[1.0, 2.0], None, [1.0], [None, 2.0], [3.0, -1.0]], pa.list_(pa.float32()))[1:]
    x, where = whitening.matrix(rows, 2)
    assert where.tolist() == [3] and x.tolist() == [[103072, 98976]]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    df = whitening.op13_whitening(spark, folder)
    rows = df.orderBy("vec_id", "component").collect()
    table = [tuple(r)[:2] for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()]
    assert len(rows) == 8 * len(table) and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = [{"vec_id": rows[i].vec_id, "deviation": rows[i].deviation, "whitened": [r.whitened for r in rows[i : i + 8]]} for i in range(0, len(rows), 8)]
    values = agrees(found, table)
    assert np.allclose([r.explained for r in rows[:8]], values[:8] / values.sum(), rtol=1e-10)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-4 and {r.n for r in rows} == {len(table)}
