"""Nearest neighbours against brute force: exact scores, order, recall, copies, odd rows."""

import numpy as np
import pytest

from slickwatch.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, query int"


def brute(vectors, queries):
    """{query_id: [(vec_id, score)]}, all candidates nearest first."""
    out = {}
    for q, x in queries:
        rows = [(float(np.sqrt(((np.array(v, float) - np.array(x, float)) ** 2).sum())), i) for i, v in vectors if i != q and len(v) == len(x)]
        out[q] = [(i, s) for s, i in sorted(rows)]
    return out


def listed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = [(r.vec_id, r.embedding) for r in rows]
    want = brute(vectors, [v for v in vectors if v[0] % 100 == 0])
    got = listed(neighbours.op8_ann(spark, folder).collect())
    assert set(got) == set(want)
    hits = []
    for q, found in got.items():
        exact = dict(want[q])
        assert len(found) == min(10, len(exact))
        assert all(abs(exact[i] - s) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
        last = want[q][9][1]
        hits.append(sum(s <= last for _, s in found) / 10)
    assert np.mean(hits) >= 0.93


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6)).astype(np.float32).tolist()
    rows = [(k, base[k % 4], 1) for k in range(60)] + [(100 + k, base[k], 1) for k in range(4, 12)]
    odd = [(200, None, 1), (201, [0.0] * 6, 1), (202, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (204, [float("inf")] * 6, 1), (205, [], 1), (None, base[0], 1)]
    two = [(300, [1.0, 2.0], 1), (301, [1.0, 2.5], 1)]
    df = spark.createDataFrame(rows + rows[:5] + odd + two, SCHEMA)
    got = listed(neighbours.neighbours(df, df, probes=81).collect())
    valid = rows + two
    want = brute([r[:2] for r in valid], [r[:2] for r in valid])
    assert set(got) == {q for q, x in want.items() if x}
    for q, found in got.items():
        exact = dict(want[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in found) and q not in dict(found)
        if q < 60:  # at least fourteen copies: the ten smallest other ids, at distance 0
            assert found == want[q][:10]
    assert got[300] == [(301, 0.5)]


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, rng.normal(size=5).astype(np.float32).tolist(), 0) for k in range(300)], SCHEMA)
    whole = listed(neighbours.neighbours(df, df.filter("vec_id % 10 = 0")).collect())
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    assert listed(neighbours.neighbours(df, df.filter("vec_id % 10 = 0")).collect()) == whole


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.neighbours(empty, empty).collect() == []


def test_default_probes_on_small_clustered_and_scaled_vectors(spark):
    """Every query gets its ten, or all there are, whatever the spread around it."""
    rng = np.random.default_rng(11)
    small = [(k, rng.normal(size=16).astype(np.float32).tolist(), 0) for k in range(8)]
    clouds = np.repeat(rng.normal(size=(6, 16)), 60, 0) + rng.normal(size=(360, 16)) * 0.01
    x = np.vstack([clouds, rng.normal(size=(220, 16)), rng.normal(size=(20, 16)) * 4])
    mixed = [(k, v.tolist(), 0) for k, v in enumerate(x.astype(np.float32))]
    for rows in (small, mixed):
        df = spark.createDataFrame(rows, SCHEMA)
        asked = df.filter("vec_id % 5 = 0 OR vec_id >= 580")
        queries = [r[:2] for r in rows if r[0] % 5 == 0 or r[0] >= 580]
        want, got = brute([r[:2] for r in rows], queries), listed(neighbours.neighbours(df, asked).collect())
        assert set(got) == set(want)
        assert all(len(got[q]) == min(10, len(want[q])) for q in want)
        hits = {q: np.mean([s <= want[q][len(got[q]) - 1][1] for _, s in got[q]]) for q in want}
        groups = [range(360), range(360, 580), range(580, 600)] if len(rows) > 8 else [range(8)]
        assert all(np.mean([hits[q] for q in g if q in hits]) >= 0.9 for g in groups)
