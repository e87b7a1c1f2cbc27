"""Inverted-list vector index against comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import vector_index as VI


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>")


def queries(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "query_id int, vec array<double>")


def brute(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    v = np.array([np.float32(x) for _, x in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q, x in asked:
        score = np.round(v @ (x / np.linalg.norm(x)), 6)
        best = np.lexsort((ids, -score))[:k]
        out[q] = list(zip(ids[best].tolist(), score[best].tolist()))
    return out


def run(spark, rows, asked, k):
    found, seen = VI.search(VI.build(table(spark, rows)), queries(spark, asked), k)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got, {r.query_id: r.candidates for r in seen.collect()}


def same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=2e-6)


@pytest.mark.parametrize("spread", [0.05, 0.5, 10.0])
def test_equals_comparing_all(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    heart = rng.standard_normal((20, 16))
    rows = [(i, heart[i % 20] + spread * rng.standard_normal(16)) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(5)]                      # equal vectors: ties by id
    asked = [(i, heart[i] + 0.1 * rng.standard_normal(16)) for i in range(12)] + [(99, rows[7][1])]
    got, seen = run(spark, rows, asked, 4)
    same(got, brute(rows, asked, 4))
    if spread == 0.05:                                                      # gathered vectors: few are compared
        assert sum(seen.values()) < 0.1 * len(rows) * len(asked)


def test_unusable_vectors_and_small_tables(spark):
    rows = [(1, [1, 0]), (2, [0, 1]), (3, [1, 1])]
    bad = [(4, None), (5, [0, 0]), (6, [1, 2, 3]), (7, [float("nan"), 1])]
    got, _ = run(spark, rows + bad, [(0, [1.0, 0.1])], 5)
    same(got, brute(rows, [(0, np.array([1.0, 0.1]))], 5))
    assert run(spark, bad[:2], [(0, [1.0, 0.0])], 2) == ({}, {})
    assert run(spark, rows, [], 2) == ({}, {})


def test_many_queries_run_in_passes(spark, monkeypatch):
    monkeypatch.setattr(VI, "MAX_QUERIES", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8)) for i in range(300)]
    asked = [(i, rng.standard_normal(8)) for i in range(11)]
    same(run(spark, rows, asked, 3)[0], brute(rows, asked, 3))


def test_bound_holds():
    rng = np.random.default_rng(5)
    q, v, c = (VI.unit(rng.standard_normal((4000, 5))) for _ in range(3))
    a, b, s = (v * c).sum(1), (q * c).sum(1), (q * v).sum(1)
    width = rng.random(4000) * 0.3
    assert (VI.bound(a, a, b) >= s - 1e-12).all()
    assert (VI.bound(np.maximum(a - width, -1), np.minimum(a + width, 1), b) >= s - 1e-12).all()


def test_lists_follow_the_rows(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    from quarry.operators.search import label_centroids
    index = VI.build(emb)
    assert len(index.centres) == int(emb.count() ** 0.5) and index.size.sum() == emb.count()
    seen = VI.search(index, label_centroids(emb), 3)[1].agg(F.sum("candidates"), F.count(F.lit(1))).first()
    assert 0 < seen[0] <= emb.count() * seen[1]
