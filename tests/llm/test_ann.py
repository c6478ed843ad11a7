"""Anisotropic quantisation: recall, ties, vectors that take no part."""

from __future__ import annotations

import numpy as np

from paperlake.llm import anisotropic_ann as A


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], d[j]) for j in order]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 700)
    monkeypatch.setattr(A, "QUERIES", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    x[500:900] = x[500]  # a large group of equal vectors
    x = x.astype(np.float32).astype(np.float64)
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in A.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(ids, x, range(0, 3000, 100))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    for q, rows in got.items():
        assert sorted(rows) == list(range(1, 11))
        for v, s in rows.values():
            assert s == np.sqrt(((x[v] - x[q]) ** 2).sum())
    assert [v for v, _ in (got[500][i] for i in range(1, 11))] == list(range(501, 511))


def test_anisotropic_loss_lowers_the_parallel_error():
    rng = np.random.default_rng(5)
    x = A.extend(rng.normal(size=(2000, 15)))
    q = A.train(x, threshold=0.6)
    codes = q.assign(x)
    plain = A.Quantiser(q.centres, 1.0).assign(x)

    def parallel(c):
        back = np.take_along_axis(q.centres[None], c[:, :, None, None].astype(int), 2)[:, :, 0].reshape(x.shape)
        return ((((x - back) * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2).mean()

    assert parallel(codes) < parallel(plain)


def test_huge_vectors_spoil_nothing(spark):
    """Finite components take part, whatever their size; the few that dwarf the rest, queries among them, are measured exactly."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(900, 12))
    x[7] *= 1e200
    x[8] *= 1e160
    x[300] *= 1e180  # a query
    x[450] *= 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in A.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids = np.arange(900)
    hits = 0
    for q in range(0, 900, 100):
        d = A.norms(x - x[q])
        want = [i for i in np.lexsort((ids, d)) if i != q][:10]
        assert [r for r, *_ in sorted(got[q])] == list(range(1, 11)) and all(s == d[i] for _, i, s in got[q])
        hits += len({i for _, i, _ in got[q]} & set(want))
    assert hits >= 0.9 * 90
    assert len({i for _, i, _ in got[300]}) == 10 and all(np.isfinite(s) for _, _, s in got[300])


def test_norms_beyond_the_range_of_squares():
    x = np.array([[3e200, 4e200], [3e-200, 4e-200], [3.0, 4.0], [0.0, 0.0]])
    assert np.allclose(A.norms(x), [5e200, 5e-200, 5.0, 0.0], rtol=1e-12, atol=0)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in A.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5), (0, 2, 5), (0, 3, 100), (100, 1, 5), (100, 2, 5), (100, 3, 0)]
    assert A.nearest(df.where("false")).count() == 0
