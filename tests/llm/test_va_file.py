"""VA-file: bounds hold, results equal brute force, copies, ties, odd and huge vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from paperlake.llm import va_file as V


def brute(rows, every=50, k=5):
    """(query, rank, id, score), from all pairs with Python's integers."""
    good = [(i, [min(max(math.floor(256 * x) if abs(256 * x) < math.inf else (1 << 70) * (1 if x > 0 else -1), V.LONG.min), V.LONG.max) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {i: min(x for j, x in good if j == i) for i, _ in good}
    good = [(i, x) for i, x in good if x == least[i]]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        v = least[q]
        scores = [(-min(max(sum(a * b for a, b in zip(v, x, strict=True)), V.LONG.min), V.LONG.max), i) for i, x in good if i != q and len(x) == len(v)]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted(tuple(r) for r in V.exact_top_k(df, **more).collect())


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 9)) * 256)
    x[:, 3] = 7  # a constant dimension
    q = np.floor(rng.normal(size=(70, 9)) * 256)
    codes, low, high = V.build(x)
    at = np.arange(9)[None, :], codes
    assert (low[at] <= x).all() and (x <= high[at]).all()
    seen = 0
    for i, at, lower, upper in V.scan(q, codes, low, high, 5):
        s = x @ q[i]
        assert (lower <= s[at]).all() and (s[at] <= upper).all()
        assert set(np.argsort(-s, kind="stable")[:5]) <= set(at)
        seen += len(at)
    assert seen < 0.05 * 70 * 500


@pytest.mark.parametrize("shape", ["plain", "small blocks", "clustered"])
def test_equals_brute_force(spark, monkeypatch, shape):
    if shape == "small blocks":
        monkeypatch.setattr(V, "BLOCK", 90)
        monkeypatch.setattr(V, "QUERIES", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 7)) * (0.02 if shape == "clustered" else 1)
    x[100:350] = x[100]  # a third are copies
    x[350:400] = x[100] + rng.normal(size=(50, 7)) * 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows) == brute(rows)


def test_few_exact_vectors_are_read_first(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (300, 4)) / 4)]  # many ties
    assert run(spark, rows, first=1) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, -1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]),
        (6, []), (7, [1.0, 2.0, 3.0]), (8, [inf, 0.0]), (100, [1.0, 0.0]), (100, [-1.0, 0.5]), (100, [1.0, 0.0]), (150, []), (100, [-1.0, 0.75]), (300, [1.0, 4.0]), (300, [1.0, 5.0]), (9, [1e300, -1e300]), (10, [-1e17, 3.0]), (200, [1e15, -1e15, 2.5]), (11, [1e15, 1e15, -1.0]), (12, [1e15, 1e15, -2.0]),
    ]
    assert run(spark, rows) == brute(rows)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.exact_top_k(empty).count() == 0
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert run(spark, [(50, [1.0])]) == []


def test_extra_columns(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(150)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wide = plain.selectExpr("*", *[f"cast(null as string) {c}" for c in ("id", "v", "asks", "d", "b", "qb", "salt", "ids", "codes", "r", "floor", "upper", "score", "rank", "query_id")])
    assert sorted(map(tuple, V.exact_top_k(wide).collect())) == sorted(map(tuple, V.exact_top_k(plain).collect())) == brute(rows)
