"""Non-negative PU learning: held-out accuracy, risk, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from paperlake.llm import toxicity as X


def corpus(spark, n=900):
    rng = random.Random(6)
    plain = ["word%d" % i for i in range(300)]
    bad = ["vileone", "vileous", "grimful", "grimish", "nastier"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), {i: i % 6 == 0 for i in range(n)}


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    rows = X.toxicity(docs, labels).collect()
    assert len(rows) == 900
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    out = [r for r in rows if r.held_out]
    hit = [r.predicted for r in out if truth[r.doc_id]]
    false = [r.predicted for r in out if not truth[r.doc_id]]
    assert sum(hit) / len(hit) > 0.85 and sum(false) / len(false) < 0.02
    kept = X.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and 700 < kept.count() < 790


def test_sample_is_bounded_by_rows_and_words(spark, monkeypatch):
    """One id many times, with one text and with many, and texts of many words."""
    rows = [(0, f"bad text {i}") for i in range(300)] + [(0, "the same")] * 300 + [(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(1, 40)]
    seen = []
    monkeypatch.setattr(X, "fit_pu", lambda pos, unl, prior: seen.append((pos, unl, prior)))
    X.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, toxic int"), max_positive=5, max_unlabelled=7, max_words=50)
    ((pos, unl, prior),) = seen
    assert len(pos) == 5 and len(unl) == 7
    assert max(map(len, pos + unl)) <= 50 * (1 + len(X.PREFIXES))


def test_gradient_is_that_of_the_plain_risk():
    """One step from the start goes against a risk gradient that finite differences give."""
    rng = np.random.default_rng(3)
    pos = [np.array([7, 8], np.int32)] * 60
    unl = [np.array([7, 8] if rng.random() < 0.1 else [9, int(rng.integers(20, 30))], np.int32) for _ in range(200)]
    prior = 0.3

    def risk(w, b):
        z = lambda rows: np.array([w[r].sum() for r in rows]) + b
        loss = lambda v: np.logaddexp(0, -v)
        return prior * loss(z(pos)).mean() + max(0.0, loss(-z(unl)).mean() - prior * loss(-z(pos)).mean())

    m = X.fit_pu(pos, unl, prior)
    start = np.zeros(1 << X.HASH_BITS)
    assert risk(m.weights, m.bias) < risk(start, np.log(prior / (1 - prior)))
    one = X.fit_pu(pos, unl, prior, epochs=1, decay=0.0)
    for slot in np.flatnonzero(one.weights):
        up, down = start.copy(), start.copy()
        up[slot] += 1e-5
        down[slot] -= 1e-5
        b = float(np.log(prior / (1 - prior)))
        assert np.sign(risk(up, b) - risk(down, b)) == -np.sign(one.weights[slot])


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels, _ = corpus(spark)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(X.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.fit(docs, labels), X.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_risk_never_goes_far_below_zero():
    rng = np.random.default_rng(1)
    pos = [np.array([5, 6, int(rng.integers(100, 200))], np.int32) for _ in range(40)]
    unl = [np.array([int(rng.integers(100, 200)), int(rng.integers(100, 200))], np.int32) for _ in range(150)] + pos[:30]
    m = X.fit_pu(pos, unl, 0.15)
    z = lambda x: m.weights[x].sum() + m.bias
    assert min(map(z, pos)) > max(map(z, unl[:150]))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, None), (4, 0), (None, 1), (5, 1), (99, 1)], "doc_id long, toxic int")
    rows = X.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert not [r for r in rows if r.doc_id is None][0].held_out
    assert X.toxicity(no_docs, labels).count() == 0
    none = X.toxicity(odd_docs, labels.where("false"))
    assert {r.predicted for r in none.collect()} == {0}
