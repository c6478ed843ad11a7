"""Temperature mixing: exponents, weights, permutations."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from paperlake.llm import mixing as M


def corpus(spark, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"text {i} " + "w " * (i % 7), s))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def shares(rows):
    c = Counter()
    for r in rows:
        c[r.source] += r.mix_tokens
    total = sum(c.values())
    return {k: v / total for k, v in c.items()}


SIZES = {"big": 3000, "mid": 900, "low": 300}


def test_repetition_limit(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 64)
    df = corpus(spark, SIZES)
    rows = M.mix(df, max_repetition=2.5).collect()
    epochs = {r.source: r.mix_epochs for r in rows}
    assert max(epochs.values()) == pytest.approx(2.5, abs=1e-6) and min(epochs.values()) == pytest.approx(1.0)
    weights = {r.source: r.mix_weight for r in rows}
    assert sum(weights.values()) == pytest.approx(1.0)
    assert shares(rows) == pytest.approx(weights, abs=0.01)
    # w is p to one exponent
    p = shares([r for r in rows if r.mix_epoch == 0 or True and r.mix_epoch == 0])
    a = {s: math.log(weights[s] / weights["big"]) / math.log(p[s] / p["big"]) for s in ("mid", "low")}
    assert a["mid"] == pytest.approx(a["low"], abs=1e-4)
    # nothing is left out, each epoch has a document at most once
    assert {r.doc_id for r in rows} == set(range(4200))
    assert max(Counter((r.doc_id, r.mix_epoch) for r in rows).values()) == 1


def test_target_entropy_and_budget(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 32)
    df = corpus(spark, SIZES)
    rows = M.mix(df, target_entropy=1.0, max_repetition=None, budget_tokens=6_000).collect()
    w = {r.source: r.mix_weight for r in rows}
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(1.0, abs=1e-4)
    assert sum(r.mix_tokens for r in rows) == pytest.approx(6_000, rel=0.03)
    assert shares(rows) == pytest.approx(w, abs=0.02)


def test_broken_epoch_is_a_prefix_of_the_permutation(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 32)
    df = corpus(spark, SIZES)
    rows = [r for r in M.mix(df, max_repetition=1.7).collect() if r.source == "low"]
    tokens, place = Counter(), {}
    every = Counter()
    for r in rows:
        if r.mix_epoch == 0:
            every[r.mix_block] += r.mix_tokens
        else:
            tokens[r.mix_block] += r.mix_tokens
            place[r.mix_block] = r.mix_place
    assert all(tokens[b] == every[b] for b in tokens)  # whole blocks
    assert 0 < len(tokens) < len(every)
    assert sum(tokens.values()) / sum(every.values()) == pytest.approx(0.7, abs=0.06)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = M.mix(odd_docs).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
    assert M.mix(no_docs).count() == 0
    assert M.mix(odd_docs.where("doc_id = 3")).count() == 1
    assert M.mix(odd_docs).drop(*[c for c in M.mix(odd_docs).columns if c.startswith("mix_")]).columns == odd_docs.columns
