"""Suffix arrays, prefixes, and removed bytes against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from paperlake.llm import suffix_dedup as D


def brute(rows):
    n, starts = Counter(), {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        starts[k] = [b[i : i + 200] for i in range(len(b) - 199)]
        n.update(starts[k])
    out = []
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s, w in enumerate(starts[k]):
            if n[w] > 1:
                gone[s : s + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.digest(df).collect()), key=str)


def corpus():
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abcdefgh ñü.\n") for _ in range(n))
    passage, base = say(330), say(900)
    rows = [(i, say(rng.randint(0, 700))) for i in range(25)]
    rows += [(100 + i, say(rng.randint(0, 300)) + passage[rng.randint(0, 100) :] + say(rng.randint(0, 300))) for i in range(25)]
    rows += [(200 + i, base[: rng.randint(250, 900)] + rng.choice("xyz") + base[rng.randint(0, 700) :]) for i in range(25)]
    rows += [(300, "ab" * 400), (301, "a" * 450), (302, passage[:199]), (303, say(200) * 3), (304, None), (305, ""), (1, rows[1][1]), (None, base)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)


def test_spread_anchors_are_merged_across_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "HOT", 6)
    monkeypatch.setattr(D, "SHARD", 10)
    rows = corpus()
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(40):
        d = bytes(rng.choices(b"ab", k=rng.randint(1, 200))) + b"abc" * rng.randint(0, 60)
        a = np.frombuffer(d, np.uint8)
        order = D.suffix_order(a)
        assert order.tolist() == sorted(range(len(d)), key=lambda i: d[i:])
        shared = D.common_prefixes(a, order, 50, lanes=rng.choice([1, 7, 64]))
        for r in range(1, len(order)):
            x, y = d[order[r - 1] :], d[order[r] :]
            k = next((i for i in range(min(len(x), len(y), 50)) if x[i] != y[i]), min(len(x), len(y), 50))
            assert shared[r] == k


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").where("length(text) < 10000 or text is null").collect()]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert D.digest(no_docs).count() == 0
    long = [r for r in D.digest(odd_docs).collect() if r.doc_id == 4][0]
    assert long.n_removed == long.n_bytes
