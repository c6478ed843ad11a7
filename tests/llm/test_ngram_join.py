"""N-gram join, components and class ids against brute force."""

from __future__ import annotations

import random

import numpy as np

from paperlake.llm import ngram_join as N
from paperlake.llm.components import components


def sets_of(text):
    w = (text or "").split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def make(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
    return " ".join(w)


def corpus():
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    texts = [make(rng, words, rng.randint(1, 120)) for _ in range(60)]
    base = make(rng, words, 200)
    texts += [near(rng, base, rng.randint(0, 5)) for _ in range(400)]  # one large group, more than a block
    texts += [texts[3]] * 5 + ["", None, "  ", "one", "one", "one two", base]
    return list(enumerate(texts))


def brute(rows):
    s = {i: sets_of(t) for i, t in rows}
    links, parent = {i: 0 for i in s}, {i: i for i in s}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(s)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return links, {i: root(i) for i in s}


def test_links_and_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links, groups = brute(rows)
    got = {r.doc_id: r for r in N.with_ids(df).collect()}
    assert len(got) == len(rows)
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.group_id for i, r in got.items()} == groups
    kept = N.keep_one(df)
    words = [r for r in kept.collect() if (r.text or "").split()]
    assert sorted(groups[r.doc_id] for r in words) == sorted({g for i, g in groups.items() if (dict(rows)[i] or "").split()})
    assert kept.columns == df.columns


def test_pruning_keeps_every_pair_at_the_threshold():
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(60):
        common = rng.integers(0, 2**63, 160, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 20, dtype=np.uint64)])) for _ in range(2))
        sig = N.signatures([a, b])
        lost += not N.links(sig[:1], sig[1:], [a], [b])[0, 0]
    assert lost == 0
    least = N.least_matches(0.8, 1e-7)
    assert list(least) == sorted(least) and least[-1] > 64


def test_odd_rows(spark, odd_docs, no_docs):
    got = N.with_ids(odd_docs).collect()
    assert len(got) == odd_docs.count()
    same = [r for r in got if r.doc_id in (None, 1)]
    assert {r.n_links for r in same} == {2}
    assert N.with_ids(no_docs).count() == 0
    assert N.keep_one(no_docs).count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)] + [(200, i) for i in range(201, 260)]
    got = {r.id: r.component for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 260)} == {200}
