"""Spelling variants: hashes of edits, filters without false negatives, pairs and groups against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from paperlake.llm import spelling as S


def near(a, b):
    """Exactly one character inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def groups(counts, ratio=10):
    """Word to (n, form, root, n_near, form_n), comparing all pairs."""
    out, form = {}, {}
    for w, n in counts.items():
        around = [(-counts[v], v) for v in counts if near(w, v)]
        m, best = min(around, default=(0, None))
        form[w] = best if around and -m >= ratio * n else None
        out[w] = [n, form[w], w, len(around), -m if form[w] else None]
    for w in counts:
        end = w
        while form[end]:
            end = form[end]
        out[w][2] = end
    return {w: tuple(v) for w, v in out.items()}


def contract_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def a_vocabulary(seed=4, size=400):
    rng = random.Random(seed)
    letters = "abcdefgéñüßÿÀ"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(size)}
    for w in list(words):
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            words.add(rng.choice([w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]]))
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaab", "b" * 63, "b" * 64, "b" * 65, "b" * 64 + "c", "c" * 3000, "c" * 2999 + "d", "c" * 2999}
    return {w: rng.choice([2, 3, 25, 40, 500, 6000]) for w in words if len(w) >= 7}


def as_rows(df):
    rows = df.collect()
    out = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_hashes_of_edits():
    w, power = "größere", S.powers(20)
    code = lambda x: np.array([ord(c) for c in x], np.uint64)
    whole = lambda x: (code(x) * power[: len(x)]).sum()
    with np.errstate(over="ignore"):
        for i in range(len(w)):
            cut = (code(w[:i]) * power[:i]).sum() + (code(w[i + 1 :]) * power[i + 1 : len(w)]).sum() * S.INVERSE
            assert cut == whole(w[:i] + w[i + 1 :])
            assert whole(w) + (code("z")[0] - code(w)[i]) * power[i] == whole(w[:i] + "z" + w[i + 1 :])


def test_filters_hold_every_word_and_few_others(spark):
    rng = random.Random(7)
    words = list({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(7, 9))) for _ in range(4000)})
    others = ["".join(rng.choice("klmnopqrst") for _ in range(8)) for _ in range(4000)]
    vocab = spark.createDataFrame([(w, 2) for w in words], "word string, n long").repartition(3)
    f = S.Filters(dict(Counter(len(w) for w in words)))
    f = S.load_filters(S.filter_blocks(vocab, f), f, 0, f.total)
    held = lambda some: sum(len(f.holds((code * S.powers(code.shape[1])).sum(1), code.shape[1])) for _, code in S.codes_by_length(some))
    assert held(words) == len(words)
    assert held(others) < 0.02 * len(others)


def test_groups_equal_brute_force(spark):
    counts = a_vocabulary()
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    want = groups(counts)
    assert as_rows(S.spelling_groups(vocab)) == want
    assert sum(v[1] is not None for v in want.values()) > 50 and any(want[v[1]][1] for v in want.values() if v[1])


def test_rounds_of_filters(spark, monkeypatch):
    """Less may be broadcast than the filters hold: the next range of blocks comes in the next round."""
    monkeypatch.setattr(S, "PACK", 4)
    counts = a_vocabulary(seed=9, size=120)
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(S.spelling_groups(vocab, round_blocks=12)) == groups(counts)


def test_false_positives_go(spark):
    """With one bit a word nearly every neighbour is claimed."""
    counts = a_vocabulary(seed=11, size=60)
    counts = {w: n for w, n in counts.items() if len(w) < 100}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_rows(S.spelling_groups(vocab, bits=1)) == groups(counts)


def test_digest_equals_the_contract(spark, odd_docs):
    rng = random.Random(3)
    base = ["information", "knowledge", "Straßenbahn", "ÉCOLES", "Writing", "writings", "wr1ting", "développement", "informations"]
    texts = [(i, " ".join(rng.choice(base) + rng.choice([" ", ", ", "9", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    want = groups(contract_counts([tuple(r) for r in docs.collect()]))
    assert as_rows(S.digest(docs)) == want
    assert as_rows(S.digest(docs.withColumn("word", docs.doc_id).withColumn("id", docs.doc_id).withColumn("run", docs.text))) == want
    assert any(v[1] for v in want.values())


def test_no_documents(spark, no_docs):
    assert S.digest(no_docs).count() == 0
    assert S.digest(spark.createDataFrame([(1, "no long word twice"), (2, None)], "doc_id long, text string")).count() == 0
