"""Fill-in-middle: the boundary set against plain lists, forms, exact restoration, odd rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from paperlake.llm import fill_in_middle as M


def plain(doc_id, text, rate=90, spm=20):
    """What the contract says, by a list of tokens."""
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(w), "plain", None, None, text
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < spm:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(
    ("members", "kind"),
    [
        (list(range(0, 60_000, 30)), "array"),
        (list(np.flatnonzero(np.random.default_rng(1).random(65_536) < 0.5)), "bitmap"),
        ([*range(5, 30_000), *range(40_000, 65_536)], "run"),
    ],
)
def test_containers(members, kind):
    s = M.Boundaries()
    s.add(0, np.array(members))
    s.add(1, np.array([], int))
    s.add(3, np.array(members))
    assert [p[0] for p in s.parts] == [kind, kind] and len(s) == 2 * len(members)
    want = members + [3 * 65_536 + x for x in members]
    for k in [0, 1, len(members) - 1, len(members), len(want) // 3, len(want) - 1, *range(0, len(want), 977)]:
        assert s.select(k) == want[k]
    with pytest.raises(IndexError):
        s.select(len(want))


@pytest.mark.parametrize("text", ["", "a", "ab cd", " ", "é", "aé b", "漢字kana🙂x", "ab" * 40_000, "a b" * 50_000, "a" * 65_536, "a" * 65_535 + " b", "1" * 65_537, "ÀaÀ" * 30_000, "a\nb\r\n\x00"])
def test_boundaries_equal_token_ends(text):
    ends = [0]
    for w in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
        ends.append(ends[-1] + len(w))
    s = M.token_boundaries(text)
    assert [s.select(k) for k in range(len(s))] == ends if len(ends) < 5000 else (len(s) == len(ends) and all(s.select(k) == ends[k] for k in range(0, len(ends), 371)))


def test_rows_equal_the_plain_version(spark, odd_docs):
    more = [(i, f"word{i} and <{'PSMQ'[i % 4]}> tail " if i % 9 == 0 else f"Words, {i} of them: größe\n" * (i % 5), None, "x") for i in range(100, 400)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    rows = M.fill_in_middle(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.fim_tokens, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) == plain(r.doc_id, r.text)
    assert {r.fim_form for r in rows} == {"plain", "psm", "spm"}
    for r in M.digest(docs).collect():
        assert r.restored_sha256 in {hashlib.sha256((x.text or "").encode()).hexdigest() for x in rows if x.doc_id == r.doc_id}
        assert r.output_sha256 in {hashlib.sha256(x.fim_text.encode()).hexdigest() for x in rows if x.doc_id == r.doc_id}
    assert {r.text for r in rows} == {r.text for r in docs.collect()}


def test_empty_table_and_clashing_names(spark, no_docs):
    assert M.digest(no_docs).count() == 0
    assert "fim_text" in M.fill_in_middle(no_docs).columns
    d = spark.createDataFrame([(1, "some words here", "a", "b", "c")], "doc_id long, text string, row string, fim_text string, draw string")
    out = M.fill_in_middle(d)
    assert out.columns[:5] == d.columns and "fim_text_" in out.columns
    assert out.first()["fim_text"] == "b" and out.first()["row"] == "a"
    assert [tuple(r) for r in M.digest(d).collect()] == [tuple(r) for r in M.digest(d.select("doc_id", "text")).collect()]
