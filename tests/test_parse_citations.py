"""Parsing and bibliographies on small hand-written papers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators import citations as C
from paperlake.operators import parse as P
from paperlake.sources import testcorpus as TC

PAGES = [
    ("a", 1, "A Good Title for a Paper\narXiv: 2101.00001 and doi:10.1234/ABC.d).\nAbstract\n Some   text\nhere.\n\nIntroduction\nHello  world\nResults show that it works\nBody of it"),
    ("a", 2, "References\n[1] Smith, J., Doe, A. and Roe, B. 2019. \"A cited title\". doi:10.1000/xyz.\n[2] Lee, K. (2020). Second work of note. arXiv:2001.12345\nshort\nNot an entry line at all"),
    ("b", 1, "x\nIntroduction"),
    ("c", 1, ""),
    ("d", 1, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "paper_id string, page_num int, text string")


def one(df, paper):
    return next(r for r in df.collect() if r.paper_id == paper)


def test_parsed_fields(pages):
    p = P.parse_papers(pages)
    a = one(p, "a")
    assert (a.title, a.abstract, a.arxiv_id, a.doi) == ("A Good Title for a Paper", "Some text here.", "2101.00001", "10.1234/ABC.d")
    # a line that begins with a heading word is a heading, however long
    assert [(s.heading, s.text) for s in a.sections][:3] == [("Abstract", "Some text here."), ("Introduction", "Hello world"), ("Results show that it works", "Body of it")]
    assert a.sections[3].heading == "References"
    b = one(p, "b")
    assert b.title is None and b.abstract is None and [(s.heading, s.text) for s in b.sections] == [("Introduction", "")]
    assert one(p, "c").sections == [] and one(p, "d").title is None


def test_identity_only_in_the_first_characters(spark):
    p = spark.createDataFrame([("a", 1, "x" * 600 + " arXiv:2101.00001"), ("b", 1, "t"), ("b", 2, "doi:10.1234/z")], "paper_id string, page_num int, text string")
    assert {(r.arxiv_id, r.doi) for r in P.parse_papers(p).collect()} == {(None, None)}


def test_line_table_gives_the_same_sections(pages):
    whole = P.full_text(pages)
    a = {(r.paper_id, r.idx, r.heading, r.text) for r in P.sections(P.parse_papers(pages)).collect()}
    assert {(r.paper_id, r.idx, r.heading, r.text) for r in P.section_lines(whole).collect()} == a


def test_pages_join_in_order(spark):
    p = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 10, "ten")], "paper_id string, page_num int, text string")
    assert P.full_text(p).first().text == "one\n\ntwo\n\nten"


def test_reference_lines(pages):
    r = {x.line_no: x for x in P.parse_reference_lines(P.full_text(pages)).collect()}
    first = r[min(r)]
    assert first.title == "A cited title" and first.year == 2019 and first.doi == "10.1000/xyz."
    assert r[max(r)].authors == [] and r[max(r)].title == "Not an entry line at all"


def test_references(pages):
    r = {x.ref_id: x for x in C.extract_references(P.full_text(pages)).collect()}
    assert set(r) == {"1", "2"}
    assert r["1"].doi == "10.1000/xyz." and r["1"].title == "A cited title" and r["1"].authors[0] == "Smith"
    assert (r["2"].arxiv_id, r["2"].year, r["2"].title) == ("2001.12345", 2020, ". Second work of note")  # the mark behind the bracket belongs to it


def test_bibliography_on_one_line(spark):
    s = spark.createDataFrame([("a", "[1] First, A. 2001. \"T one\". [2] Second, B. 2002. \"T two\"."), ("b", "  "), ("c", "[1] A, 2001. \"x y\"\n[2] B, 2002. \"z\"")], "paper_id string, text string")
    assert sorted((r.paper_id, r.ref_id, r.title) for r in C.parse_bibliography(s).collect()) == [("a", "1", "T one"), ("a", "2", "T two"), ("c", "1", "x y"), ("c", "2", "z")]


@pytest.mark.parametrize("group,ids", [("1", ["1"]), ("2, 3", ["2", "3"]), ("1-3", ["1", "2", "3"]), ("3-1", []), ("1;4-5", ["1", "4", "5"])])
def test_numeric_groups(spark, group, ids):
    assert spark.range(1).select(C.expand_numeric_group(F.lit(group)).alias("x")).first().x == ids


def test_wide_ranges(spark):
    """Against the paper's own numbers a range may have any width."""
    t = spark.createDataFrame([("a", "See [1-9999999999] and [2-99999999999999999999], [03; 7, 7]."), ("b", "See [5-9004]."), ("c", "[7-9]")], "paper_id string, text string")
    refs = spark.createDataFrame([("a", "3"), ("a", "7"), ("a", "x1"), ("a", "03"), ("c", None)], "paper_id string, ref_id string")
    got = sorted((r.paper_id, r.ref_id, r.start) for r in C.find_mentions(t, refs).collect())
    assert [x for x in got if x[0] != "b"] == [("a", "03", 49), ("a", "3", 4), ("a", "3", 23), ("a", "7", 4), ("a", "7", 23), ("a", "7", 49), ("a", "7", 49)]
    assert sorted(int(x[1]) for x in got if x[0] == "b") == list(range(5, 9005))


def test_mentions(spark):
    text = "See [1, 3] and [2-3]; also (Smith et al., 2020) and Doe (2019) é [9]."
    t = spark.createDataFrame([("a", text)], "paper_id string, text string")
    refs = spark.createDataFrame([("a", "1"), ("a", "3")], "paper_id string, ref_id string")
    got = sorted((r.start, r.ref_id or "", r.text) for r in C.find_mentions(t, refs).collect())
    assert got == [(4, "1", "[1, 3]"), (4, "3", "[1, 3]"), (15, "3", "[2-3]"), (27, "", "(Smith et al., 2020)"), (52, "", "Doe (2019)")]
    assert text[52:62] == "Doe (2019)"
    assert C.find_mentions(t).where("ref_id = '9'").count() == 1


def test_normalise_and_merge(spark):
    rows = [
        ("a", 1, "raw", "1", "10.1/ A B", None, 2001, " A  title ", ["X ", ""]),
        ("a", 2, "raw", None, "10.1/ab", None, 2002, "Other", []),
        ("a", 3, "Smith, 2003. \"Raw title\". arXiv:2001.11111", None, None, None, None, None, None),
        ("a", 4, "", None, None, None, None, None, None),
        ("a", 5, "raw", "9", "bad", "99", None, "No ids", None),
    ]
    refs = spark.createDataFrame(rows, "paper_id string, line_number int, raw_text string, ref_id string, doi string, arxiv_id string, year int, title string, authors array<string>")
    n = {r.pos: r for r in C.normalize_citations(refs).collect()}
    assert (n[0].title, n[0].authors, n[0].doi, n[0].ref_id) == ("A title", ["X"], "10.1/ab", "1")
    assert n[1].ref_id == "ref_1" and (n[2].title, n[2].arxiv_id, n[2].year) == ("Raw title", "2001.11111", 2003)
    assert (n[3].doi, n[3].arxiv_id) == (None, None)
    m = {r.pos: r for r in C.merge_duplicate_citations(C.normalize_citations(refs)).collect()}
    assert set(m) == {0, 2, 3} and m[0].ref_ids == ["1", "ref_1"] and m[0].title == "A title"


@pytest.mark.parametrize("value,ok", [("a" * 64, True), ("arxiv-2101.00001", True), ("ArXiv-cs.LG/0101001", True), ("a" * 63, False), ("../x", False), (None, False)])
def test_document_ids(spark, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(X.valid_doc_id(F.col("v")).alias("x")).first().x is ok


@pytest.mark.parametrize("value,want", [("https://doi.org/10.1/AbC", "10.1/abc"), ("10.1/X y", "10.1/xy"), ("11.2/x", None), (None, None)])
def test_doi(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(X.normalize_doi(F.col("v")).alias("x")).first().x == want


@pytest.mark.parametrize("value,want", [("arXiv:2101.00001v2", "2101.00001"), ("https://arxiv.org/pdf/2101.00001.pdf", "2101.00001"), ("hep-th/9901001", "hep-th/9901001"), ("nope", None)])
def test_arxiv_ids(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(X.normalize_arxiv_id(F.col("v")).alias("x")).first().x == want


def test_an_absurd_range_does_not_kill_the_job(spark):
    t = spark.createDataFrame([("a", "See [1-9999999999] and [1-99999999], then [2-3] [99999999999999999999].")], "paper_id string, text string")
    got = {r.ref_id for r in C.find_mentions(t).collect()}
    assert {"2", "3"} <= got and len(got) < 10


@pytest.mark.parametrize("doi,want", [("10.1/A b", "10.1/ab"), ("https://doi.org/10.1/a", None), ("doi:10.1/a", None), ("", None)])
def test_a_citations_doi_stands_bare(spark, doi, want):
    assert spark.range(1).select(X.clean_doi(F.lit(doi)).alias("d")).first().d == want


def test_cited_numbers_are_no_years(spark):
    """Papers that cite numbers 1900 to 2099: the year of each line is that of the reference."""
    docs = spark.range(1890, 2110).select(F.col("id").alias("doc_id"), F.lit("Some text.").alias("text"))
    texts = P.full_text(TC.pages(docs, 2110))
    assert {r.year for r in C.extract_references(texts).select("year").distinct().collect()} == {2001}
    assert {r.year for r in P.parse_reference_lines(texts).select("year").distinct().collect()} == {2001}


def test_lines_are_worked_out_once(spark):
    """No filter below the generator repeats the look for the bibliography, and lines behind it keep their numbers."""
    d = spark.createDataFrame([("a", " x \n\tReferences \n\n [1] Ann, 2001. \"One title\". \nno entry\n[2] Bob, 2002. \"Two titles\"."), ("b", "no list"), ("c", None)], "paper_id string, text string")
    refs = C.extract_references(d)
    assert [(r.paper_id, r.line_number, r.ref_id, r.title) for r in refs.orderBy("line_number").collect()] == [("a", 3, "1", "One title"), ("a", 5, "2", "Two titles")]
    assert refs._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1


def test_white_space(spark):
    d = spark.createDataFrame([(" a  b\n",), ("a b",), ("　a \tb \n\n c\r",), ("",), (None,), (" ",)], "t string")
    got = d.select(X.collapse(F.col("t")).alias("c"), X.stripped_lines(F.col("t")).alias("l")).collect()
    assert [r.c for r in got] == ["a b", "a b", "a b c", "", None, ""]
    assert [r.l for r in got] == [["a  b", ""], ["a b"], ["a \tb", "", "c"], [""], None, [""]]


def test_mentions_need_no_arrow(spark):
    """Arrow would gather ten thousand whole texts in a Python worker at once."""
    m = C.find_mentions(spark.createDataFrame([("a", "See [1, 2] and (Smith, 2001)."), ("b", None)], "paper_id string, text string"))
    assert sorted((r.ref_id or "", r.start, r.end) for r in m.collect()) == [("", 15, 28), ("1", 4, 10), ("2", 4, 10)]
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
