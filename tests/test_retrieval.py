"""Chunks, vectors, retrieval, context and grading."""

from __future__ import annotations

import hashlib
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators import chunks as V
from paperlake.operators import evaluate as N
from paperlake.operators import retrieve as H
from paperlake.operators import vectors as VX
from paperlake.plans.more_queries import _retrieved

PARSED = "paper_id string, title string, abstract string, sections array<struct<idx:int,heading:string,text:string>>"


def test_structured_chunks_and_fallback(spark):
    parsed = spark.createDataFrame([("a", "T", "abs", [(0, "Intro", "body"), (1, "Empty", " ")]), ("b", None, None, [])], PARSED)
    ents = spark.createDataFrame([("a", 0, "BERT", "Method", "Intro", "ev")], "paper_id string, pos int, name string, type string, source_section string, evidence string")
    pages = spark.createDataFrame([("a", 1, "not used"), ("b", 1, "w1 w2 w3"), ("b", 2, "")], "paper_id string, page_num int, text string")
    got = V.chunk_ids(V.chunks_with_fallback(V.structured_chunks(parsed, ents), V.word_window_chunks(pages, 2, 1))).orderBy("paper_id", "chunk_index").collect()
    assert [(r.paper_id, r.chunk_index, r.text, r.node_type) for r in got] == [
        ("a", 0, "abs", "Paper"), ("a", 1, "body", "Section"), ("a", 2, "BERT: ev", "Method"), ("b", 0, "w1 w2", None), ("b", 1, "w2 w3", None), ("b", 2, "w3", None),
    ]
    for r in got:
        assert r.chunk_id == f"{r.paper_id}__chunk_{r.chunk_index:05d}" and r.id == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.chunk_id))


@pytest.mark.parametrize("size,overlap,n,starts", [(500, 50, 1000, [0, 450, 900]), (500, 50, 10, [0]), (3, 3, 4, [0, 1, 2, 3]), (3, 5, 2, [0, 1])])
def test_windows(spark, size, overlap, n, starts):
    p = spark.createDataFrame([("a", 1, "  ".join(f"w{i}" for i in range(n)))], "paper_id string, page_num int, text string")
    got = sorted(r.i for r in V.word_window_chunks(p, size, overlap).select("ord.i").collect())
    assert got == starts


def test_hash_embedding(spark):
    r = VX.embed(spark.createDataFrame([("hello",), (None,)], "text string"), dim=40).collect()
    d = hashlib.sha256(b"hello").digest()
    assert r[0].embedding == pytest.approx([d[i % 32] / 255 for i in range(40)], abs=1e-6) and len(r[1].embedding) == 40


def lengths(series):
    for s in series:
        yield s.map(lambda t: [float(len(t)), 1.0])


def test_plugged_in_embedder(spark):
    r = VX.embed(spark.createDataFrame([("abc",)], "text string"), backend=lengths).first()
    assert list(r.embedding) == [3.0, 1.0]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    rows = [(f"c{i:02d}", f"p{i % 7}", f"s{i % 3}", f"text {i}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id string, paper_id string, section string, text string, embedding array<float>").persist(), x.astype(np.float32).astype(float)


@pytest.mark.parametrize("metric", VX.METRICS)
def test_single_and_batch_search_agree_with_numpy(spark, points, metric):
    df, x = points
    q = x[5] + 0.1
    s = {"cosine": (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)), "euclid": 1 - ((x - q) ** 2).sum(1), "dot": 1 + x @ q}[metric]
    want = [f"c{i:02d}" for i in np.argsort(-s, kind="stable")[:5]]
    got = VX.vector_search(df, q.tolist(), 5, metric=metric).collect()
    assert [r.id for r in got] == want and got[0].score == pytest.approx(s.max(), abs=1e-5)
    qs = spark.createDataFrame([("q", q.tolist()), ("r", x[0].tolist())], "query_id string, query_embedding array<double>")
    batch = VX.batch_vector_search(qs, df, 5, metric=metric).where("query_id = 'q'").orderBy("rank").collect()
    assert [r.id for r in batch] == want


def test_filters_papers_and_stats(spark, points):
    df, x = points
    q = x[0].tolist()
    assert {r.section for r in VX.vector_search(df, q, 9, {"section": "s1", "paper_id": ["p1", "p2"]}).collect()} == {"s1"}
    allowed = spark.createDataFrame([("p3",)], "paper_id string")
    assert {r.paper_id for r in VX.graph_filtered_search(df, allowed, q, 4).collect()} == {"p3"}
    assert VX.graph_filtered_search(df, allowed.where("false"), q, 4).count() == 4
    best = VX.paper_search(df, q, 3).collect()
    assert best[0].paper_id == "p0" and best[0].text == "text 0" and best[0].sections == sorted(best[0].sections) and len(best) == 3
    s = VX.collection_stats(df).first()
    assert (s.n_points, s.dim, s.rebuild) == (60, 8, False) and VX.collection_stats(df, dim=9).first().rebuild


def test_replacing_a_papers_points(points):
    df, _ = points
    new = df.where("paper_id = 'p1' and section = 's1'")
    out = VX.replace_paper_vectors(df, new)
    assert out.where("paper_id = 'p1'").count() == new.count() and out.where("paper_id <> 'p1'").count() == df.where("paper_id <> 'p1'").count()


@pytest.mark.parametrize(
    "query,kind",
    [
        ("Which papers cite this?", "CITATION"), ("WHO CITES BERT", "CITATION"), ("How did attention evolve?", "EVOLUTION"), ("from RNNs to Transformers", "EVOLUTION"),
        ("BERT versus GPT", "COMPARISON"), ("Is A better than B", "COMPARISON"), ("Give an overview", "SURVEY"), ("Summarise the work", "SURVEY"), ("What is BERT?", "ENTITY_LOOKUP"),
        ("Tell me about GPT", "ENTITY_LOOKUP"), ("Why does it work?", "EXPLANATION"), ("", "EXPLANATION"), ("  ", "EXPLANATION"), ("What cites the evolution?", "CITATION"),
    ],
)
def test_query_classes(spark, query, kind):
    assert spark.createDataFrame([(query,)], "q string").select(X.classify_query(F.col("q")).alias("k")).first().k == kind


def test_hybrid_retrieval_context_and_grades(spark):
    from tests.test_graph import chain

    nodes, edges = chain(spark, [("a", "b"), ("b", "c")])
    nodes = nodes.withColumn("properties", F.create_map().cast("map<string,string>"))
    edges = edges.select("source_id", F.lit("Paper").alias("source_type"), "edge_type", "target_id", F.lit("Paper").alias("target_type"), F.lit(None).cast("string").alias("evidence"), F.lit(0.9).alias("confidence"), F.create_map().cast("map<string,string>").alias("properties"))
    chunks = spark.createDataFrame([("1", "a", "Intro", "alpha text", [1.0, 0.0]), ("2", "c", None, "gamma text", [0.0, 1.0])], "id string, paper_id string, section string, text string, embedding array<float>")
    qs = spark.createDataFrame([("q1", "Who cites b?", "b", [1.0, 0.0]), ("q2", "How did it evolve?", "a", [1.0, 0.0]), ("q3", "Why?", None, [1.0, 0.1]), ("q4", "What is nothing?", None, [1.0, 0.0])], "query_id string, query string, paper_id string, query_embedding array<float>")
    got = {r.query_id: r for r in H.build_context(H.hybrid_retrieve(qs, nodes, edges, chunks, 1)).collect()}
    assert {(f.subject.name, f.object.name) for f in got["q1"].facts} == {("a", "b"), ("b", "c")} and got["q1"].hits == [] and got["q1"].source_paper_ids == ["a", "b"]
    assert [p.paper_id for p in got["q2"].paths] == ["b", "c"] and "Citation paths:" in got["q2"].context_text
    assert got["q3"].facts == [] and got["q3"].context_text == 'Text evidence:\n- (a / Intro) "alpha text"\n\nSource papers:\n- [a] a'
    assert got["q4"].context_text == "" and got["q4"].source_paper_ids == []
    notes = {r.query_id: (len(r.confidence_notes), r.answerable) for r in H.confidence_notes(H.build_context(H.hybrid_retrieve(qs, nodes, edges, chunks, 1))).collect()}
    assert notes["q4"] == (2, False) and notes["q3"] == (0, True)
    forced = H.route_queries(qs, "vector").collect()
    assert all(r.use_vector and not r.use_graph for r in forced)
    assert all(r.use_vector and r.use_graph for r in H.route_queries(qs, "both").collect())
    assert H.route_queries(qs, "anything").collect() == H.route_queries(qs).collect()
    both = {r.query_id: r for r in H.hybrid_retrieve(qs, nodes, edges, chunks, 5, "both").collect()}
    assert [h.paper_id for h in both["q2"].hits] == ["a"] and both["q1"].hits == [] and len(both["q3"].hits) == 2
    assert {r.mode for r in H.retrieve_modes(qs, nodes, edges, chunks).select("mode").distinct().collect()} == {"graph", "vector", "hybrid"}
    questions = spark.createDataFrame([("q1", "x", ["B"], "CITES", ["a"]), ("q3", "x", ["zeta"], None, []), ("q4", "y", [], "", ["z"])], "id string, category string, expected_entities array<string>, expected_relation string, expected_sources array<string>")
    modes = H.build_context(H.hybrid_retrieve(qs, nodes, edges, chunks, 1)).select(F.col("query_id").alias("id"), F.lit("hybrid").alias("mode"), "facts", "hits", "source_paper_ids", "context_text")
    scores = {r.id: r for r in N.score_questions(questions, modes).collect()}
    assert (scores["q1"].retrieval_hit, scores["q1"].source_correct, scores["q1"].citation_correct, scores["q1"].grounded) == (True, True, True, True)
    assert (scores["q3"].retrieval_hit, scores["q3"].source_correct, scores["q3"].citation_correct, scores["q3"].grounded) == (False, None, None, True)
    assert (scores["q4"].retrieval_hit, scores["q4"].source_correct, scores["q4"].grounded) == (True, False, False)
    total = N.summarize_eval(N.score_questions(questions, modes)).first()
    assert (total.n, total.retrieval_hit_rate, total.source_correct_rate, total.citation_correct_rate, total.grounded_rate) == (3, 0.6667, 0.5, 1.0, 0.6667)


def test_expected_names_are_met_whole_not_as_parts_of_the_context(spark):
    fact = "struct<subject:struct<name:string>,relation:string,object:struct<name:string>>"
    r = spark.createDataFrame(
        [("1", "hybrid", [((("Storage",), "USES", ("x",)))], [("RAG",)], [], "storage rag"), ("2", "hybrid", [((("Storage",), "USES", ("x",)))], [(None,)], [], "storage rag")],
        f"id string, mode string, facts array<{fact}>, hits array<struct<node_name:string>>, source_paper_ids array<string>, context_text string",
    )
    q = spark.createDataFrame([("1", "c", ["rag", "storage"], None, []), ("2", "c", ["RAG"], None, [])], "id string, category string, expected_entities array<string>, expected_relation string, expected_sources array<string>")
    assert {x.id: x.retrieval_hit for x in N.score_questions(q, r).collect()} == {"1": True, "2": False}


def test_zero_vectors_take_no_rank(spark):
    c = spark.createDataFrame([("a", "p", "s", "t", [0.0, 0.0]), ("b", "p", "s", "t", [1.0, 0.0]), ("c", "p", "s", "t", None)], "id string, paper_id string, section string, text string, embedding array<float>")
    assert [r.id for r in VX.vector_search(c, [1.0, 0.0]).collect()] == ["b"] and VX.vector_search(c, [0.0, 0.0]).count() == 0
    assert [r.paper_id for r in VX.paper_search(c, [1.0, 1.0]).collect()] == ["p"]
    q = spark.createDataFrame([("q", [1.0, 1.0]), ("z", [0.0, 0.0])], "query_id string, query_embedding array<float>")
    assert [(r.query_id, r.id, r["rank"]) for r in VX.batch_vector_search(q, c).collect()] == [("q", "b", 1)]
    assert VX.batch_vector_search(q, c, metric="dot").count() == 4


def test_rag_context(spark):
    hits = spark.createDataFrame([("q", 1, 0.9, "p", "x" * 200), ("q", 2, 0.8, "r", "second")], "query_id string, rank int, score double, paper_id string, text string")
    r = H.rag_context(hits).first()
    assert r.context == "---\n" + "x" * 200 + "\n---\nsecond" and len(r.citations[0].snippet) == 100


def test_scores_that_are_no_number_take_no_rank(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0, None])]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert [r.id for r in VX.vector_search(chunks, [1.0, 0.1], 5).collect()] == [1, 4]
    q = chunks.where("id in (1, 2, 4)").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    got = sorted((r.query_id, r["rank"], r.id) for r in VX.batch_vector_search(q, chunks, 5).collect())
    assert got == [(1, 1, 1), (1, 2, 4), (4, 1, 4), (4, 2, 1)]


def test_chunk_ids_keep_all_digits(spark):
    d = spark.range(100_002).select(F.lit("p").alias("paper_id"), F.col("id").alias("ord"))
    ids = V.chunk_ids(d).where("chunk_index in (7, 10000, 100001)").orderBy("chunk_index").collect()
    assert [r.chunk_id for r in ids] == ["p__chunk_00007", "p__chunk_10000", "p__chunk_100001"]


def test_a_context_of_many_papers_takes_time_in_proportion(spark):
    """Each source paper's title was looked for among all places; 8,000 facts took minutes."""
    place = "struct('P' || x AS name, 'Paper' AS type, 'p' || x AS paper_id)"
    facts = f"transform(sequence(1, 8000), x -> struct({place} AS subject, 'CITES' AS relation, {place.replace('x', '(x + 1)')} AS object, cast(null AS string) AS evidence, array('p' || x, 'q' || x) AS source_paper_ids))"
    hits = "array(struct('p9' AS paper_id, 's' AS section, 't' AS text, cast(null AS string) AS node_name))"
    paths = "array(struct(1 AS depth, 'q5' AS paper_id, 'Q' AS title, array('a', 'b') AS path, 'forward' AS direction))"
    began = time.monotonic()
    got = H.build_context(spark.sql(f"SELECT 1 AS query_id, {facts} AS facts, {hits} AS hits, {paths} AS paths")).first().source_papers
    assert time.monotonic() - began < 30
    titles = {s.paper_id: s.title for s in got}
    assert len(got) == 16001 and [s.paper_id for s in got] == sorted(titles)
    assert titles["p1"] == "P1" and titles["p8001"] == "P8001" and titles["q5"] == "Q" and titles["q6"] is None


def test_questions_on_order_lines_read_them_once_for_the_graph(spark):
    plan = _retrieved(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
