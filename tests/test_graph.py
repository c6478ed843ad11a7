"""Graph building, merging, placeholders, questions and walks."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from paperlake.operators import graph as G
from paperlake.operators import graph_query as Q
from paperlake.operators import parse as P
from paperlake.operators import traverse as W
from paperlake.plans import workloads
from paperlake.sources import io
from paperlake.sources import testcorpus as TC

PAPER = "paper_id string, title string, abstract string, authors array<string>, year int, arxiv_id string, doi string"
CITE = "paper_id string, pos int, title string, authors array<string>, year int, doi string, arxiv_id string, ref_id string"
h = lambda s: hashlib.md5(s.encode()).hexdigest()[:12]


@pytest.fixture(scope="module")
def parts(spark):
    papers = spark.createDataFrame([("a", "Paper A", "x" * 3000, ["Ann", "Bob"], 2020, None, "10.1/a"), ("b", None, None, ["Ann"], None, "2101.00001", None)], PAPER)
    sections = spark.createDataFrame([("a", 0, "Intro", "t" * 900), ("a", 1, "Intro", "again"), ("b", 0, "Intro", "")], "paper_id string, idx int, heading string, text string")
    ents = spark.createDataFrame(
        [("a", 0, "BERT", "Method", "introduces", "e1", "Intro"), ("a", 1, "bert", "Method", None, "e2", "Intro"), ("a", 2, "BLEU", "Metric", "introduces", "e3", "Intro"), ("a", 3, "We show", "Claim", None, "e4", "Intro"), ("b", 0, "Bert", "Method", None, "e5", "X"), ("b", 1, "Odd", "Nothing", None, "e", "X"), ("b", 2, "GPT", "Method", None, "e6", "X")],
        "paper_id string, pos int, name string, type string, role string, evidence string, source_section string",
    )
    rels = spark.createDataFrame([("b", 0, "bert", "Method", "IMPROVES_UPON", "gpt", "Method", "r"), ("a", 0, "BERT", "Method", "EXTENDS", "GPT", "Method", "r")], "paper_id string, pos int, source string, source_type string, relation string, target string, target_type string, evidence string")
    cites = spark.createDataFrame([("a", 0, "B", ["Z"], 2021, None, "2101.00001", "1"), ("b", 0, "A", None, None, "10.1/A", None, "7"), ("b", 1, "Only title", None, None, None, None, None), ("b", 2, "", None, None, None, None, "9"), ("a", 1, "Self", None, None, "10.1/a", None, "2")], CITE)
    return papers, sections, ents, rels, cites


@pytest.fixture(scope="module")
def graph(parts):
    n, e = G.build_graph(*parts)
    return n.persist(), e.persist()


def triples(edges):
    return {(r.source_id, r.edge_type, r.target_id) for r in edges.collect()}


def test_ids_and_edges(graph):
    nodes, edges = graph
    ids = {r.node_id: r for r in nodes.collect()}
    bert = f"method_{h('bert')}"
    assert ids[bert].name == "BERT" and ids[bert].paper_id == "a" and ids[bert].properties["evidence"] == "e1"
    assert f"author_{h('Ann')}" in ids and f"section_a_{h('Intro')}" in ids and f"claim_a_{h('we show')}" in ids
    assert len(ids["paper_a"].properties["abstract"]) == 2000 and ids["paper_b"].name == "b"
    assert len(ids[f"section_a_{h('Intro')}"].properties["text_preview"]) == 500
    t = triples(edges)
    assert ("paper_a", "INTRODUCES", bert) in t and ("paper_b", "MENTIONS", bert) in t and ("paper_a", "MENTIONS", f"metric_{h('bleu')}") in t
    assert not [x for x in t if x[2].startswith("claim_")]
    assert (bert, "IMPROVES_UPON", f"method_{h('gpt')}") in t and not [x for x in t if x[1] == "EXTENDS"]
    assert ("paper_b", "CITES", f"paper_ref_b_{h('Only title')}") in t and len([x for x in t if x[0] == "paper_b" and x[1] == "CITES"]) == 2
    by = {(r.source_id, r.edge_type, r.target_id): r for r in edges.collect()}
    assert by[("paper_a", "MENTIONS", f"metric_{h('bleu')}")].evidence is None
    c = by[("paper_a", "CITES", "paper_arxiv_2101.00001")]
    assert c.evidence == "Referenced as [1]" and c.confidence == 0.9


def test_every_edge_is_allowed_and_has_its_ends(graph):
    nodes, edges = graph
    assert G.valid_edges(edges).count() == edges.count()
    for side in ("source_id", "target_id"):
        assert edges.join(nodes.select(F.col("node_id").alias(side)), side, "left_anti").count() == 0


def test_placeholders_are_resolved(graph):
    nodes, edges = G.resolve_stubs(*graph)
    t = triples(edges)
    assert ("paper_a", "CITES", "paper_b") in t and ("paper_b", "CITES", "paper_a") in t
    assert not [x for x in t if x[0] == x[2]]
    left = {r.node_id for r in nodes.collect()}
    assert "paper_arxiv_2101.00001" not in left and "paper_doi_10.1/a" not in left
    again = G.resolve_stubs(nodes, edges)
    assert triples(again[1]) == t


def test_existing_edge_keeps_its_own_properties(spark, graph):
    nodes, edges = graph
    extra = edges.where("edge_type = 'CITES'").limit(1).select(F.lit("paper_a").alias("source_id"), "source_type", "edge_type", F.lit("paper_b").alias("target_id"), "target_type", F.lit("own").alias("evidence"), "confidence", "properties")
    out = G.resolve_stubs(nodes, edges.unionByName(extra))[1].where("source_id = 'paper_a' and target_id = 'paper_b'").collect()
    assert [r.evidence for r in out] == ["own"]


def test_merge_last_writer_wins_per_property(spark):
    s = "node_id string, node_type string, name string, paper_id string, properties map<string,string>"
    old = spark.createDataFrame([("n", "Method", "Old", "p1", {"a": "1", "b": "2"}), ("k", "Task", "Kept", "p", {})], s)
    new = spark.createDataFrame([("n", "Method", "New", None, {"b": "3"}, 1), ("n", "Method", None, "p2", {"c": "4", "b": "5"}, 2), ("x", "Task", "X", "p", {}, 1)], s + ", seq long")
    got = {r.node_id: r for r in G.merge_nodes(old, new).collect()}
    assert (got["n"].name, got["n"].paper_id, got["n"].properties) == ("New", "p2", {"a": "1", "b": "5", "c": "4"}) and set(got) == {"n", "k", "x"}
    merged = G.merge_nodes(old, new)
    assert {r.node_id: r.properties for r in G.merge_nodes(merged, new).collect()} == {k: r.properties for k, r in got.items()}


def test_merge_edges_needs_both_ends(graph):
    nodes, edges = graph
    out = G.merge_edges(edges, edges.withColumn("seq", F.lit(1)), nodes)
    assert triples(out) == triples(edges)
    assert triples(G.merge_edges(edges, edges.withColumn("seq", F.lit(1)), nodes.where("node_type <> 'Method'"))) == {x for x in triples(edges) if "method_" not in x[0] + x[2]}


def test_curated_writes_use_the_same_ids(spark):
    s = "id long, paper_id string, kind string, resolved_by string, name string, type string, role string, evidence string, confidence double, source string, source_type string, relation string, target string, target_type string"
    d = spark.createDataFrame(
        [(1, "a", "entity", "u", "BERT", "Method", "introduces", "e", 0.7, None, None, None, None, None), (2, "a", "entity", "u", "BLEU", "Metric", "introduces", None, None, None, None, None, None, None), (3, "a", "entity", "u", " ", "Method", None, None, None, None, None, None, None, None), (4, "a", "relation", "u", None, None, None, "e", None, "BERT", "Method", "EXTENDS", "GPT", "Method"), (5, "a", "relation", "u", None, None, None, "e", None, "BERT", "Method", "CITES", "GPT", "Method"), (6, "a", "relation", "u", None, None, None, "e", None, "", "Method", "EXTENDS", None, "Method"), (7, "a", "relation", "u", None, None, None, "e", None, "BERT", "Method", "EXTENDS", " ", "Method")], s
    )
    nodes, edges, rejected = G.curated_graph(d)
    t = triples(edges)
    assert t == {("paper_a", "INTRODUCES", f"method_{h('bert')}"), ("paper_a", "MENTIONS", f"metric_{h('bleu')}"), (f"method_{h('bert')}", "EXTENDS", f"method_{h('gpt')}")}
    assert {r.id for r in rejected.collect()} == {3, 5, 6, 7}
    assert edges.where("edge_type = 'EXTENDS'").first().properties["curated_by"] == "u" and nodes.where("trim(name) = '' or node_id = 'method_'").count() == 0
    assert nodes.where(f"node_id = 'method_{h('bert')}'").first().properties["curated"] == "true"


def test_questions(spark, graph):
    nodes, edges = G.resolve_stubs(*graph)
    keys = spark.createDataFrame([("a",), ("b",)], "paper_id string")
    assert {(r.key_id, r.paper_id) for r in Q.citing_papers(nodes, edges, keys).collect()} == {("a", "b"), ("b", "a")}
    names = spark.createDataFrame([("BERT",), ("GPT",)], "name string")
    assert {(r.name, r.paper_id) for r in Q.papers_using_method(nodes, edges, names).collect()} == {("BERT", "b"), ("GPT", "b")}
    assert {(r.name, r.method) for r in Q.methods_improving_upon(nodes, edges, names).collect()} == {("GPT", "BERT")}
    assert Q.entities_by_type(nodes, "Method").count() == 2 and Q.entities_by_type(nodes, "Method", "b").count() == 1
    assert {(r.key_id, r.name, r.evidence) for r in Q.entities_for_paper(nodes, edges, keys).collect()} == {("a", "BLEU", "e3"), ("b", "BERT", "e5"), ("b", "GPT", "e6")}
    k = spark.createDataFrame([("BERT", "Method")], "name string, type string")
    assert {(r.subject.name, r.relation, r.object.name) for r in Q.entity_relations(nodes, edges, k).collect()} == {("Paper A", "INTRODUCES", "BERT"), ("b", "MENTIONS", "BERT"), ("BERT", "IMPROVES_UPON", "GPT")}
    s = {r.paper_id: r for r in Q.paper_summary(nodes, edges, keys).collect()}
    assert (s["a"].n_sections, s["a"].n_entities, s["a"].n_citations) == (1, 1, 0)
    assert s["b"].n_citations == 2 and {c.doi for c in s["b"].citations} == {"10.1/a", None}
    p, c = Q.citation_graph(nodes, edges)
    assert (p.count(), c.count()) == (3, 3)
    assert {r.paper_id: (r.n_in, r.n_out) for r in Q.citation_degree(nodes, edges).collect()}["a"] == (1, 1)


def chain(spark, pairs):
    node = lambda x: f"paper_{x}"
    e = spark.createDataFrame([(node(a), "CITES", node(b)) for a, b in pairs], "source_id string, edge_type string, target_id string")
    n = spark.createDataFrame([(node(x), "Paper", x, x) for x in sorted({y for p in pairs for y in p})], "node_id string, node_type string, name string, paper_id string")
    return n, e


def test_walks(spark):
    n, e = chain(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")])
    seed = spark.createDataFrame([("paper_a",)], "node_id string")
    near = lambda d, k: {r.node[6:] for r in W.citation_neighbors(e, seed, d, k).collect()}
    assert near("forward", 1) == {"b"} and near("forward", 2) == {"b", "c"} and near("forward", 9) == {"b", "c", "d"} and near("backward", 1) == {"c", "x"} and near("both", 1) == {"b", "c", "x"}
    got = {r.paper_id: (r.depth, r.direction, [p[6:] for p in r.path]) for r in W.expand_citations(n, e, seed).collect()}
    assert got == {"b": (1, "forward", ["a", "b"]), "c": (1, "backward", ["a", "c"]), "x": (1, "backward", ["a", "x"]), "d": (2, "forward", ["a", "c", "d"])}
    assert {r.paper_id for r in W.expand_citations(n, e, seed, max_papers=2).collect()} == {"b", "c"}


def test_graph_files_round_trip(spark, graph, tmp_path):
    io.write_graph(*graph, str(tmp_path / "g"))
    n, e = io.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == graph[0].count() and triples(e) == triples(graph[1])


def test_same_result_for_any_partitioning(spark):
    from paperlake.sources.testcorpus import pages

    docs = spark.createDataFrame([(i, f"Some text {i}.") for i in range(40)], "doc_id long, text string")
    p = pages(docs)
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        nodes, edges = workloads.corpus_to_graph(p.repartition(int(n)))
        seen.append((sorted(map(str, nodes.withColumn("properties", F.to_json("properties")).collect())), sorted(triples(edges))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_walks_over_hubs_shuffle_no_edges(spark, monkeypatch):
    monkeypatch.setattr(W, "HUB", 3)
    pairs = [("h", f"n{i}") for i in range(20)] + [("a", "h"), ("n3", "z"), ("n4", "z"), ("b", "c")]
    n, e = chain(spark, pairs)
    seeds = spark.createDataFrame([("paper_a",), ("paper_b",)], "node_id string")
    got = {(r.seed[6:], r.node[6:]) for r in W.citation_neighbors(e, seeds, "forward", 3).collect()}
    assert got == {("a", "h"), ("a", "z"), ("b", "c")} | {("a", f"n{i}") for i in range(20)}
    assert W.expand_citations(n, e, seeds, "forward", 3).count() == 23
    hops = W.Adjacency(e, "forward")
    assert hops.hubs.where("node = 'paper_h'").agg({"slices": "max"}).first()[0] == 7
    assert hops.hops.where("node = 'paper_h'").select("slice").distinct().count() > 2
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = hops.step(seeds.selectExpr("node_id as seed", "node_id as node"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    side = plan.rstrip().splitlines()[-3:]  # sort, filter and scan of the hops
    assert "Bucketed: true" in side[-1] and "Sort" in side[0] and "Filter" in side[1], plan


def test_ingestion_takes_catalogue_values_and_holds_back_the_unsure(spark):
    from paperlake.plans import workloads
    from paperlake.sources import io as readers
    from paperlake.sources.testcorpus import pages

    docs = spark.createDataFrame([(i, f"Some text {i}.") for i in range(6)], "doc_id long, text string")
    work = ("w1", "Catalogue title", "https://doi.org/10.1234/P1", 2020, [(("Ann", None), [("U",)]), (("Bob", None), [])], None, [], [])
    works = spark.createDataFrame([work], readers.WORKS)
    records = spark.createDataFrame([("doi:10.1234/p0", None, "R", None, 1990, "V", 1, 0, [("Zoe", "z")], None, None)], readers.RECORDS)
    none = spark.createDataFrame([], readers.WORKS), spark.createDataFrame([], readers.RECORDS)
    x = workloads.ingest(pages(docs), works, records)
    by = {(e.source_id, e.target_id) for e in x.edges.where("edge_type = 'WRITTEN_BY'").collect()}
    names = {n.node_id: n for n in x.nodes.collect()}
    assert {(s, names[t].name) for s, t in by} == {("paper_1", "Ann"), ("paper_1", "Bob")}
    assert names["paper_1"].name == "Catalogue title" and names["paper_1"].properties["year"] == "2020" and names["paper_2"].name.startswith("Paper 2")
    assert [(m.paper_id, m.work_id, m.match_method) for m in x.matched.collect()] == [("1", "w1", "doi")]
    queue = x.queue.collect()
    assert queue and {q.routing for q in queue} <= {"draft", "manual"} and all(len(json.loads(q.payload)["evidence"].strip()) < 40 for q in queue)
    open_ = workloads.ingest(pages(docs), *none, has_queue=False)
    assert open_.queue.count() == 0 and open_.edges.where("edge_type = 'WRITTEN_BY'").count() == 0
    kinds = lambda e: e.where("edge_type in ('INTRODUCES', 'MENTIONS')").count()
    assert kinds(open_.edges) > kinds(x.edges)


def test_ingestion_merges_what_a_model_found(spark):
    from paperlake.plans import workloads
    from paperlake.sources import io as readers
    from paperlake.sources.testcorpus import pages

    docs = spark.createDataFrame([(0, "Nothing here.")], "doc_id long, text string")
    none = spark.createDataFrame([], readers.WORKS), spark.createDataFrame([], readers.RECORDS)
    read = workloads.extract(pages(docs))
    found = spark.createDataFrame([("0", 99, "NovelNet", "Method", "a sentence that is certainly long enough to count", 0.95)], "paper_id string, pos int, name string, type string, evidence string, confidence double")
    for c in read.entities.columns:
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast(read.entities.schema[c].dataType))
    x = workloads.ingest(pages(docs), *none, llm_entities=found, extracted=read)
    assert x.nodes.where("name = 'NovelNet' and node_type = 'Method'").count() == 1


def test_papers_past_100000_have_ids_of_their_own(spark):
    """Numbers that share an arXiv id in ``arxiv_of``; neither another paper nor a cited one without a paper has it."""
    docs = spark.createDataFrame([(i, "t") for i in (3, 300003, 100001, 200001, 299998)], "doc_id long, text string")
    ids = [r[0] for r in docs.where("doc_id % 3 = 0").select(TC.own_arxiv_of(F.col("doc_id"))).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 10 for i in ids)
    others = docs.where("doc_id % 3 <> 0").selectExpr("doc_id + 100002 - doc_id % 3 + 1 as c").select(TC.own_arxiv_of(F.col("c")))
    assert not set(ids) & {r[0] for r in others.collect()}
    parsed = P.parse_papers(TC.pages(docs, 400000, TC.own_arxiv_of))
    assert sorted(r[0] for r in parsed.where("arxiv_id is not null").select("arxiv_id").collect()) == sorted(ids)


def test_equal_order_lines_meet_in_tasks_of_bounded_size(spark, monkeypatch):
    """More lines are more tasks, not larger ones, and the papers don't wait for the citations."""
    monkeypatch.setattr(TC, "LINES_A_TASK", 5)
    lines = [(i % 40, i % 7) for i in range(400)]
    nodes, edges = TC.citation_graph(spark.createDataFrame(lines, "l_orderkey long, l_partkey long"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [a" in plan(edges) and ", 80" in plan(edges)
    assert "RepartitionByExpression [p" in plan(nodes) and ", 80" in plan(nodes) and "Aggregate [a" not in plan(nodes)
    want = {(f"paper_{a}", f"paper_{b}") for a, b in lines if a != b}
    assert sorted((r.source_id, r.target_id) for r in edges.collect()) == sorted(want)
    assert sorted(r.node_id for r in nodes.collect()) == sorted({x for pair in want for x in pair})


def test_a_walk_without_seeds_makes_no_table_of_hops(spark, monkeypatch):
    n, e = TC.citation_graph(spark.createDataFrame([(1, 2), (2, 3)], "l_orderkey long, l_partkey long"))
    seeds = n.select("node_id")
    some = W.expand_citations(n, e, seeds)
    shared = W.expand_citations(n, e, seeds, hops=W.Adjacency(e, "both"))
    assert sorted(map(str, shared.collect())) == sorted(map(str, some.collect())) != []
    monkeypatch.setattr(W, "Adjacency", None)  # calling it fails
    none = W.expand_citations(n, e, seeds.where("false"))
    assert none.count() == 0 and none.dtypes == some.dtypes
