"""Review queue, votes in batch and in a stream, jobs, sources, catalogue joins."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperlake.operators import curation as U
from paperlake.operators import enrich as M
from paperlake.operators import jobs as J
from paperlake.plans.workloads import corpus_to_graph, text_to_vectors
from paperlake.sources import io
from paperlake.sources.graph_store import GraphStore
from paperlake.sources.testcorpus import pages
from paperlake.streaming import streams as S

T0 = datetime(2024, 1, 1)
VOTE = "id long, draft_id long, user_id long, vote int, ts timestamp"


def votes(spark, rows):
    return spark.createDataFrame([(i, d, u, v, T0 + timedelta(seconds=i)) for i, (d, u, v) in enumerate(rows)], VOTE)


def drafts(spark, *ids):
    return spark.createDataFrame([(i, f"p{i % 2}", "pending", 0.5 + i / 100, T0) for i in ids], "id long, paper_id string, status string, confidence double, created_at timestamp")


def test_resolution_and_reputation(spark):
    rows = [(1, 1, 1), (1, 2, -1), (1, 2, 1), (1, 3, -1), (2, 1, -1), (2, 2, -1), (3, 1, 1), (3, 1, 1), (4, 9, 5)]
    d, v = drafts(spark, 1, 2, 3, 4, 5), votes(spark, rows)
    r = {x.draft_id: (x.status, x.score, x.resolved_by) for x in U.resolve_drafts(d, v).collect()}
    assert r == {1: ("promoted", 2, 2), 2: ("rejected", -2, 2), 3: ("pending", 1, None), 4: ("pending", 0, None), 5: ("pending", 0, None)}
    assert {x.user_id: x.reputation for x in U.award_reputation(U.resolve_drafts(d, v), v).collect()} == {1: 2, 2: 2}
    assert {x.draft_id: x.score for x in U.attestation_scores(d, v).collect()} == {1: 1, 2: -2, 3: 1, 4: 0, 5: 0}
    assert [x.user_id for x in U.leaderboard(U.award_reputation(U.resolve_drafts(d, v), v), 1).collect()] == [1]
    assert len(U.draft_with_votes(d, v).where("id = 1").first().votes) == 3


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(20), rng.randrange(6), rng.choice([1, 1, -1, 0])) for _ in range(400)]
    v = votes(spark, rows)
    for k in range(3):
        v.where((F.col("id") >= k * 134) & (F.col("id") < (k + 1) * 134)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.vote_stream(stream).writeStream.format("memory").queryName("resolutions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    got = {(r.draft_id, r.status, r.score, r.resolved_by, r.resolved_vote) for r in spark.table("resolutions").collect()}
    want = {(r.draft_id, r.status, r.score, r.resolved_by, r.resolved_vote) for r in U.resolve_drafts(drafts(spark, *range(20)), v).where("status <> 'pending'").collect()}
    assert got == want and spark.table("resolutions").count() == len(want)


def test_vote_stream_survives_a_restart(spark, tmp_path):
    """Each batch is a query of its own that goes on from the last one's state; a draft is reopened only if its status is forgotten."""
    rng = random.Random(6)
    v = votes(spark, [(rng.randrange(8), rng.randrange(9), rng.choice([1, -1])) for _ in range(300)])
    got = []
    for k in range(3):
        v.where((F.col("id") >= k * 100) & (F.col("id") < (k + 1) * 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
        q = S.vote_stream(stream, 4).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    want = U.resolve_drafts(drafts(spark, *range(8)), v, 4).where("status <> 'pending'").collect()
    rows = lambda x: sorted((r.draft_id, r.status, r.score, r.resolved_by, r.resolved_vote) for r in x)
    assert rows(got) == rows(want) and want


def test_closed_drafts_are_forgotten_in_time(spark, tmp_path):
    """With a time after which statuses go, a draft that was closed longer ago is as good as new."""
    schema = votes(spark, []).schema
    got = []
    for k, rows in enumerate([[(1, 1, 1), (1, 2, 1)], [(2, 1, 1)], [(1, 3, 1), (1, 4, 1)]]):
        votes(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = S.vote_stream(stream, 2, forget_after_ms=1).writeStream.foreachBatch(lambda df, n, k=k: got.extend((k, r.draft_id) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        began = time.time()  # a query with timers never runs out of work
        while time.time() < began + 60 and not (len(got) == (1, 1, 2)[k] and sum(p.numInputRows > 0 for p in q.recentProgress) and len(q.recentProgress) > 1):
            time.sleep(0.2)
        q.stop()
    assert got == [(0, 1), (2, 1)]


def test_a_hot_draft_is_resolved_in_slices(spark):
    """A third of all votes on one draft, in both directions for long; the first passage, found slice by slice, is the plain one."""
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        draft = 0 if rng.random() < 0.4 else rng.randrange(1, 60)
        rows.append((draft, rng.randrange(400), rng.choice([1, -1, -1, 0]) if draft % 2 else rng.choice([1, -1])))
    v = votes(spark, rows).repartition(3)
    assert U.vote_slices(v).where("draft_id = 0").select("slice").distinct().count() > 1
    for threshold in (2, 7):
        want, score, cast = {}, dict.fromkeys(range(60), 0), {}
        for k, (draft, user, vote) in enumerate(rows):
            if vote and draft not in want:
                score[draft] += vote - cast.get((draft, user), 0)
                cast[draft, user] = vote
                if abs(score[draft]) >= threshold:
                    want[draft] = (score[draft], user, k)
        for r in U.resolve_drafts(drafts(spark, *range(60)), v, threshold).collect():
            assert (r.status == "pending") == (r.draft_id not in want)
            assert (r.score, r.resolved_by, r.resolved_vote) == want.get(r.draft_id, (score[r.draft_id], None, None))


def test_identities_meet_in_both_orders(spark, tmp_path):
    """Placeholder first, paper first, both at once, and a paper with a smaller id later."""
    batches = [
        [("doi_a", "paper_doi_a", "doi_a", True), ("doi_b", "paper_p2", "p2", False), ("doi_c", "paper_doi_c", "doi_c", True), ("doi_c", "paper_p3", "p3", False)],
        [("doi_a", "paper_p5", "p5", False), ("doi_b", "paper_doi_b", "doi_b", True), ("doi_c", "paper_doi_c", "doi_c", True)],
        [("doi_a", "paper_p4", "p4", False), ("doi_b", "paper_p9", "p9", False), ("doi_d", "paper_doi_d", "doi_d", True)],
    ]
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, S.IDENTITY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = S.identity_moves(spark.readStream.schema(S.IDENTITY).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda df, n, k=k: got.extend((k, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    assert sorted(got) == [(0, "paper_doi_c", "paper_p3"), (1, "paper_doi_a", "paper_p5"), (1, "paper_doi_b", "paper_p2"), (2, "paper_doi_a", "paper_p4")]


def test_moves_are_found_without_python_and_only_new_ones(spark, tmp_path):
    """The batches of the test above through ``resolve_stream``; each key took milliseconds of a Python worker."""
    batches = [
        [("doi_a", "paper_doi_a", "doi_a", True), ("doi_b", "paper_p2", "p2", False), ("doi_c", "paper_doi_c", "doi_c", True), ("doi_c", "paper_p3", "p3", False)],
        [("doi_a", "paper_p5", "p5", False), ("doi_b", "paper_doi_b", "doi_b", True), ("doi_c", "paper_doi_c", "doi_c", True)],
        [("doi_a", "paper_p4", "p4", False), ("doi_b", "paper_p9", "p9", False), ("doi_d", "paper_doi_d", "doi_d", True)],
    ]
    seqs = []
    for rows in batches:
        spark.createDataFrame(rows, S.IDENTITY).coalesce(1).write.mode("append").parquet(str(tmp_path / "out/identities"))
        q = S.resolve_stream(spark, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(180)
        assert q.exception() is None
        assert [o["operatorName"] for o in q.lastProgress["stateOperators"]] == ["stateStoreSave"]
        seqs.append(sorted((r.stub_id, r.real_id, r.seq) for r in GraphStore(spark, str(tmp_path / "out/graph")).rows("moves").collect()))
    assert seqs[0] == [("paper_doi_c", "paper_p3", 1)]
    assert seqs[1] == sorted([*seqs[0], ("paper_doi_a", "paper_p5", 2), ("paper_doi_b", "paper_p2", 2)])
    assert seqs[2] == sorted([*seqs[1], ("paper_doi_a", "paper_p4", 3)])


def test_only_papers_without_structure_become_windows(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "Title of the paper\nAbstract\nsome words"), ("b", 1, "no heading here at all"), ("c", 1, "Introduction\nbody"), (None, 1, "x y z")], "paper_id string, page_num int, text string")
    got = text_to_vectors(pages, 8).orderBy("paper_id").collect()
    assert [(r.paper_id, r.text, r.node_type) for r in got] == [(None, "x y z", None), ("a", "some words", "Paper"), ("a", "some words", "Section"), ("b", "no heading here at all", None), ("c", "body", "Section")]
    rich = text_to_vectors(pages.where("paper_id = 'a'"), 8)
    assert "page_num" not in rich._jdf.queryExecution().optimizedPlan().toString()


def test_ingest_stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Text {i}.") for i in range(4)], "doc_id long, text string")
    pages(docs, 4).where("paper_id < '3'").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = S.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(300)
        assert q.exception() is None
        r = S.resolve_stream(spark, str(tmp_path / "out"), str(tmp_path / "resolved"))
        r.awaitTermination(300)
        assert r.exception() is None
        pages(docs, 4).where("paper_id >= '2'").write.mode("append").parquet(str(tmp_path / "in"))
    schema = "paper_id string, chunk_id string, text string"
    now = S.current_chunks(spark, str(tmp_path / "out"), schema)
    assert {r.paper_id for r in now.select("paper_id").distinct().collect()} == {"0", "1", "2", "3"}
    assert now.groupBy("chunk_id").count().where("count > 1").count() == 0
    nodes, edges = S.current_graph(spark, str(tmp_path / "out"))
    n, e = corpus_to_graph(pages(docs, 4))
    assert {r.node_id for r in nodes.collect()} == {r.node_id for r in n.collect()} and nodes.count() == n.count()
    keys = lambda x: sorted((r.source_id, r.edge_type, r.target_id) for r in x.collect())
    assert keys(edges) == keys(e)


def test_queue_listing_and_manual_actions(spark):
    d = drafts(spark, 3, 1, 2)
    assert [r.id for r in U.list_drafts(d).collect()] == [1, 2, 3] and [r.id for r in U.list_drafts(d, {"paper_id": "p1"}, 1, 1).collect()] == [3]
    acts = spark.createDataFrame([(1, 1, "promote", 7, T0), (2, 1, "promote", 8, T0 + timedelta(seconds=1)), (3, 1, "reject", 9, T0 + timedelta(seconds=2)), (4, 2, "reject", 7, T0), (5, 99, "reject", 7, T0)], "id long, draft_id long, action string, user_id long, ts timestamp")
    out, errors = U.manual_resolution(d, acts)
    assert {r.id: (r.status, r.resolved_by) for r in out.collect()} == {1: ("promoted", 7), 2: ("rejected", 7), 3: ("pending", None)}
    assert {(r.draft_id, r.error) for r in errors.collect()} == {(1, "already promoted"), (99, "unknown draft")}
    s = U.queue_stats(out).first()
    assert (s.pending, s.promoted, s.rejected, s.total) == (1, 1, 1, 3) and U.queue_stats(out, "p0").first().total == 1
    audit = spark.createDataFrame([(1, json.dumps({"graph_written": True}))], "draft_id long, detail string")
    assert U.pending_graph_writes(out, audit).count() == 0 and U.pending_graph_writes(out, audit.where("false")).count() == 1


def test_queue_audit_and_payloads(spark):
    routed = spark.createDataFrame([("p", "draft"), ("p", "manual"), ("q", "auto_insert")], "paper_id string, routing string")
    queue, audit = U.queue_drafts(routed)
    assert queue.count() == 2 and [(r.paper_id, json.loads(r.detail)) for r in audit.collect()] == [("p", {"count": 2})]
    v = votes(spark, [(1, 1, 1), (1, 2, 1)])
    log = U.audit_log(U.resolve_drafts(drafts(spark, 1, 2), v)).collect()
    assert [(r.action, json.loads(r.detail)["graph_written"]) for r in log] == [("draft_promoted", False)]
    d = spark.createDataFrame([(1, "p", "entity", "promoted", json.dumps({"name": "BERT", "type": "Method", "confidence": 0.5}))], "id long, paper_id string, kind string, status string, payload string")
    p = U.promoted_payloads(d).first()
    assert (p.name, p.type, p.confidence) == ("BERT", "Method", 0.5)


def test_jobs(spark):
    docs = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b"), (4, None)], "doc_id long, text string")
    a = J.content_address(docs)
    assert sorted((r.doc_id, r.copies) for r in a.collect()) == [(1, 2), (3, 1), (4, 1)]
    assert J.skip_known(a, a.where("doc_id = 1")).count() == 2 and J.skip_known(a, a, force=True).count() == 3
    s = "doc_id string, task_id string, status string, error string, pages int"
    old = spark.createDataFrame([("d", "t", "RUNNING", None, 3)], s)
    up = spark.createDataFrame([("d", "t", "FAILED", "x", None, 1), ("d", "t", "COMPLETED", None, None, 2), ("e", "t", "QUEUED", None, None, 1)], s + ", seq int")
    got = {r.doc_id: (r.status, r.error, r.pages) for r in J.upsert_jobs(old, up).collect()}
    assert got == {"d": ("COMPLETED", "x", 3), "e": ("QUEUED", None, None)}


@pytest.mark.parametrize("errors,status", [({}, "COMPLETED"), ({"entities": "x"}, "PARTIAL"), ({"parsing": "x"}, "FAILED"), ({"OCR": "x", "entities": "y"}, "FAILED"), ({"entities": ""}, "COMPLETED")])
def test_run_status(spark, errors, status):
    rows = [("p", i, n, "done", errors.get(n), 1.0) for i, n in enumerate(("OCR", "parsing", "entities"))]
    steps = spark.createDataFrame(rows, "paper_id string, step_no int, step_name string, status string, error string, duration_ms double")
    assert J.run_status(steps).first().status == status
    r = J.run_report(steps, spark.createDataFrame([("p", "Method", 2)], "paper_id string, kind string, n int")).first()
    assert r.counts == {"Method": 2} and [s.step_name for s in r.steps] == ["OCR", "parsing", "entities"]


ATOM = """<entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A
  title</title><summary> Some  text </summary><published>2021-01-01T00:00:00Z</published><updated>2021-02-01T00:00:00Z</updated>
<author><name>Ann  B</name></author><author><name>Bob</name></author><category term="cs.LG"/><link title="doi" href="http://dx.doi.org/10.1/x"/><link title="pdf" href="u"/></entry>"""


def test_atom_entries(spark):
    df = spark.createDataFrame([(ATOM,), ("<entry><title>Error</title></entry>",), ("<entry></entry>",)], "xml string")
    r = io.parse_atom(df).collect()
    assert len(r) == 1
    assert (r[0].arxiv_id, r[0].versioned_id, r[0].title, r[0].abstract, r[0].authors, r[0].categories, r[0].doi) == ("2101.00001", "2101.00001v2", "A title", "Some text", ["Ann B", "Bob"], ["cs.LG"], "10.1/x")


def test_works(spark, tmp_path):
    work = {"id": "w1", "title": "T", "doi": "https://doi.org/10.1/A", "publication_year": 2020, "authorships": [{"author": {"display_name": "Ann"}, "institutions": [{"display_name": "U"}, {"display_name": "U"}]}, {"author": {"display_name": None}, "institutions": []}], "abstract_inverted_index": {"world": [1, 3], "hello": [0, 2]}, "concepts": [{"display_name": "c"}, {"display_name": None}], "referenced_works": ["w2"]}
    (tmp_path / "w.json").write_text(json.dumps(work))
    r = M.normalize_work(io.read_works(spark, str(tmp_path))).first()
    assert (r.doi, r.authors, r.institutions, r.concepts, r.abstract) == ("10.1/a", ["Ann"], ["U"], ["c"], "hello world hello world")


def test_matching_cascade_and_title_recall(spark):
    rng = random.Random(3)
    words = ["graph", "neural", "attention", "learning", "deep", "retrieval", "language", "models", "sparse", "transfer", "vision", "speech"]
    titles = [" ".join(rng.sample(words, 6)) + f" number{i}" for i in range(60)]
    works = spark.createDataFrame([(f"w{i}", None, None, t) for i, t in enumerate(titles)] + [("wd", "10.1/X", None, "Other"), ("wa", None, "2101.00001", "Other")], "work_id string, doi string, arxiv_id string, title string")
    near = [t.replace("learning", "Learning!").replace("models", "model") for t in titles]
    papers = spark.createDataFrame([(f"p{i}", None, None, t) for i, t in enumerate(near)] + [("d", "https://doi.org/10.1/x", "2101.00001", "x"), ("a", None, "arXiv:2101.00001v3", "x"), ("n", None, None, "short")], "paper_id string, doi string, arxiv_id string, title string")
    got = {r.paper_id: (r.work_id, r.match_method) for r in M.match_works(papers, works).collect()}
    assert got["d"] == ("wd", "doi") and got["a"] == ("wa", "arxiv_id") and "n" not in got
    want = {}
    for i, a in enumerate(near):
        best = max((M._ratio(a, b), -j) for j, b in enumerate(titles))
        if best[0] >= 0.9:
            want[f"p{i}"] = f"w{-best[1]}"
    found = {p: w for p, (w, m) in got.items() if m == "title"}
    assert len(set(want.items()) & set(found.items())) >= 0.95 * len(want)


def test_citation_enrichment_fills_only_what_is_missing(spark, tmp_path):
    rec = {"key": "doi:10.1/a", "title": "Record", "abstract": "abs", "venue": "", "year": 2000, "citationCount": 5, "authors": [{"name": "Z"}], "tldr": {"text": "short"}}
    (tmp_path / "r.json").write_text(json.dumps(rec))
    records = M.normalize_records(io.read_citation_records(spark, str(tmp_path)))
    c = spark.createDataFrame([("p", 0, "Own", ["A"], 1999, "10.1/A", None, "1", ["1"]), ("p", 1, "", None, None, "10.1/a", None, "2", ["2"]), ("q", 0, "None", None, None, None, "2101.1", "1", ["1"])], "paper_id string, pos int, title string, authors array<string>, year int, doi string, arxiv_id string, ref_id string, ref_ids array<string>")
    got = {(r.paper_id, r.pos): r for r in M.enrich_citations(c, records).collect()}
    assert (got["p", 0].title, got["p", 0].s2_title, got["p", 0].authors, got["p", 0].year) == ("Own", "Record", ["A"], 1999)
    assert (got["p", 1].title, got["p", 1].s2_title, got["p", 1].authors, got["p", 1].year, got["p", 1].venue, got["p", 1].tldr.source) == ("Record", None, ["Z"], 2000, None, "unknown")
    rate = {r.paper_id: (r.lookable, r.found, r.hit_rate) for r in M.enrichment_hit_rate(c, records).collect()}
    assert rate == {"p": (2, 2, 1.0), "q": (1, 0, 0.0), None: (3, 2, 0.667)}


def test_catalogue_values_override(spark):
    parsed = spark.createDataFrame([("p", "Parsed", "abs", None, "2101.1"), ("q", "Q", None, "10.1/q", None)], "paper_id string, title string, abstract string, doi string, arxiv_id string")
    m = spark.createDataFrame([("p", "Catalogue", " ", "10.1/p", 2020, ["A"])], "paper_id string, w_title string, w_abstract string, w_doi string, w_year int, w_authors array<string>")
    got = {r.paper_id: r for r in M.enrich_papers(parsed, m).collect()}
    assert (got["p"].title, got["p"].abstract, got["p"].doi, got["p"].year, got["p"].authors) == ("Catalogue", "abs", "10.1/p", 2020, ["A"])
    assert (got["q"].title, got["q"].year, got["q"].authors) == ("Q", None, [])


def test_similar_titles_equal_all_pairs(spark, monkeypatch):
    """Typos, short words only, repeated grams, common grams in blocks: no pair of a ratio of 0.9 or more is lost."""
    monkeypatch.setattr(M, "GRAM_BLOCK", 5)
    rng = random.Random(3)
    words = "a an of to in on is it we do go net set map tree deep graph model learning attention aaaa aaa".split()
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) for _ in range(70)]

    def typo(t):
        for _ in range(rng.choice([1, 1, 2, 4, 7])):
            i = rng.randrange(len(t))
            t = rng.choice([t[:i] + t[i + 1 :], t[:i] + rng.choice("abcxyz ") + t[i:], t[:i] + rng.choice("abcxyz") + t[i + 1 :], t[i:] + t[:i] if rng.random() < 0.1 else t])
        return t

    papers = [(f"p{i}", t) for i, t in enumerate(titles)] + [("none", None), ("short", "a b")]
    works = [(f"w{i}", typo(t).title()) for i, t in enumerate(titles * 2)] + [("x", None), ("y", "")]
    schema = lambda i: f"{i} string, title string"
    got = {(r.paper_id, r.work_id): r.ratio for r in M.similar_titles(spark.createDataFrame(papers, schema("paper_id")), spark.createDataFrame(works, schema("work_id"))).collect()}
    clean = lambda t: "".join(c for c in (t or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789 ").strip()
    want = {(p, w): M._ratio(a, b) for p, a in papers for w, b in works if len(clean(a)) >= 10 and M._ratio(a, b) >= 0.9}
    assert got == want and len(want) > 60
    assert any(r < 0.93 for r in want.values())


def test_broken_records_are_kept_apart_whatever_is_selected(spark, tmp_path):
    lines = ['{"id": "w1", "title": "T", "publication_year": 2020}', "", '{"id": "w2", "publication_year": "no year"}', '{"id": "w3", "title": "cut', "not JSON", '{"id": "w4"}']
    (tmp_path / "w.json").write_text("\n".join(lines))
    works = io.read_works(spark, str(tmp_path))
    assert {r.id for r in works.select("id").collect()} == {r.id for r in works.select("id", "publication_year").collect()} == {"w1", "w4"} and works.count() == 2
    broken = io.broken_records(spark, str(tmp_path), "works").collect()
    assert sorted(r.record for r in broken) == sorted(lines[2:5]) and all(r.file.endswith("w.json") for r in broken)


def test_feeds_are_split_at_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f"<feed><title>t</title>{ATOM}\n{ATOM}</feed>")
    (tmp_path / "b.xml").write_text("<feed></feed>")
    got = io.parse_atom(io.read_entries(spark, str(tmp_path))).collect()
    assert [r.arxiv_id for r in got] == ["2101.00001"] * 2


def test_best_titles_equal_best_of_all_pairs(spark):
    """Titles that are all alike: only numbers differ; some lack characters, some have more, some occur twice."""
    rng = random.Random(5)
    near = lambda: f"study{rng.randrange(3000)} concerning matters"
    titles = [near() for _ in range(60)] + [near().replace("concern", rng.choice(["concrn", "conern", "xxconcern"])) for _ in range(30)]
    titles += ["".join(rng.choice("ab ") for _ in range(rng.randrange(9, 14))) for _ in range(40)] + [f"on {rng.randrange(10**9)} and the long title of a work that has more than forty characters" for _ in range(20)]
    papers = [(f"p{i}", t) for i, t in enumerate(titles[::2] + titles[:5])]
    works = [(f"w{i:03d}", t) for i, t in enumerate(titles[1::2] + titles[:3] + titles[:2])]
    want = {}
    for p, a in papers:
        pairs = [(-M._ratio(a, b), w) for w, b in works] if len(a.strip()) >= M.LEAST_TITLE else []
        if pairs and -min(pairs)[0] >= 0.9:
            want[p] = (min(pairs)[1], -min(pairs)[0])
    got = M.best_titles(spark.createDataFrame(papers, "paper_id string, title string"), spark.createDataFrame(works, "work_id string, title string"))
    assert {r.paper_id: (r.work_id, r.ratio) for r in got.collect()} == want and len(want) > 40


def test_alike_titles_meet_by_near_spellings(spark, monkeypatch):
    """Titles that differ in a digit never reach the comparison by common grams, which would be one of all pairs."""
    seen = []
    whole = M.similar_titles
    monkeypatch.setattr(M, "similar_titles", lambda p, w, t: seen.append(p.count()) or whole(p, w, t))
    title = F.concat(F.lit("Study"), F.col("id"), F.lit(" concerning matters"))
    papers = spark.range(1000, 3000).select(F.col("id").cast("string").alias("paper_id"), title.alias("title"))
    works = spark.range(1000, 3000).where("id % 7 = 0").select(F.col("id").cast("string").alias("work_id"), title.alias("title"))
    got = M.best_titles(papers, works).collect()
    assert len(got) == 2000 and seen == [0] and all(r.ratio == 1 for r in got if r.paper_id == r.work_id)
