"""The stored graph: merges equal the batch job's, only touched buckets change, failed commits leave the last version."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperlake.operators import graph as G
from paperlake.sources.graph_store import GraphStore
from paperlake.sources.shared import written

NODE = "node_id string, node_type string, name string, paper_id string, properties map<string,string>"
EDGE = "source_id string, source_type string, edge_type string, target_id string, target_type string, evidence string, confidence double, properties map<string,string>"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, "Paper", name, i, props) for i, name, props in rows], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(s, "Paper", "CITES", t, "Paper", ev, 0.9, props) for s, t, ev, props in rows], EDGE)


def batches(spark, n=4, size=40):
    for k in range(n):
        ids = [f"p{(k * 7 + i * 3) % 90}" for i in range(size)]
        yield (
            nodes(spark, *[(i, None if k % 2 and j % 3 == 0 else f"{i} of {k}", {"last": str(k)} | ({f"k{k % 3}": str(k)} if j % 2 else {})) for j, i in enumerate(dict.fromkeys(ids))]),
            edges(spark, *{(a, b): (a, b, None if k % 3 == 0 else f"e{k}", {"last": str(k)}) for a, b in zip(ids, ids[1:], strict=False) if a != b}.values()),
        )


def plain(graph):
    n, e = graph
    return sorted((r.node_id, r.node_type, r.name, r.paper_id, tuple(sorted(r.properties.items()))) for r in n.collect()), sorted(
        (r.source_id, r.edge_type, r.target_id, r.evidence or "", tuple(sorted(r.properties.items()))) for r in e.collect()
    )


def test_commits_equal_one_merge(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), buckets=8, most_parts=2)
    all_nodes = all_edges = None
    for k, (n, e) in enumerate(batches(spark)):
        assert store.commit(k, n, e)
        assert not store.commit(k, n.limit(0), e)  # run again
        n, e = n.withColumn("seq", F.lit(k + 1)), e.withColumn("seq", F.lit(k + 1))
        all_nodes, all_edges = (n, e) if all_nodes is None else (all_nodes.unionByName(n), all_edges.unionByName(e))
        merged = G.merge_nodes(all_nodes.where("false"), all_nodes)
        assert plain(GraphStore(spark, str(tmp_path)).read()) == plain((merged, G.merge_edges(all_edges.where("false"), all_edges, merged)))
    parts = [(r["kind"], r["bucket"]) for r in store._parts() if r["kind"] in ("nodes", "edges")]
    assert max(parts.count(p) for p in parts) <= 2
    assert store.buckets == GraphStore(spark, str(tmp_path), buckets=99).buckets == 8
    first = plain(store.read(version=1))
    assert len(first[0]) == 30 and all(dict(p)["last"] == "0" for *_, p in first[0])


def test_a_small_batch_touches_its_buckets_only(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), buckets=32, most_parts=2)
    store.commit(0, nodes(spark, *[(f"p{i}", "x", {}) for i in range(300)]), edges(spark, *[(f"p{i}", f"p{i + 1}", None, {}) for i in range(299)]))
    for k in (1, 2, 3):  # compaction included
        before = {(r["kind"], r["bucket"], r["part"]) for r in store._parts() if r["kind"] in ("nodes", "edges")}
        store.commit(k, nodes(spark, ("p1", f"y{k}", {}), ("new", "z", {})), edges(spark, ("new", "p7", None, {}), ("p1", "nowhere", None, {})))
        after = {(r["kind"], r["bucket"], r["part"]) for r in store._parts() if r["kind"] in ("nodes", "edges")}
        assert len({x[:2] for x in before ^ after}) <= 3
    n, e = store.read()
    assert n.where("node_id = 'p1'").first().name == "y3" and n.count() == 301
    assert e.where("target_id = 'nowhere'").count() == 0 and e.where("source_id = 'new'").count() == 1


def test_a_failed_commit_leaves_the_last_version(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), buckets=4)
    store.commit(0, nodes(spark, ("a", "first", {}), ("b", "b", {})), edges(spark, ("a", "b", None, {})))
    bad = nodes(spark, ("a", "second", {})).withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.commit(1, bad, edges(spark, ("b", "a", None, {})))
    assert plain(store.read())[0] == [("a", "Paper", "first", "a", ()), ("b", "Paper", "b", "b", ())] and store.version() == 1
    store.commit(1, nodes(spark, ("a", "second", {})), edges(spark, ("b", "a", None, {})))
    assert store.read()[0].where("name = 'second'").count() == 1 and store.read()[1].count() == 2


def test_moves_are_applied(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), buckets=4)
    store.commit(0, nodes(spark, ("paper_doi_x", None, {"is_stub": "true"}), ("paper_1", "one", {}), ("paper_2", "two", {})), edges(spark, ("paper_1", "paper_doi_x", "e", {}), ("paper_2", "paper_doi_x", "e", {})))
    moves = written(spark.createDataFrame([("paper_doi_x", "paper_1")], "stub_id string, real_id string"), "moves")
    assert store.commit(0, moves=moves, writer="resolve") and not store.commit(0, moves=moves, writer="resolve")
    store.commit(1, nodes(spark, ("paper_3", None, {}), ("paper_doi_x", None, {"is_stub": "true"})), edges(spark, ("paper_3", "paper_doi_x", None, {})))
    n, e = store.read()
    assert {r.node_id for r in n.collect()} == {"paper_1", "paper_2", "paper_3"}
    assert {(r.source_id, r.target_id) for r in e.collect()} == {("paper_2", "paper_1"), ("paper_3", "paper_1")}


def test_empty_store_and_empty_batch(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    assert [x.count() for x in store.read()] == [0, 0]
    assert store.commit(0, nodes(spark), edges(spark))
    assert [x.count() for x in store.read()] == [0, 0]


def test_file_size_does_not_make_a_broadcast(spark):
    """A hundred thousand rows in a file of a few kB stay off the driver until they have been measured."""
    one = written(spark.range(100_000).selectExpr("cast(id % 2 as string) as k", "repeat('x', 200) as v"), "small")
    other = written(spark.range(1_000_000).selectExpr("cast(id as string) as k", "id"), "large")
    plan = other.join(one, "k")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_a_merge_is_one_shuffle_and_known_ends_need_no_join(spark, tmp_path):
    rows = nodes(spark, ("p1", "a", {"x": "1", "y": "1"})).withColumn("seq", F.lit(1).cast("long"))
    rows = rows.unionByName(nodes(spark, ("p1", None, {"x": "2", "z": None})).withColumn("seq", F.lit(2).cast("long")))
    merged = GraphStore.merge("nodes", rows)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    (r,) = merged.collect()
    assert (r["name"], r.properties, r.seq) == ("a", {"x": "2", "y": "1", "z": None}, 2)
    n, e = nodes(spark, ("p1", "a", {}), ("p2", "b", {})), edges(spark, ("p1", "p2", None, {}))
    assert "Join" not in GraphStore(spark, str(tmp_path)).known_ends(n, e)._jdf.queryExecution().optimizedPlan().toString()
