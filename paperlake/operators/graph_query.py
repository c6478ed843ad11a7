"""Graph questions as joins. ``keys`` is a DataFrame of one column, so that many questions run at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.operators.graph import paper_node_id


def _papers(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'Paper'").select("node_id", "paper_id", F.col("name").alias("title"))


def _hop(nodes: DataFrame, edges: DataFrame, keys: DataFrame, start: str, end: str) -> DataFrame:
    k = keys.select(F.col("paper_id").alias("key_id"), paper_node_id(F.col("paper_id")).alias(start)).distinct()
    hop = edges.where("edge_type = 'CITES'").select("source_id", "target_id").join(k, start)
    return hop.join(_papers(nodes).withColumnRenamed("node_id", end), end).select("key_id", "paper_id", "title").distinct()


def citing_papers(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """``key_id, paper_id, title`` of papers that cite a key."""
    return _hop(nodes, edges, keys, "target_id", "source_id")


def cited_papers(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    return _hop(nodes, edges, keys, "source_id", "target_id")


def _by_name(nodes: DataFrame, kind: str, names: DataFrame) -> DataFrame:
    """Nodes of a type with one of the names; filtered before any edge is joined."""
    return nodes.where(F.col("node_type") == kind).select("node_id", "name").join(names.select("name").distinct(), "name")


def papers_using_method(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Only MENTIONS counts."""
    return _papers_with(nodes, edges, names, "Method", ["MENTIONS"])


def papers_using_dataset(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    return _papers_with(nodes, edges, names, "Dataset", ["USES_DATASET", "MENTIONS"])


def _papers_with(nodes: DataFrame, edges: DataFrame, names: DataFrame, kind: str, types: list[str]) -> DataFrame:
    t = _by_name(nodes, kind, names).withColumnRenamed("node_id", "target_id")
    e = edges.where(F.col("edge_type").isin(types) & (F.col("source_type") == "Paper")).select("source_id", "target_id").join(t, "target_id")
    return e.join(_papers(nodes).withColumnRenamed("node_id", "source_id"), "source_id").select("name", "paper_id", "title").distinct()


def _method_sources(nodes: DataFrame, edges: DataFrame, names: DataFrame, kind: str, types: list[str]) -> DataFrame:
    t = _by_name(nodes, kind, names).withColumnRenamed("node_id", "target_id")
    e = edges.where(F.col("edge_type").isin(types) & (F.col("source_type") == "Method")).select("source_id", "target_id", "evidence").join(t, "target_id")
    m = nodes.where("node_type = 'Method'").select(F.col("node_id").alias("source_id"), F.col("name").alias("method"))
    return e.join(m, "source_id").select("name", "method").distinct()


def methods_improving_upon(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    return _method_sources(nodes, edges, names, "Method", ["IMPROVES_UPON"])


def methods_evaluated_on(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    return _method_sources(nodes, edges, names, "Dataset", ["USES_DATASET", "EVALUATES_ON"])


def entities_by_type(nodes: DataFrame, kind: str, paper_id: str | None = None) -> DataFrame:
    d = nodes.where(F.col("node_type") == kind)
    return d if paper_id is None else d.where(F.col("paper_id") == paper_id)


def entities_for_paper(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """MENTIONS targets; evidence of the edge, else of the node."""
    k = keys.select(F.col("paper_id").alias("key_id"), paper_node_id(F.col("paper_id")).alias("source_id")).distinct()
    e = edges.where("edge_type = 'MENTIONS'").join(k, "source_id").select("key_id", F.col("target_id").alias("node_id"), F.col("evidence").alias("e"))
    return e.join(nodes, "node_id").select("key_id", "name", "node_type", F.coalesce("e", F.col("properties")["evidence"]).alias("evidence"))


def _end(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("node_id").alias(f"{side}_id"), F.struct("name", F.col("node_type").alias("type"), "paper_id").alias("subject" if side == "source" else "object"))


def entity_relations(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Every edge that touches a named entity (``name, type``), in its own direction: subject, relation, object, evidence."""
    ids = nodes.join(keys.select("name", F.col("type").alias("node_type")).distinct(), ["name", "node_type"]).select("node_id", F.col("name").alias("key_name"), F.col("node_type").alias("key_type"))
    e = edges.select("source_id", "target_id", F.col("edge_type").alias("relation"), "evidence")
    touching = e.join(ids.withColumnRenamed("node_id", "source_id"), "source_id").unionByName(e.join(ids.withColumnRenamed("node_id", "target_id"), "target_id")).distinct()
    return touching.join(_end(nodes, "source"), "source_id").join(_end(nodes, "target"), "target_id").select("key_name", "key_type", "subject", "relation", "object", "evidence")


def citation_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return nodes.where("node_type = 'Paper'"), edges.where("edge_type = 'CITES'").select("source_id", "target_id")


def citation_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = edges.where("edge_type = 'CITES'")
    out_, in_ = c.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("n_out")), c.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("n_in"))
    d = _papers(nodes).join(out_, "node_id", "left").join(in_, "node_id", "left")
    return d.select("paper_id", "title", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def paper_summary(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Per key: title, distinct sections, entities and citations (with title or doi), and their counts; each branch is grouped by itself."""
    k = keys.select("paper_id", paper_node_id(F.col("paper_id")).alias("source_id")).distinct()
    e = edges.join(k, "source_id").select("paper_id", "edge_type", F.col("target_id").alias("node_id"))
    t = e.join(nodes.select("node_id", "node_type", "name", "properties"), "node_id")
    prop = F.col("properties")
    sec = t.where("edge_type = 'HAS_SECTION'").groupBy("paper_id").agg(F.array_sort(F.collect_set(F.struct("name", prop["text_preview"].alias("preview")))).alias("sections"))
    ent = t.where("edge_type in ('INTRODUCES', 'USES_METHOD', 'USES_DATASET')").groupBy("paper_id").agg(F.array_sort(F.collect_set(F.struct("name", F.col("node_type").alias("type"), F.col("edge_type").alias("relation")))).alias("entities"))
    cit = t.where("edge_type = 'CITES'").where(F.coalesce(prop["title"], prop["doi"]).isNotNull()).groupBy("paper_id").agg(F.array_sort(F.collect_set(F.struct("node_id", prop["title"].alias("title"), prop["doi"].alias("doi")))).alias("citations"))
    d = keys.select("paper_id").distinct().join(_papers(nodes).select("paper_id", "title"), "paper_id")
    for x in (sec, ent, cit):
        d = d.join(x, "paper_id", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return d.select("paper_id", "title", "sections", "entities", "citations", size("sections").alias("n_sections"), size("entities").alias("n_entities"), size("citations").alias("n_citations"))
