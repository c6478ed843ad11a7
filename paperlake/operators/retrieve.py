"""Hybrid retrieval and grounded context, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.functions import vocab
from paperlake.operators import entities as E
from paperlake.operators.graph import paper_node_id
from paperlake.operators.graph_query import cited_papers, citing_papers, entities_for_paper, entity_relations
from paperlake.operators.traverse import Adjacency, expand_citations
from paperlake.operators.vectors import batch_vector_search, similarity
from paperlake.sources.shared import written

PLACE = "struct<name:string,type:string,paper_id:string>"
FACT = f"struct<subject:{PLACE},relation:string,object:{PLACE},evidence:string,source_paper_ids:array<string>>"
SNIPPET = 100


def route_queries(queries: DataFrame, force_mode: str | None = None) -> DataFrame:
    """Adds ``query_type, use_graph, use_vector``; ``force_mode`` graph, vector or both overrides the flags, any other leaves them to the query's class."""
    d = queries.withColumn("query_type", X.classify_query(F.coalesce("query", F.lit(""))))
    graph, vector = F.col("query_type").isin(vocab.WANTS_GRAPH), F.col("query_type").isin(vocab.WANTS_VECTOR)
    if force_mode in ("graph", "vector", "both"):
        graph, vector = F.lit(force_mode != "vector"), F.lit(force_mode != "graph")
    return d.withColumn("use_graph", graph).withColumn("use_vector", vector)


def _paper(pid: Column, name: Column) -> Column:
    return F.struct(name.alias("name"), F.lit("Paper").alias("type"), pid.alias("paper_id"))


def query_entity_facts(routed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts about entities that the query names: ``query_id, fact``."""
    q = routed.where("use_graph").select(F.col("query_id").alias("paper_id"), F.lit(0).alias("sec"), F.lit("Unknown").alias("section"), F.posexplode(E.split_sentences(F.col("query"))).alias("sent", "sentence"))
    named = written(E.extract_entities(q).select(F.col("paper_id").alias("query_id"), "name", "type"), "named")
    if named.isEmpty():  # the graph needn't be shuffled by its ends then
        return named.select("query_id", F.lit(None).cast(FACT).alias("fact"))
    facts = entity_relations(nodes, edges, named).withColumnRenamed("key_name", "name").withColumnRenamed("key_type", "type")
    ids = F.array_sort(F.array_distinct(F.filter(F.array("subject.paper_id", "object.paper_id"), lambda x: X.blank_to_null(x).isNotNull())))
    return named.join(facts, ["name", "type"]).select("query_id", F.struct("subject", "relation", "object", "evidence", ids.alias("source_paper_ids")).cast(FACT).alias("fact"))


def paper_facts(routed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Citing and cited papers and mentioned entities of the query's anchor paper: ``query_id, fact``."""
    q = routed.where("use_graph and paper_id is not null").select("query_id", F.col("paper_id").alias("key_id"))
    keys = q.select(F.col("key_id").alias("paper_id")).distinct()
    own = nodes.where("node_type = 'Paper'").select(F.col("paper_id").alias("key_id"), F.col("name").alias("key_title"))
    none = F.lit(None).cast("string")
    me, other = _paper(F.col("key_id"), F.col("key_title")), _paper(F.col("paper_id"), F.col("title"))

    def fact(df: DataFrame, s: Column, r: Column, o: Column, ev: Column, ids: Column) -> DataFrame:
        return df.join(own, "key_id").join(q, "key_id").select("query_id", F.struct(s.alias("subject"), r.alias("relation"), o.alias("object"), ev.alias("evidence"), ids.alias("source_paper_ids")).cast(FACT).alias("fact"))

    cites = F.lit("CITES")
    back = fact(citing_papers(nodes, edges, keys), other, cites, me, none, F.array_sort(F.array("paper_id", "key_id")))
    ahead = fact(cited_papers(nodes, edges, keys), me, cites, other, none, F.array("key_id"))
    thing = F.struct("name", F.col("node_type").alias("type"), none.alias("paper_id"))
    ent = fact(entities_for_paper(nodes, edges, keys), me, F.lit("MENTIONS"), thing, F.col("evidence"), F.array("key_id"))
    return back.unionByName(ahead).unionByName(ent)


def citation_paths(routed: DataFrame, nodes: DataFrame, edges: DataFrame, **more) -> DataFrame:
    """Walks from the anchor paper, for evolution questions: ``query_id`` and the path's columns."""
    q = routed.where("use_graph and query_type = 'EVOLUTION' and paper_id is not null").select("query_id", paper_node_id(F.col("paper_id")).alias("seed"))
    return expand_citations(nodes, edges, q.select(F.col("seed").alias("node_id")).distinct(), **more).join(q, "seed")


def citation_path_facts(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The last step of each path as a CITES fact, in the direction it was walked."""
    t = nodes.where("node_type = 'Paper'").select(F.col("node_id").alias("before"), F.col("name").alias("b_title"), F.col("paper_id").alias("b_id"))
    d = paths.withColumn("before", F.element_at("path", -2)).join(t, "before")
    last, prev = _paper(F.col("paper_id"), F.col("title")), _paper(F.col("b_id"), F.col("b_title"))
    ahead = F.col("direction") == "forward"
    ids = F.array_sort(F.array_distinct(F.array("b_id", "paper_id")))
    return d.select("query_id", F.struct(F.when(ahead, prev).otherwise(last).alias("subject"), F.lit("CITES").alias("relation"), F.when(ahead, last).otherwise(prev).alias("object"), F.lit(None).cast("string").alias("evidence"), ids.alias("source_paper_ids")).cast(FACT).alias("fact"))


def vector_hits(routed: DataFrame, chunks: DataFrame, k: int = 5, node_type: str | None = None) -> DataFrame:
    """``query_id, rank, score`` and the chunk's paper, section, text and node; queries carry ``query_embedding``.

    A query with a paper is answered from that paper's chunks only: those are few,
    so they meet the query by an equi-join on the paper. ``node_type`` limits both kinds.
    """
    more = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("node_name", "node_type")]
    chunks = chunks.select("id", "paper_id", "section", "text", "embedding", *more)
    if node_type is not None:
        chunks = chunks.where(F.col("node_type") == node_type)
    asked = routed.where("use_vector")
    anywhere = batch_vector_search(asked.where("paper_id is null"), chunks, k)
    own = asked.where("paper_id is not null").select("query_id", "paper_id", "query_embedding").join(chunks.select("id", "paper_id", "embedding"), "paper_id")
    own = own.withColumn("score", similarity(F.col("embedding"), F.col("query_embedding"))).where("score is not null")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    own = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    hits = anywhere.unionByName(own.select(*anywhere.columns))
    return hits.join(chunks.select("id", "paper_id", "section", "text", "node_name"), "id")


def hybrid_retrieve(queries: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = 5, force_mode: str | None = None, hops: Adjacency | None = None) -> DataFrame:
    """One row per query (``query_id, query, paper_id, query_embedding``): facts, hits, paths, sorted source papers."""
    routed = route_queries(queries, force_mode)
    paths = citation_paths(routed, nodes, edges, hops=hops)
    facts = query_entity_facts(routed, nodes, edges).unionByName(paper_facts(routed, nodes, edges)).unionByName(citation_path_facts(paths, nodes))
    f = facts.distinct().groupBy("query_id").agg(F.sort_array(F.collect_list("fact")).alias("facts"))
    h = vector_hits(routed, chunks, k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "paper_id", "section", "text", "node_name"))).alias("hits"))
    p = paths.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("depth", "paper_id", "title", "path", "direction"))).alias("paths"))
    d = routed.drop("query_embedding")
    for part in (f, h, p):
        d = d.join(part, "query_id", "left")
    hit = "struct<rank:int,score:double,paper_id:string,section:string,text:string,node_name:string>"
    walk = "struct<depth:int,paper_id:string,title:string,path:array<string>,direction:string>"
    for c, t in (("facts", FACT), ("hits", hit), ("paths", walk)):
        d = d.withColumn(c, F.coalesce(c, F.array().cast(f"array<{t}>")))
    ids = F.concat(F.flatten(F.transform("facts", lambda x: x.source_paper_ids)), F.transform("hits", lambda x: x.paper_id), F.transform("paths", lambda x: x.paper_id))
    return d.withColumn("source_paper_ids", F.array_sort(F.array_distinct(F.filter(ids, lambda x: X.blank_to_null(x).isNotNull()))))


#: Evaluation's names of the modes; hybrid leaves the choice to the query's class.
MODES = {"graph": "graph", "vector": "vector", "hybrid": None}


def retrieve_modes(queries: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Every query in every mode, with context, as ``score_questions`` takes it (``id`` is the query's).

    The modes share the graph, which is written once, and the table of its hops, if any query walks.
    """
    queries, nodes, edges = written(queries, "queries"), written(nodes, "nodes"), written(edges, "edges")
    walks = route_queries(queries).where("query_type = 'EVOLUTION' and paper_id is not null")
    hops = None if walks.isEmpty() else Adjacency(edges, "both")
    parts = [build_context(hybrid_retrieve(queries, nodes, edges, chunks, k, force, hops)).withColumn("mode", F.lit(mode)) for mode, force in MODES.items()]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("query_id", "id")


def build_context(retrieved: DataFrame) -> DataFrame:
    """Rendered blocks in a fixed order, and source papers sorted by id with their first title that isn't null."""

    def line_of_fact(f: Column) -> Column:
        e = X.blank_to_null(f.evidence)
        note = F.when(e.isNotNull(), F.concat(F.lit(' (evidence: "'), f.evidence, F.lit('")'))).otherwise("")
        src = F.when(F.size(f.source_paper_ids) > 0, F.concat(F.lit(" [source: "), F.array_join(f.source_paper_ids, ", "), F.lit("]"))).otherwise("")
        return F.concat(F.lit("- "), F.coalesce(f.subject["name"], F.lit("?")), F.lit(" "), F.coalesce(f.relation, F.lit("RELATED_TO")), F.lit(" "), F.coalesce(f.object["name"], F.lit("?")), note, src)

    def line_of_hit(h: Column) -> Column:
        place = F.concat(F.coalesce(h.paper_id, F.lit("unknown")), F.when(X.blank_to_null(h.section).isNotNull(), F.concat(F.lit(" / "), h.section)).otherwise(""))
        return F.concat(F.lit("- ("), place, F.lit(') "'), X.strip(F.coalesce(h.text, F.lit(""))), F.lit('"'))

    def line_of_path(p: Column) -> Column:
        return F.concat(F.lit("- "), F.array_join(p.path, " -> "), F.lit(" (depth "), p.depth.cast("string"), F.lit(", "), p.direction, F.lit(")"))

    paper = lambda n: F.struct(n.paper_id.alias("id"), n["name"].alias("t"))
    bare = lambda c: F.struct(c.alias("id"), F.lit(None).cast("string").alias("t"))
    named = F.concat(
        F.flatten(F.transform("facts", lambda f: F.concat(F.transform(F.filter(F.array(f.subject, f.object), lambda n: n.type == "Paper"), paper), F.transform(f.source_paper_ids, bare)))),
        F.transform("hits", lambda h: bare(h.paper_id)),
        F.transform("paths", lambda p: F.struct(p.paper_id.alias("id"), p.title.alias("t"))),
    )
    # each paper's places stand together after sorting, the first with a title in front
    places = F.transform(F.filter(named, lambda x: X.blank_to_null(x.id).isNotNull()), lambda x, i: F.struct(x.id.alias("id"), X.blank_to_null(x.t).isNull().alias("bare"), i.alias("pos"), x.t.alias("t")))
    first = F.filter("places", lambda x, i: (i == 0) | (F.get("places", i - 1).id != x.id))
    title = lambda x: F.when(~x.bare, x.t)
    d = retrieved.withColumn("places", F.sort_array(places)).withColumn("source_papers", F.transform(first, lambda x: F.struct(x.id.alias("paper_id"), title(x).alias("title"))))
    block = lambda head, col, fn: F.when(F.size(col) > 0, F.concat_ws("\n", F.lit(head), F.array_join(F.transform(col, fn), "\n")))
    source = lambda s: F.concat(F.lit("- ["), s.paper_id, F.lit("] "), F.coalesce(X.blank_to_null(s.title), s.paper_id))
    text = F.concat_ws("\n\n", block("Graph facts:", "facts", line_of_fact), block("Text evidence:", "hits", line_of_hit), block("Citation paths:", "paths", line_of_path), block("Source papers:", "source_papers", source))
    return d.drop("places").withColumn("context_text", text)


NO_SOURCES = "No source papers were retrieved for this query."
NO_EVIDENCE = "No graph facts or text evidence were retrieved; answer may be unreliable."


def confidence_notes(context: DataFrame) -> DataFrame:
    notes = F.array_compact(F.array(F.when(F.size("source_papers") == 0, NO_SOURCES), F.when((F.size("facts") == 0) & (F.size("hits") == 0), NO_EVIDENCE)))
    return context.withColumn("confidence_notes", notes).withColumn("answerable", F.length(F.trim("context_text")) > 0)


def rag_context(hits: DataFrame, k: int = 5) -> DataFrame:
    """Per query: texts of the best k hits, each behind a rule, and citations with a short snippet."""
    w = Window.partitionBy("query_id").orderBy("rank")
    best = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    got = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "text", "paper_id", "score"))).alias("h"))
    cite = lambda x: F.struct(x.paper_id.alias("paper_id"), x.score.alias("score"), F.substring(x.text, 1, SNIPPET).alias("snippet"))
    return got.select("query_id", F.array_join(F.transform("h", lambda x: F.concat(F.lit("---\n"), x.text)), "\n").alias("context"), F.transform("h", cite).alias("citations"))
