"""Building, merging and repairing the property graph.

Nodes: ``node_id, node_type, name, paper_id, properties map<string,string>``.
Edges: ``source_id, source_type, edge_type, target_id, target_type, evidence,
confidence, properties``. Properties that are missing are absent from the map.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.functions import vocab
from paperlake.operators.ontology import ontology, valid_edges
from paperlake.sources.shared import written

SHARED = ["Method", "Dataset", "Task", "Metric"]
NODE = ["node_id", "node_type", "name", "paper_id", "properties"]
EDGE = ["source_id", "source_type", "edge_type", "target_id", "target_type", "evidence", "confidence", "properties"]


def properties(**cols: Column) -> Column:
    """A map of the values that aren't null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in cols.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x.value.isNotNull()))


def paper_node_id(paper_id: Column) -> Column:
    return F.concat(F.lit("paper_"), paper_id)


def author_node_id(name: Column) -> Column:
    return F.concat(F.lit("author_"), X.short_hash(name))


def section_node_id(paper_id: Column, heading: Column) -> Column:
    return F.concat_ws("_", F.lit("section"), paper_id, X.short_hash(heading))


def entity_node_id(paper_id: Column, kind: Column, name: Column) -> Column:
    h = X.short_hash(F.lower(F.trim(name)))
    return F.when(kind.isin(SHARED), F.concat_ws("_", F.lower(kind), h)).otherwise(F.concat_ws("_", F.lower(kind), paper_id, h))


def cited_paper_id(paper_id: Column, doi: Column, arxiv_id: Column, ref_id: Column, title: Column) -> Column:
    own = F.coalesce(X.blank_to_null(ref_id), X.short_hash(F.coalesce(title, F.lit("unknown"))))
    return F.coalesce(
        F.concat(F.lit("doi_"), F.lower(X.blank_to_null(doi))), F.concat(F.lit("arxiv_"), F.lower(X.blank_to_null(arxiv_id))), F.concat_ws("_", F.lit("ref"), paper_id, own)
    )


def _node(df: DataFrame, node_id: Column, kind: Column | str, name: Column, paper_id: Column, props: Column, rank: Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(node_id.alias("node_id"), kind.alias("node_type"), name.alias("name"), paper_id.alias("paper_id"), props.alias("properties"), (rank if rank is not None else F.lit("")).alias("rank"))


def _edge(df: DataFrame, source_id: Column, source_type: str | Column, edge_type: str | Column, target_id: Column, target_type: str | Column, evidence: Column | None = None, confidence: float = 1.0, props: Column | None = None, rank: Column | None = None) -> DataFrame:
    s, e, t = (F.lit(x) if isinstance(x, str) else x for x in (source_type, edge_type, target_type))
    none = F.lit(None).cast("string")
    return df.select(
        source_id.alias("source_id"), s.alias("source_type"), e.alias("edge_type"), target_id.alias("target_id"), t.alias("target_type"),
        (none if evidence is None else evidence).alias("evidence"), F.lit(confidence).alias("confidence"),
        (F.create_map().cast("map<string,string>") if props is None else props).alias("properties"), (F.lit("") if rank is None else rank).alias("rank"),
    )


def _rank(*cols: Column) -> Column:
    """Order within a builder: first wins."""
    return F.concat_ws("/", *[F.lpad(c.cast("string"), 10, "0") for c in cols])


def paper_nodes(papers: DataFrame) -> DataFrame:
    some = lambda c: X.blank_to_null(F.col(c))
    names = F.when(F.size("authors") > 0, F.to_json("authors"))
    props = properties(title=some("title"), abstract=F.substring(some("abstract"), 1, 2000), year=F.nullif("year", F.lit(0)), author_names=names, arxiv_id=some("arxiv_id"), doi=some("doi"), is_stub=F.lit("false"))
    return _node(papers, paper_node_id(F.col("paper_id")), "Paper", F.coalesce(some("title"), F.col("paper_id")), F.col("paper_id"), props)


def author_nodes(papers: DataFrame) -> DataFrame:
    a = papers.select("paper_id", F.posexplode("authors").alias("i", "author"))
    return _node(a, author_node_id(F.col("author")), "Author", F.col("author"), F.lit(""), properties(name=F.col("author")), F.col("paper_id"))


def written_by(papers: DataFrame) -> DataFrame:
    a = papers.select("paper_id", F.posexplode("authors").alias("i", "author"))
    return _edge(a, paper_node_id(F.col("paper_id")), "Paper", "WRITTEN_BY", author_node_id(F.col("author")), "Author", rank=_rank(F.col("i")))


def section_nodes(sections: DataFrame) -> DataFrame:
    nid = section_node_id(F.col("paper_id"), F.col("heading"))
    props = properties(heading=F.col("heading"), section_id=nid, text_preview=F.substring(X.blank_to_null(F.col("text")), 1, 500))
    return _node(sections, nid, "Section", F.col("heading"), F.col("paper_id"), props, _rank(F.col("idx")))


def has_section(sections: DataFrame) -> DataFrame:
    return _edge(sections, paper_node_id(F.col("paper_id")), "Paper", "HAS_SECTION", section_node_id(F.col("paper_id"), F.col("heading")), "Section", rank=_rank(F.col("idx")))


def distinct_entities(entities: DataFrame) -> DataFrame:
    """The first of each (paper, type, lower name), with its node id; unknown types go."""
    e = entities.where(F.col("type").isin(vocab.NODE_TYPES) & X.blank_to_null(F.col("name")).isNotNull())
    extra = [c for c in ("role", "evidence", "source_section") if c in e.columns]
    first = e.groupBy("paper_id", "type", F.lower("name").alias("low")).agg(F.min_by(F.struct("name", "pos", *extra), "pos").alias("f"))
    return first.select("paper_id", "type", "low", "f.*", entity_node_id(F.col("paper_id"), F.col("type"), F.col("f.name")).alias("node_id"))


def entity_nodes(distinct: DataFrame) -> DataFrame:
    some = lambda c: X.blank_to_null(F.col(c)) if c in distinct.columns else F.lit(None).cast("string")
    props = properties(evidence=some("evidence"), source_section=some("source_section"))
    return _node(distinct, F.col("node_id"), F.col("type"), F.trim("name"), F.col("paper_id"), props, F.concat_ws("/", "paper_id", _rank(F.col("pos"))))


def entity_edges(distinct: DataFrame) -> DataFrame:
    """The role's edge if the ontology has it, else MENTIONS (without evidence) if it has that, else none."""
    o = F.broadcast(ontology(distinct.sparkSession).where("source_type = 'Paper'").select(F.col("edge_type").alias("e"), F.col("target_type").alias("t")))
    role = F.coalesce(*[F.when(F.col("role") == r, F.lit(e)) for r, e in vocab.ROLE_EDGES.items()], F.lit("MENTIONS"))
    d = distinct.withColumn("wanted", role)
    by_role = d.join(o, (F.col("wanted") == F.col("e")) & (F.col("type") == F.col("t")), "left").withColumnRenamed("e", "by_role").drop("t")
    full = by_role.join(o, (F.lit("MENTIONS") == F.col("e")) & (F.col("type") == F.col("t")), "left").withColumn("edge", F.coalesce("by_role", "e")).where("edge is not null")
    evidence = F.when(F.col("by_role").isNotNull(), F.col("evidence"))
    return _edge(full, paper_node_id(F.col("paper_id")), "Paper", F.col("edge"), F.col("node_id"), F.col("type"), evidence, rank=_rank(F.col("pos")))


def relation_edges(relations: DataFrame, distinct: DataFrame) -> DataFrame:
    """Both ends must be entities of the paper, by type and lower name."""
    ends = lambda s: distinct.select("paper_id", F.col("type").alias(f"{s}_type"), F.col("low").alias(f"{s}_low"), F.col("node_id").alias(f"{s}_id"))
    r = relations.withColumns({"source_low": F.lower("source"), "target_low": F.lower("target")})
    r = r.join(ends("source"), ["paper_id", "source_type", "source_low"]).join(ends("target"), ["paper_id", "target_type", "target_low"])
    e = _edge(r, F.col("source_id"), F.col("source_type"), F.col("relation"), F.col("target_id"), F.col("target_type"), F.col("evidence"), rank=F.concat_ws("/", "paper_id", _rank(F.col("pos"))))
    return valid_edges(e).select(*e.columns)


def citation_stubs(citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stub nodes and CITES edges; citations without title, doi and arXiv id are skipped."""
    some = lambda c: X.blank_to_null(F.col(c))
    c = citations.where(F.coalesce(some("title"), some("doi"), some("arxiv_id")).isNotNull())
    c = c.withColumn("cited", cited_paper_id(F.col("paper_id"), F.col("doi"), F.col("arxiv_id"), F.col("ref_id"), F.col("title")))
    names = F.when(F.size("authors") > 0, F.to_json("authors"))
    props = properties(is_stub=F.lit("true"), source_paper_id=F.col("paper_id"), title=some("title"), doi=some("doi"), arxiv_id=some("arxiv_id"), year=F.nullif("year", F.lit(0)), author_names=names, ref_id=some("ref_id"))
    rank = F.concat_ws("/", "paper_id", _rank(F.col("pos")))
    nodes = _node(c, paper_node_id(F.col("cited")), "Paper", F.coalesce(some("title"), F.col("cited")), F.col("cited"), props, rank)
    note = F.when(some("ref_id").isNotNull(), F.concat(F.lit("Referenced as ["), F.col("ref_id"), F.lit("]")))
    edges = _edge(c, paper_node_id(F.col("paper_id")), "Paper", "CITES", paper_node_id(F.col("cited")), "Paper", note, 0.9, properties(ref_id=some("ref_id")), rank)
    return nodes, edges


def dedupe_nodes(nodes: DataFrame, order: str = "rank") -> DataFrame:
    """The first of each node id; minima are combined before the shuffle, so hot nodes don't gather."""
    return nodes.groupBy("node_id").agg(F.min_by(F.struct(*[c for c in NODE if c != "node_id"]), F.struct(order, "node_type", "paper_id", "name")).alias("f")).select("node_id", "f.*")


def dedupe_edges(edges: DataFrame, order: str = "rank") -> DataFrame:
    rest = [c for c in EDGE if c not in ("source_id", "edge_type", "target_id")]
    got = edges.groupBy("source_id", "edge_type", "target_id").agg(F.min_by(F.struct(*rest), F.struct(order, F.coalesce("evidence", F.lit("")))).alias("f"))
    return got.select("source_id", "edge_type", "target_id", "f.*").select(*EDGE)


def build_graph(papers: DataFrame, sections: DataFrame, entities: DataFrame, relations: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all papers; a shared entity keeps its first paper's properties, papers come before stubs."""
    found = distinct_entities(entities)
    stubs, cites = citation_stubs(citations)
    order = lambda df, k: df.withColumn("rank", F.concat(F.lit(f"{k}/"), F.col("rank")))
    nodes = [order(n, k) for k, n in enumerate((paper_nodes(papers), author_nodes(papers), section_nodes(sections), entity_nodes(found), stubs))]
    edges = [order(e, k) for k, e in enumerate((written_by(papers), has_section(sections), entity_edges(found), relation_edges(relations, found), cites))]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return dedupe_nodes(union(nodes)), dedupe_edges(union(edges))


def _last_properties(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per property the last value written; ``seq`` orders the writes."""
    p = df.select(*keys, "seq", F.explode("properties").alias("k", "v")).groupBy(*keys, "k").agg(F.max_by("v", "seq").alias("v"))
    return p.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))


def merge_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row per node: each field and property by its last writer, absent ones keep their value. ``new`` carries ``seq`` (above 0)."""
    both = existing.select(*NODE, F.lit(0).cast("long").alias("seq")).unionByName(new.select(*NODE, F.col("seq").cast("long")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    fields = both.groupBy("node_id").agg(last("node_type"), last("name"), last("paper_id"))
    return fields.join(_last_properties(both, ["node_id"]), "node_id", "left").select(
        "node_id", "node_type", "name", "paper_id", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties")
    )


def merge_edge_rows(rows: DataFrame) -> DataFrame:
    """One row per (source, type, target): each field and property by its last writer."""
    keys = ["source_id", "edge_type", "target_id"]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    fields = rows.groupBy(*keys).agg(*[last(c) for c in ("source_type", "target_type", "evidence", "confidence")])
    return fields.join(_last_properties(rows, keys), keys, "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def merge_edges(existing: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """As for nodes, by (source, type, target); both ends must exist."""
    merged = merge_edge_rows(existing.select(*EDGE, F.lit(0).cast("long").alias("seq")).unionByName(new.select(*EDGE, F.col("seq").cast("long"))))
    have = lambda side: nodes.select(F.col("node_id").alias(side)).distinct()
    return merged.join(have("source_id"), "source_id", "left_semi").join(have("target_id"), "target_id", "left_semi").select(*EDGE)


def identities(nodes: DataFrame) -> DataFrame:
    """``key, node_id, paper_id, is_stub``: the doi and arXiv keys that papers have and placeholders stand for."""
    p = nodes.where("node_type = 'Paper'")
    stub = F.coalesce(F.col("properties")["is_stub"], F.lit("false")) == "true"
    doi, arxiv = (F.lower(X.blank_to_null(F.col("properties")[k])) for k in ("doi", "arxiv_id"))
    keys = F.array_compact(F.array(F.concat(F.lit("doi_"), doi), F.concat(F.lit("arxiv_"), arxiv)))
    wanted = F.when(F.col("paper_id").rlike("^(doi|arxiv)_"), F.array("paper_id")).otherwise(F.array().cast("array<string>"))
    return p.select(F.explode(F.when(stub, wanted).otherwise(keys)).alias("key"), "node_id", "paper_id", stub.alias("is_stub"))


def stub_moves(nodes: DataFrame) -> DataFrame:
    """``stub_id, real_id``: placeholders whose doi or arXiv id is a real paper's; of several papers the smallest id."""
    found = identities(nodes)
    real = found.where("not is_stub").groupBy("key").agg(F.min_by("node_id", "paper_id").alias("real_id"))
    return found.where("is_stub").select(F.col("node_id").alias("stub_id"), "key").join(real, "key").select("stub_id", "real_id")


def apply_moves(nodes: DataFrame, edges: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the placeholders of ``moves`` (read three times: pass a written table); their citations go to the real papers."""
    tagged = edges.join(moves.withColumnRenamed("stub_id", "target_id"), "target_id", "left")
    kept = tagged.where("real_id is null").select(*EDGE)
    moved = tagged.where("real_id is not null and edge_type = 'CITES' and source_id <> real_id")
    moved = _edge(moved, F.col("source_id"), "Paper", "CITES", F.col("real_id"), "Paper").withColumn("confidence", F.lit(None).cast("double"))
    out = kept.withColumn("rank", F.lit("0")).unionByName(moved.select(*EDGE).withColumn("rank", F.lit("1")))
    out = dedupe_edges(out).join(moves.select(F.col("stub_id").alias("source_id")), "source_id", "left_anti").select(*EDGE)
    return nodes.join(moves.select(F.col("stub_id").alias("node_id")), "node_id", "left_anti").select(*NODE), out


def resolve_stubs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stubs whose doi or arXiv id is a real paper's go, and their citations move there.

    A moved edge that is new has no properties; an edge that exists keeps its
    own; a paper never cites itself through a stub.
    """
    return apply_moves(nodes, edges, written(stub_moves(nodes), "moves"))


def curated_graph(drafts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and rejected rows of promoted drafts.

    ``drafts``: id, paper_id, kind, resolved_by, and fields of the payload: name,
    type, role, evidence, confidence, source, source_type, relation, target,
    target_type, perhaps source_section. Ids are those of the pipeline; ``curated``
    is set. Drafts that write the same node or edge do so in the order of their ids, the last
one's values stay. Rejected: unknown kinds and types, blank names and blank ends of a relation.
    """
    none = F.lit(None).cast("string")
    turn = F.coalesce(F.col("id").try_cast("long"), F.lit(1))
    e = drafts.where("kind = 'entity'").withColumn("pos", F.col("id"))
    good = F.coalesce(F.col("type").isin(vocab.NODE_TYPES), F.lit(False)) & X.blank_to_null(F.col("name")).isNotNull()
    ids = e.where(good).withColumn("node_id", entity_node_id(F.col("paper_id"), F.col("type"), F.col("name")))
    mark = properties(curated=F.lit("true"), curated_by=F.col("resolved_by"), evidence=X.blank_to_null(F.col("evidence")), source_section=X.blank_to_null(F.col("source_section")) if "source_section" in drafts.columns else none)
    paper = _node(ids, paper_node_id(F.col("paper_id")), "Paper", none, F.col("paper_id"), F.create_map().cast("map<string,string>"), turn)
    ent = _node(ids, F.col("node_id"), F.col("type"), F.trim("name"), F.col("paper_id"), mark, turn)
    o = F.broadcast(ontology(drafts.sparkSession))
    wanted = F.coalesce(*[F.when(F.col("role") == r, F.lit(x)) for r, x in vocab.ROLE_EDGES.items()], F.lit("MENTIONS"))
    ok = ids.withColumn("wanted", wanted).join(
        o.where("source_type = 'Paper'").select(F.col("edge_type").alias("wanted"), F.col("target_type").alias("type"), F.lit(True).alias("ok")), ["wanted", "type"], "left"
    )
    conf = F.coalesce(F.col("confidence"), F.lit(1.0))
    pe = _edge(ok, paper_node_id(F.col("paper_id")), "Paper", F.when(F.col("ok"), F.col("wanted")).otherwise("MENTIONS"), F.col("node_id"), F.col("type"), X.blank_to_null(F.col("evidence")), props=properties(curated=F.lit("true"), confidence=conf), rank=turn)
    r = drafts.where("kind = 'relation'")
    allowed = o.select("source_type", F.col("edge_type").alias("relation"), "target_type")
    named = X.blank_to_null(F.col("source")).isNotNull() & X.blank_to_null(F.col("target")).isNotNull()
    r = r.withColumn("named", named).join(allowed.withColumn("known", F.lit(True)), ["source_type", "relation", "target_type"], "left")
    fine = r.where("named and known")
    end = lambda s: _node(fine, entity_node_id(F.col("paper_id"), F.col(f"{s}_type"), F.col(s)), F.col(f"{s}_type"), F.trim(s), F.col("paper_id"), properties(curated=F.lit("true")), turn)
    re = _edge(fine, entity_node_id(F.col("paper_id"), F.col("source_type"), F.col("source")), F.col("source_type"), F.col("relation"), entity_node_id(F.col("paper_id"), F.col("target_type"), F.col("target")), F.col("target_type"), X.blank_to_null(F.col("evidence")), props=properties(curated=F.lit("true"), confidence=conf, curated_by=X.blank_to_null(F.col("resolved_by"))), rank=turn)
    which = ["id", "paper_id", "kind"]
    others = drafts.where("kind is null or kind not in ('entity', 'relation')").select(*which)
    rejected = e.where(~good).select(*which).unionByName(r.where("not named or known is null").select(*which)).unionByName(others)
    nodes, edges = reduce(DataFrame.unionByName, [paper, ent, end("source"), end("target")]), pe.unionByName(re)
    return merge_nodes(nodes.where("false"), nodes.withColumnRenamed("rank", "seq")), merge_edge_rows(edges.withColumnRenamed("rank", "seq")).select(*EDGE), rejected


def node_counts_by_label(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node_type")
