"""Whole workloads: corpus to graph, text to graded retrieval, extraction to review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators import chunks as V
from paperlake.operators import citations as C
from paperlake.operators import enrich as M
from paperlake.operators import entities as E
from paperlake.operators import graph as G
from paperlake.operators import parse as P
from paperlake.operators import relations as R
from paperlake.operators import routing as T
from paperlake.operators import vectors
from paperlake.sources.shared import written


@dataclass
class Extracted:
    parsed: DataFrame
    sections: DataFrame
    citations: DataFrame
    sentences: DataFrame
    entities: DataFrame
    relations: DataFrame


def extract(pages: DataFrame) -> Extracted:
    """Everything that is read out of page text. What feeds several branches is written down once: papers, citations, sentences, entities."""
    parsed = written(P.parse_papers(pages), "parsed")
    refs = C.extract_references(parsed.select("paper_id", "text"))
    citations = written(C.merge_duplicate_citations(C.normalize_citations(refs)), "citations")
    sents = written(E.sentences(parsed), "sentences")
    entities = written(E.extract_entities(sents), "entities")
    return Extracted(parsed, P.sections(parsed), citations, sents, entities, R.extract_relations(sents, entities))


def corpus_to_graph(pages: DataFrame, resolve: bool = True, extracted: Extracted | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a corpus; placeholders of cited papers that are in the corpus are resolved."""
    x = extracted or extract(pages)
    papers = x.parsed.select("paper_id", "title", "abstract", F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"), "arxiv_id", F.lower("doi").alias("doi"))
    nodes, edges = G.build_graph(papers, x.sections, x.entities, x.relations, x.citations)
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")  # asked more than once
    return G.resolve_stubs(nodes, edges) if resolve else (nodes, edges)


@dataclass
class Ingested:
    nodes: DataFrame
    edges: DataFrame
    queue: DataFrame
    matched: DataFrame


def catalogue_papers(parsed: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers with the values of their catalogue records, and which record each matched; others keep what was parsed."""
    w = written(M.normalize_work(works), "works")
    matched = written(M.match_works(parsed.select("paper_id", "doi", "arxiv_id", "title"), w), "matched")
    values = matched.select("paper_id", "work_id").join(w.select("work_id", *[F.col(c).alias(f"w_{c}") for c in ("title", "abstract", "doi", "year", "authors")]), "work_id")
    own = parsed.select("paper_id", "title", "abstract", F.lower("doi").alias("doi"), "arxiv_id")
    return M.enrich_papers(own, values.drop("work_id")), matched


def ingest(
    pages: DataFrame, works: DataFrame, records: DataFrame, llm_entities: DataFrame | None = None, llm_relations: DataFrame | None = None,
    has_queue: bool = True, resolve: bool = True, extracted: Extracted | None = None,
) -> Ingested:
    """The whole ingestion: catalogue values of papers (``works``), values of cited papers (``records``), routing, graph.

    Extractions of both sources are merged where a model's are given; what is sure goes
    to the graph, what isn't to ``queue`` (``kind, paper_id, confidence, routing, payload``), and the
    discarded nowhere. Without a queue all but the discarded goes to the graph.
    """
    x = extracted or extract(pages)
    papers, matched = catalogue_papers(x.parsed, works)
    citations = M.enrich_citations(x.citations, M.normalize_records(records))
    kept, queued = {}, []
    for kind, own, llm in (("entity", x.entities, llm_entities), ("relation", x.relations, llm_relations)):
        routed = written(T.route(own if llm is None else T.merge_sources(own, llm, kind)), f"routed-{kind}")
        kept[kind], rest = T.split_routed(routed, has_queue)
        payload = F.to_json(F.struct(*[c for c in routed.columns if c not in ("paper_id", "confidence", "routing")]))
        queued.append(rest.select(F.lit(kind).alias("kind"), "paper_id", "confidence", "routing", payload.alias("payload")))
    nodes, edges = G.build_graph(papers, x.sections, kept["entity"], kept["relation"], citations)
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")  # asked more than once
    nodes, edges = G.resolve_stubs(nodes, edges) if resolve else (nodes, edges)
    return Ingested(nodes, edges, queued[0].unionByName(queued[1]), matched)


def text_to_vectors(pages: DataFrame, dim: int = vectors.DIM, extracted: Extracted | None = None) -> DataFrame:
    """Embedded chunks of a corpus, windows where a paper has no structure."""
    x = extracted or extract(pages)
    auto, _ = T.split_routed(T.route(x.entities))
    chunks = V.structured_chunks(x.parsed, auto)
    # only papers without an abstract can lack structured chunks: the texts of the others needn't become windows
    poor = written(x.parsed.where(X.blank_to_null(F.col("abstract")).isNull()).select(F.col("paper_id").alias("poor")), "poor")
    if not poor.isEmpty():
        chunks = V.chunks_with_fallback(chunks, V.word_window_chunks(pages.join(poor, F.col("paper_id").eqNullSafe(F.col("poor")), "left_semi")))
    return vectors.embed(V.chunk_ids(chunks), dim=dim)


def extraction_to_queue(heuristic: DataFrame, llm: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """What goes to the graph and what to the review queue, from both extractors."""
    return T.split_routed(T.route(T.merge_sources(heuristic, llm, kind)))
