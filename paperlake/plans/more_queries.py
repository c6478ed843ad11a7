"""More registered queries: the remaining operators, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.functions import vocab
from paperlake.operators import chunks as V
from paperlake.operators import citations as C
from paperlake.operators import curation as U
from paperlake.operators import enrich as M
from paperlake.operators import entities as E
from paperlake.operators import evaluate as N
from paperlake.operators import graph as G
from paperlake.operators import graph_query as Q
from paperlake.operators import jobs as J
from paperlake.operators import llm_output as L
from paperlake.operators import ontology as O
from paperlake.operators import parse as P
from paperlake.operators import relations as R
from paperlake.operators import retrieve as H
from paperlake.operators import routing as T
from paperlake.operators import vectors as VX
from paperlake.plans import workloads
from paperlake.plans.queries import _COS, _LINES, _RESOLVED, _ROUTE, _SCORE, _STEPS, REFS, _entity_graph, _points, _routed, _some_papers, case, citations, drafts, line_graph, own_pages, pages, parsed, register, title, votes
from paperlake.sources import io
from paperlake.sources import testcorpus as TC
from paperlake.sources.graph_store import GraphStore
from paperlake.sources.shared import shared_dir, written
from paperlake.streaming import streams

S = lambda c: c.cast("string")


def say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else S(p) for p in parts])


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TC.load(spark, sf_dir, "documents")


def doc_id() -> Column:
    return F.col("doc_id")


PID = "CAST(doc_id AS VARCHAR) AS paper_id"


# --- sources and parsing ------------------------------------------------------


@register("SELECT CAST(conv_id AS VARCHAR) AS paper_id, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def s2_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = TC.load(spark, sf_dir, "conversations").select(S(F.col("conv_id")).alias("paper_id"), F.col("turn").alias("page_num"), "text")
    return P.full_text(p).select("paper_id", F.md5("text").alias("digest"))


@register("SELECT o_orderkey, o_orderkey % 4 <> 2 AS ok FROM orders")
def s4_valid_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    made = F.when(k % 4 == 0, F.sha2(S(k), 256)).when(k % 4 == 1, say("arxiv-2101.", F.lpad(S(k % 100000), 5, "0"))).when(k % 4 == 2, say("bad-", k)).otherwise(say("arxiv-cs.LG/", F.lpad(S(k % 10000000), 7, "0")))
    return TC.load(spark, sf_dir, "orders").select("o_orderkey", X.valid_doc_id(made).alias("ok"))


@register("SELECT '2101.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS arxiv_id, 'Title ' || CAST(doc_id AS VARCHAR) AS title, '10.1/' || CAST(doc_id AS VARCHAR) AS doi FROM documents WHERE doc_id % 5 <> 0")
def s5_parse_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(doc_id() % 5 == 0, F.lit("Error")).otherwise(say("Title\n  ", doc_id()))
    xml = say("<entry><id>http://arxiv.org/abs/2101.", F.lpad(S(doc_id() % 100000), 5, "0"), "v1</id><title>", head, "</title><summary>s</summary><author><name>A</name></author><link title=\"doi\" href=\"http://dx.doi.org/10.1/", doc_id(), "\"/></entry>")
    return io.parse_atom(docs(spark, sf_dir).select(xml.alias("xml"))).select("arxiv_id", "title", "doi")


@register(f"SELECT {PID}, 4 AS n FROM documents")
def p2_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.full_text(pages(spark, sf_dir))
    return t.select("paper_id", F.size(F.filter(F.split("text", "\n"), lambda x: X.is_heading(X.strip(x)))).alias("n"))


# --- citations ------------------------------------------------------------------


@register("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_linenumber + 1 AS VARCHAR) || ',' || CAST(l_linenumber + 2 AS VARCHAR) || ',9' AS ids FROM lineitem")
def c5_numeric_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return TC.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(C.expand_numeric_group(say(n, "-", n + 2, ", 9; 5-1")), ",").alias("ids"))


@register("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS paper_id, CAST(l_linenumber AS VARCHAR) AS ref_id, 1 AS n FROM lineitem")
def c5_wide_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order cites all its lines by one range of ten thousand million numbers; those that it has are found."""
    li = TC.load(spark, sf_dir, "lineitem").select(S(F.col("l_orderkey")).alias("paper_id"), S(F.col("l_linenumber")).alias("ref_id"))
    texts = li.select("paper_id").distinct().withColumn("text", F.lit("See [1-9999999999]."))
    return C.find_mentions(texts, li).groupBy("paper_id", "ref_id").agg(F.count("*").alias("n"))


@register(f"WITH {REFS} SELECT CAST(d AS VARCHAR) AS paper_id, k AS pos, CASE WHEN way = 0 THEN '10.1234/p' || CAST(c AS VARCHAR) END AS doi, CAST(k + 1 AS VARCHAR) AS ref_id, {title('c')} AS title FROM refs")
def c6_normalized_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.normalize_citations(C.extract_references(P.full_text(pages(spark, sf_dir))))
    return c.where("title <> 'Again'").select("paper_id", F.col("pos").cast("long").alias("pos"), "doi", "ref_id", "title")


# --- entities and relations -------------------------------------------------------


_EDGE = "[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]"  # SQL: no part of a word, of any script


def _found(text: str, pattern: str) -> str:
    """SQL: whether a pattern that begins and ends with a word boundary is found in a text."""
    return f"regexp_matches({text}, '(?:^|{_EDGE}){pattern.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')}(?:$|{_EDGE})')"


def _terms_in(text: str, terms: list[str]) -> str:
    """SQL: the terms found between word boundaries, longer ones first."""
    found = ", ".join(f"CASE WHEN {_found(text, t)} THEN '{t}' END" for t in sorted(terms, key=lambda t: (-len(t), t)))
    return f"list_filter([{found}], lambda x: x IS NOT NULL)"


@register(f"""WITH d AS (SELECT doc_id, coalesce(text, '') || ' We ran ' || {case(vocab.METHODS, 'doc_id')} || ' on ' || {case(vocab.DATASETS, 'doc_id')} || ', nothing else.' AS t FROM documents)
SELECT doc_id, array_to_string(list_concat({_terms_in('t', vocab.METHODS)}, {_terms_in('t', vocab.DATASETS)}), ',') AS found FROM d""")
def e2_known_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every whole text, to which a sentence is added that names two."""
    t = say(F.coalesce("text", F.lit("")), " We ran ", TC.method(doc_id()), " on ", TC.dataset(doc_id()), ", nothing else.")
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.concat(E.known_terms(t, vocab.METHODS), E.known_terms(t, vocab.DATASETS)), ",").alias("found"))


@register(
    "WITH d AS (SELECT doc_id, coalesce(text, '') || ' here it runs with a Foo' || CAST(doc_id AS VARCHAR) || ' model on the Bar' || CAST(doc_id AS VARCHAR) || ' corpus for routing tasks, a routing problem, and reports a Baz score.' AS t FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS type, unnest(regexp_extract_all(t, '{p}', 1)) AS name FROM d" for kind, ps in E.CAPTURES.items() for p in ps)
)
def e3_capture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the patterns of each type capture in every whole text, to which a sentence is added that has some."""
    t = say(F.coalesce("text", F.lit("")), " here it runs with a Foo", doc_id(), " model on the Bar", doc_id(), " corpus for routing tasks, a routing problem, and reports a Baz score.")
    found = F.array(*[F.struct(F.lit(kind).alias("type"), E.capture_names(t, ps).alias("names")) for kind, ps in E.CAPTURES.items()])
    return docs(spark, sf_dir).select("doc_id", F.inline(found)).select("doc_id", "type", F.explode("names").alias("name"))


@register(f"""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' Results show that the ' ELSE ' Here is the ' END || CASE doc_id % 3 WHEN 0 THEN 'ablation' WHEN 1 THEN 'benchmark' ELSE 'baseline' END || ' of today.' AS t FROM documents)
SELECT doc_id, ({' OR '.join(_found('lower(t)', p) for p in vocab.CLAIMS)}) AS claim, CASE WHEN regexp_matches(t, '(?i)\\bablation\\b') THEN 'Results ablation' WHEN regexp_matches(t, '(?i)\\bbenchmark\\b') THEN 'Results benchmark' ELSE 'Results experiment' END AS experiment FROM d""")
def e4_claims_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and experiments of every whole text, to which a sentence is added that has some."""
    t = say(F.coalesce("text", F.lit("")), F.when(doc_id() % 2 == 0, " Results show that the ").otherwise(" Here is the "), F.when(doc_id() % 3 == 0, "ablation").when(doc_id() % 3 == 1, "benchmark").otherwise("baseline"), " of today.")
    return docs(spark, sf_dir).select("doc_id", X.any_match(t, vocab.CLAIMS).alias("claim"), E.experiment_name(t, F.lit("Results")).alias("experiment"))


@register("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Foo' || CAST(doc_id AS VARCHAR) WHEN 2 THEN 'Bar' || CAST(doc_id AS VARCHAR) ELSE NULL END AS name FROM documents")
def e5_clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(doc_id() % 4 == 0, S(doc_id())).when(doc_id() % 4 == 1, say(" (the  Foo", doc_id(), " model), ")).when(doc_id() % 4 == 2, say("Bar", doc_id(), ".")).otherwise("Method")
    return docs(spark, sf_dir).select("doc_id", X.clean_name(raw).alias("name"))


@register("SELECT doc_id, doc_id % 5 < 2 AS ok FROM documents")
def e6_plausible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = TC.pick(["Random Forest", "Mixture of Experts", "The Model", "BERT on SQuAD X", "This enables"], doc_id())
    return docs(spark, sf_dir).select("doc_id", X.plausible_name(raw).alias("ok"))


@register(
    "WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' We propose X.' WHEN 1 THEN ' We adopt X.' WHEN 2 THEN ' We train on X.' ELSE ' X is here.' END AS t FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS type, CASE " + " ".join(f"WHEN {_found('t', p)} THEN '{v}'" for p, v in cases) + " END AS role FROM d" for kind, cases in vocab.ROLES.items())
)
def e7_paper_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role that every whole text gives to an entity of each type."""
    t = say(F.coalesce("text", F.lit("")), TC.pick([" We propose X.", " We adopt X.", " We train on X.", " X is here."], doc_id()))
    kinds = F.array(*[F.lit(k) for k in vocab.ROLES])
    return docs(spark, sf_dir).select("doc_id", t.alias("t"), F.explode(kinds).alias("type")).select("doc_id", "type", X.paper_role(F.col("t"), F.col("type")).alias("role"))


def _pair_sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All sentences of every whole text and one that names two methods; these, one that isn't there, and a word of the text."""
    d = docs(spark, sf_dir)
    text = say(F.coalesce("text", F.lit("")), ". Foo", doc_id(), " beats Bar", doc_id(), " on Foo", doc_id(), "z.")
    s = d.select(S(doc_id()).alias("paper_id"), F.lit(0).alias("sec"), F.lit("x").alias("section"), F.posexplode(E.split_sentences(text)).alias("sent", "sentence"))
    names = [(say("Foo", doc_id()), "Method"), (say("Bar", doc_id()), "Method"), (say("Baz", doc_id()), "Method"), (F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]{4,}", 0), "Task")]
    e = d.select(S(doc_id()).alias("paper_id"), F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), n.alias("name"), F.lit(t).alias("type")) for i, (n, t) in enumerate(names)])))
    return s, e.where("name <> ''")


@register(f"""WITH d AS (SELECT doc_id, coalesce(text, '') || '. Foo' || CAST(doc_id AS VARCHAR) || ' beats Bar' || CAST(doc_id AS VARCHAR) || ' on Foo' || CAST(doc_id AS VARCHAR) || 'z.' AS t, regexp_extract(coalesce(text, ''), '[A-Za-z]{{4,}}') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(string_split(regexp_replace(regexp_replace(trim(t), '\\s+', ' ', 'g'), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))) AS x FROM d)
SELECT {PID}, w AS name FROM s WHERE w <> '' AND contains(' ' || regexp_replace(lower(x), '{_EDGE}+', ' ', 'g') || ' ', ' ' || lower(w) || ' ')
UNION ALL SELECT {PID}, 'Foo' || CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT {PID}, 'Bar' || CAST(doc_id AS VARCHAR) FROM documents""")
def r1_entities_in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.entities_in_sentences(*_pair_sentences(spark, sf_dir)).select("paper_id", "name")


@register(f"SELECT {PID}, 'Foo' AS source, 'IMPROVES_UPON' AS relation FROM documents UNION ALL SELECT {PID}, 'Bar', 'IMPROVES_UPON' FROM documents")
def r2_relation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relation_candidates(R.entities_in_sentences(*_pair_sentences(spark, sf_dir))).select("paper_id", F.substring("name_a", 1, 3).alias("source"), "relation")


# --- model output -------------------------------------------------------------------


def _responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers of every shape; names and evidence with white space of their own, and an item whose name is a number."""
    ev = say("We propose the Foo", doc_id(), " Net model in this very paper")
    item = say('{"name": " Foo', doc_id(), '\\n  Net ", "type": "Method", "evidence": "', F.regexp_replace(ev, " in ", r"  \\t in "), '", "confidence": ', doc_id() % 3, "}")
    bad = say('{"name": ', doc_id(), ', "type": "Method", "evidence": "', ev, '"}')
    raw = F.when(doc_id() % 4 == 0, say("[", item, ", ", bad, ", 5]")).when(doc_id() % 4 == 1, say("Sure.\n```json\n[", item, ", ", bad, "]\n```")).when(doc_id() % 4 == 2, item).otherwise("nothing to see")
    d = docs(spark, sf_dir)
    return d.select(S(doc_id()).alias("paper_id"), raw.alias("raw")), d.select(S(doc_id()).alias("paper_id"), say(F.coalesce("text", F.lit("")), "\n", ev, ".").alias("text"))


@register(f"SELECT {PID}, CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n FROM documents")
def l1_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir)[0].select("paper_id", F.size(L.parse_json_array(F.col("raw"))).alias("n"))


@register(f"""SELECT {PID}, 'Foo' || CAST(doc_id AS VARCHAR) || ' Net' AS name, 'We propose the Foo' || CAST(doc_id AS VARCHAR) || ' Net model in this very paper' AS evidence,
CAST(least(1, doc_id % 3) AS DOUBLE) AS confidence FROM documents WHERE doc_id % 4 <> 3""")
def l2_llm_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.validate_llm_entities(*_responses(spark, sf_dir)).select("paper_id", "name", "evidence", "confidence")


@register(f"""SELECT {PID}, 'foo' || CAST(doc_id AS VARCHAR) || ' net' AS source, 'BAR' AS target, 'Method' AS source_type, 'Dataset' AS target_type, 'USES_DATASET' AS relation FROM documents WHERE doc_id % 3 <> 2""")
def l3_llm_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that spell their ends in their own way; types come from the entities, and a third of the relations don't fit them."""
    ev = say("Foo", doc_id(), " Net outperforms the rest on Bar")
    edge = F.when(doc_id() % 3 == 2, "CITES").otherwise("USES_DATASET")
    d = docs(spark, sf_dir).select(
        S(doc_id()).alias("paper_id"), say('[{"source": "foo', doc_id(), '\\n net", "source_type": "Task", "target": "BAR ", "relation": "', edge, '", "evidence": "', ev, '"}]').alias("raw"), say(F.coalesce("text", F.lit("")), " ", ev).alias("text"), say("Foo", doc_id(), " Net").alias("foo")
    )
    e = d.select("paper_id", F.inline(F.array(F.struct(F.col("foo").alias("name"), F.lit("Method").alias("type")), F.struct(F.lit("Bar").alias("name"), F.lit("Dataset").alias("type"))))).withColumn("pos", F.lit(0))
    return L.validate_llm_relations(d, d, e).select("paper_id", "source", "target", "source_type", "target_type", "relation")


@register("SELECT doc_id, text IS NOT NULL AND length(text) >= 60 AND doc_id % 4 <> 3 AS grounded FROM documents")
def l4_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: is a stretch of 40 characters from a place that varies found in it? Each fourth one is altered."""
    at = F.pmod(doc_id() * 7919, F.greatest(F.length("text") - 40, F.lit(1))).cast("int") + 1
    stretch = F.when(F.length("text") >= 60, F.substring("text", at, F.lit(40))).otherwise("short")
    evidence = F.when(doc_id() % 4 == 3, say(stretch, " \u0001 of no text at all")).otherwise(stretch)
    return docs(spark, sf_dir).select("doc_id", F.coalesce(X.evidence_grounded(evidence, F.col("text")), F.lit(False)).alias("grounded"))


@register(f"WITH {_SCORE}, r AS (SELECT {_ROUTE} AS routing FROM scored) SELECT count(*) FILTER (WHERE routing = 'auto_insert') AS to_graph, count(*) FILTER (WHERE routing IN ('draft', 'manual')) AS to_queue FROM r")
def f4_split_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, queue = T.split_routed(_routed(spark, sf_dir))
    return graph.agg(F.count("*").alias("to_graph")).join(queue.agg(F.count("*").alias("to_queue")))


# --- enrichment -----------------------------------------------------------------------


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE '10.1/abc' || CAST(o_orderkey AS VARCHAR) END AS doi, '2101.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS arxiv_id FROM orders")
def m1_normalized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    doi = F.when(k % 3 == 0, say("https://doi.org/10.1/ABC", k)).when(k % 3 == 1, say("10.1/Abc", k)).otherwise(say("isbn", k))
    arxiv = say(F.when(k % 2 == 0, "arXiv:").otherwise("https://arxiv.org/pdf/"), "2101.", F.lpad(S(k % 100000), 5, "0"), F.when(k % 2 == 0, "v3").otherwise(".pdf"))
    return TC.load(spark, sf_dir, "orders").select("o_orderkey", X.normalize_doi(doi).alias("doi"), X.normalize_arxiv_id(arxiv).alias("arxiv_id"))


@register("SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 0 END AS DOUBLE) AS ratio FROM part")
def m2_title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = say("Title number ", k), F.when(k % 3 == 0, say("TITLE, number ", k, "!")).when(k % 3 == 1, "zzzz").otherwise("")
    return TC.load(spark, sf_dir, "part").withColumn("a", F.when(k % 3 == 1, "aaaa").otherwise(a)).withColumn("b", b).select("p_partkey", M.title_similarity(F.col("a"), F.col("b")).alias("ratio"))


@register("SELECT 'w' || CAST(doc_id AS VARCHAR) AS work_id, '10.1/a' || CAST(doc_id AS VARCHAR) AS doi, 'Ann' AS authors, 'Uni' || CAST(doc_id % 7 AS VARCHAR) AS institutions, 'alpha beta alpha d' || CAST(doc_id AS VARCHAR) AS abstract FROM documents")
def m4_normalized_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = lambda n, k: F.struct(F.struct(F.lit(n).cast("string").alias("display_name"), F.lit(None).cast("string").alias("orcid")).alias("author"), F.array_repeat(F.struct(say("Uni", k).alias("display_name")), 2).alias("institutions"))
    index = F.create_map(F.lit("alpha"), F.array(F.lit(0), F.lit(2)), F.lit("beta"), F.array(F.lit(1)), say("d", doc_id()), F.array(F.lit(3)))
    w = docs(spark, sf_dir).select(
        say("w", doc_id()).alias("id"), F.lit("t").alias("title"), say("https://doi.org/10.1/A", doc_id()).alias("doi"), F.lit(2020).alias("publication_year"), F.array(who("Ann", doc_id() % 7), who(None, doc_id() % 7)).alias("authorships"),
        index.alias("abstract_inverted_index"), F.array().cast("array<struct<display_name:string>>").alias("concepts"), F.array().cast("array<string>").alias("referenced_works"),
    )
    return M.normalize_work(w).select("work_id", "doi", F.array_join("authors", ",").alias("authors"), F.array_join("institutions", ",").alias("institutions"), "abstract")


@register("SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 3 = 0 THEN 'Catalogue' ELSE 'Own' END AS title, CASE WHEN doc_id % 3 = 0 THEN 2020 END AS year FROM documents")
def m6_enriched_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    p = docs(spark, sf_dir).select(S(doc_id()).alias("paper_id"), F.lit("Own").alias("title"), none.alias("abstract"), none.alias("doi"), none.alias("arxiv_id"))
    w = docs(spark, sf_dir).where(doc_id() % 3 <= 1).select(S(doc_id()).alias("paper_id"), F.when(doc_id() % 3 == 0, "Catalogue").otherwise(" ").alias("w_title"), none.alias("w_abstract"), none.alias("w_doi"), F.when(doc_id() % 3 == 0, 2020).otherwise(0).alias("w_year"), F.array().cast("array<string>").alias("w_authors"))
    return M.enrich_papers(p, w).select("paper_id", "title", "year")


@register("SELECT CAST(o_custkey AS VARCHAR) AS paper_id, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'Own' WHEN o_orderkey % 50 < 25 THEN 'Record' || CAST(o_orderkey % 50 AS VARCHAR) END AS title, CASE WHEN o_orderkey % 50 < 25 THEN 1990 END AS year FROM orders")
def m8_enriched_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = TC.load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    c = o.select(S(F.col("o_custkey")).alias("paper_id"), k.alias("pos"), F.when(k % 2 == 0, "Own").otherwise("").alias("title"), F.array().cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"), say("10.1/", k % 50).alias("doi"), none.alias("arxiv_id"), none.alias("ref_id"), F.array().cast("array<string>").alias("ref_ids"))
    r = o.select((k % 50).alias("n")).where("n < 25").distinct()
    records = r.select(
        say("doi:10.1/", F.col("n")).alias("key"), say("Record", F.col("n")).alias("title"), none.alias("abstract"), none.alias("venue"), F.lit(1990).alias("year"), F.lit(1).alias("citationCount"), F.lit(0).alias("influentialCitationCount"),
        F.array().cast("array<struct<name:string,authorId:string>>").alias("authors"), F.lit(None).cast("struct<model:string,text:string>").alias("tldr"),
    )
    return M.enrich_citations(c, M.normalize_records(records)).select("paper_id", "pos", "title", "year")


# --- graph ------------------------------------------------------------------------------


@register("SELECT c_custkey, 'author_' || substr(md5(c_name), 1, 12) AS author, 'method_' || substr(md5(lower(c_name)), 1, 12) AS method, 'claim_p_' || substr(md5(lower(c_name)), 1, 12) AS claim FROM customer")
def g2_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = TC.load(spark, sf_dir, "customer")
    n = F.col("c_name")
    return c.select("c_custkey", G.author_node_id(n).alias("author"), G.entity_node_id(F.lit("p"), F.lit("Method"), n).alias("method"), G.entity_node_id(F.lit("p"), F.lit("Claim"), n).alias("claim"))


@register("SELECT 'author_' || substr(md5('Author ' || CAST(o_custkey % 100 AS VARCHAR)), 1, 12) AS node_id, count(DISTINCT o_orderkey) AS papers FROM orders GROUP BY o_custkey % 100")
def g3_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = TC.load(spark, sf_dir, "orders").select(S(F.col("o_orderkey")).alias("paper_id"), F.array(say("Author ", F.col("o_custkey") % 100)).alias("authors"))
    ids = G.dedupe_nodes(G.author_nodes(o)).select("node_id")
    n = G.dedupe_edges(G.written_by(o)).groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("papers"))
    return ids.join(n, "node_id")


@register("""WITH e AS (SELECT l_orderkey AS a, l_partkey AS b, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_orderkey <> l_partkey),
old AS (SELECT DISTINCT a, b FROM e WHERE a % 4 = 0), n AS (SELECT a, b, max(CASE WHEN a % 8 <> 0 THEN seq END) AS seq FROM e GROUP BY a, b),
p AS (SELECT o_orderkey AS x FROM orders UNION SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)
SELECT 'paper_' || CAST(n.a AS VARCHAR) AS source_id, 'paper_' || CAST(n.b AS VARCHAR) AS target_id, coalesce(CAST(n.seq AS VARCHAR), CASE WHEN old.a IS NOT NULL THEN 'old' END) AS evidence
FROM n LEFT JOIN old ON n.a = old.a AND n.b = old.b WHERE n.a IN (SELECT x FROM p) AND n.b IN (SELECT x FROM p)""")
def g9_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each fourth paper exist already; new evidence replaces the old, absent evidence doesn't; odd parts have no node."""
    li = TC.load(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_orderkey"), "b": F.col("l_partkey"), "seq": F.col("l_orderkey") * 10 + F.col("l_linenumber")}).where("a <> b")
    node = lambda c: say("paper_", F.col(c))
    new = li.select(node("a").alias("source_id"), F.lit("Paper").alias("source_type"), F.lit("CITES").alias("edge_type"), node("b").alias("target_id"), F.lit("Paper").alias("target_type"), F.when(F.col("a") % 8 != 0, S(F.col("seq"))).alias("evidence"), F.lit(0.9).alias("confidence"), F.create_map().cast("map<string,string>").alias("properties"), "seq", "a")
    old = new.where("a % 4 = 0").withColumn("evidence", F.lit("old")).dropDuplicates(["source_id", "target_id"])
    ids = TC.load(spark, sf_dir, "orders").select(node("o_orderkey").alias("node_id")).union(TC.load(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(node("p_partkey").alias("node_id")))
    return G.merge_edges(old, new, ids).select("source_id", "target_id", "evidence")


@register("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 2")
def g11_curated_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    d = TC.load(spark, sf_dir, "orders").select(
        k.alias("id"), S(F.col("o_custkey")).alias("paper_id"), F.when(k % 2 == 0, "entity").otherwise("relation").alias("kind"), F.lit("u").alias("resolved_by"), say("M", k % 40).alias("name"), F.when(k % 3 == 2, "Nothing").otherwise("Method").alias("type"), none.alias("role"), F.lit("e").alias("evidence"), F.lit(None).cast("double").alias("confidence"),
        say("M", k % 40).alias("source"), F.lit("Method").alias("source_type"), F.when(k % 3 == 2, "CITES").otherwise("EXTENDS").alias("relation"), say("N", k % 40).alias("target"), F.lit("Method").alias("target_type"),
    )
    return G.curated_graph(d)[2].select("id")


_DS, _M, _M2 = case(vocab.DATASETS, "doc_id"), case(vocab.METHODS, "doc_id"), case(vocab.METHODS, "doc_id + 5")


@register(f"SELECT {_DS} AS name, {PID} FROM documents")
def q5_papers_using_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _entity_graph(spark, sf_dir)
    return Q.papers_using_dataset(nodes, edges, nodes.where("node_type = 'Dataset'").select("name")).select("name", "paper_id")


@register(f"SELECT {_M2} AS name, {_M} AS method FROM documents UNION SELECT {_M}, {_M2} FROM documents")
def q6_improving_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _entity_graph(spark, sf_dir)
    return Q.methods_improving_upon(nodes, edges, nodes.where("node_type = 'Method'").select("name"))


@register(f"SELECT DISTINCT {_M} AS name FROM documents")
def q8_entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.entities_by_type(_entity_graph(spark, sf_dir)[0], "Method").select("name")


@register(f"SELECT CAST(doc_id AS VARCHAR) AS key_id, {_M2} AS name FROM documents")
def q9_entities_for_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _entity_graph(spark, sf_dir)
    keys = docs(spark, sf_dir).select(S(doc_id()).alias("paper_id"))
    return Q.entities_for_paper(nodes, edges, keys).where("node_type = 'Method'").select("key_id", "name")


@register(f"WITH p AS (SELECT DISTINCT {_M} AS a, {_M2} AS b FROM documents), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p) SELECT a AS key_name, a AS subject, b AS object FROM e UNION SELECT b, a, b FROM e")
def q10_entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _entity_graph(spark, sf_dir)
    keys = nodes.where("node_type = 'Method'").select("name", F.col("node_type").alias("type"))
    return Q.entity_relations(nodes, edges, keys).where("relation = 'IMPROVES_UPON'").select("key_name", F.col("subject.name").alias("subject"), F.col("object.name").alias("object")).distinct()


@register(f"WITH {_LINES} SELECT 'paper_' || CAST(a AS VARCHAR) AS source_id, 'paper_' || CAST(b AS VARCHAR) AS target_id FROM e")
def q11_citation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.citation_graph(*line_graph(spark, sf_dir))[1]


@register(f"WITH {REFS}, c AS (SELECT d, count(DISTINCT CASE way WHEN 2 THEN 'k' || CAST(k AS VARCHAR) ELSE CAST(way AS VARCHAR) || '-' || CAST(c AS VARCHAR) END) AS n FROM refs GROUP BY d) SELECT CAST(d AS VARCHAR) AS paper_id, 4 AS n_sections, 2 AS n_entities, n AS n_citations FROM c")
def q12_paper_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _entity_graph(spark, sf_dir)
    return Q.paper_summary(nodes, edges, docs(spark, sf_dir).select(S(doc_id()).alias("paper_id"))).select("paper_id", "n_sections", "n_entities", F.col("n_citations").cast("long").alias("n_citations"))


# --- chunks, vectors, retrieval ------------------------------------------------------------


@register("SELECT 'Paper' AS node_type, count(*) AS n FROM documents UNION ALL SELECT 'Section', count(*) * 4 FROM documents UNION ALL SELECT 'Dataset', count(*) FROM documents UNION ALL SELECT 'Method', count(*) * 2 FROM documents")
def v1_structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = parsed(spark, sf_dir)
    c = V.structured_chunks(x, E.extract_entities(E.sentences(x)))
    return c.where("node_type in ('Paper', 'Section', 'Dataset', 'Method')").groupBy("node_type").agg(F.count("*").alias("n"))


@register(f"""WITH w AS (SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS n FROM documents)
SELECT {PID}, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE (n + 449) // 450 END AS n, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE list_sum(list_transform(range(0, n, 450), lambda i: least(500, n - i))) END AS n_words
FROM w WHERE doc_id % 2 = 0 OR n > 0""")
def v3_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with an abstract are one chunk of it; the whole texts of the others become windows of words."""
    d = docs(spark, sf_dir)
    p = d.select(S(doc_id()).alias("paper_id"), F.lit("t").alias("title"), F.when(doc_id() % 2 == 0, "abs of it").alias("abstract"), F.array().cast("array<struct<idx:int,heading:string,text:string>>").alias("sections"))
    none = F.lit(None).cast("string")
    e = p.where("false").select("paper_id", F.lit(0).alias("pos"), none.alias("name"), none.alias("type"), none.alias("source_section"), none.alias("evidence"))
    w = V.word_window_chunks(d.select(S(doc_id()).alias("paper_id"), F.lit(1).alias("page_num"), "text"))
    chunks = V.chunks_with_fallback(V.structured_chunks(p, e), w)
    return chunks.groupBy("paper_id").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("n_words"))


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in TC.load(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding]


_NEAR = f"s AS (SELECT b.vec_id AS id, b.vec_id % 37 AS p, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0)"


@register(f"WITH {_NEAR} SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 10")
def v6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VX.vector_search(_points(spark, sf_dir), _first_vector(spark, sf_dir), 10).select("id", F.round("score", 6).alias("score"))


@register(f"WITH {_NEAR}, r AS (SELECT id, score FROM s WHERE p IN (1, 2, 3)) SELECT id, round(score, 6) AS score FROM r ORDER BY score DESC, id LIMIT 5")
def v8_graph_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    allowed = p.where("paper_id in ('1', '2', '3')").select("paper_id")
    return VX.graph_filtered_search(p, allowed, _first_vector(spark, sf_dir), 5).select("id", F.round("score", 6).alias("score"))


@register(f"WITH {_NEAR}, r AS (SELECT p, score FROM s ORDER BY score DESC, id LIMIT 15), g AS (SELECT p, max(score) AS score, count(*) AS n FROM r GROUP BY p) SELECT CAST(p AS VARCHAR) AS paper_id, round(score, 6) AS score, n AS n_chunks FROM g ORDER BY g.score DESC, 1 LIMIT 5")
def v9_paper_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VX.paper_search(_points(spark, sf_dir), _first_vector(spark, sf_dir), 5).select("paper_id", F.round("score", 6).alias("score"), "n_chunks")


@register(f"WITH s AS (SELECT a.vec_id AS q, b.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS n FROM s) SELECT q AS query_id, string_agg('---' || chr(10) || 'chunk ' || CAST(id AS VARCHAR), chr(10) ORDER BY n) AS context FROM r WHERE n <= 3 GROUP BY q")
def v11_rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    q = p.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    hits = VX.batch_vector_search(q, p, 5).join(p.select("id", "paper_id", "text"), "id")
    return H.rag_context(hits, 3).select("query_id", "context")


_ASKED = ["Who cites paper ", "How did the field evolve since paper ", "How does it compare to paper "]


def _asked(spark: SparkSession, sf_dir: str, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions on every twentieth paper of the order lines' graph, of three kinds by turns, with the vectors as chunks; ``once`` writes the graph down."""
    nodes, edges = line_graph(spark, sf_dir)
    if once:
        nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    points = _points(spark, sf_dir).withColumn("paper_id", say(F.col("id") % 400 * 20))
    k = F.col("paper_id").cast("long")
    asked = nodes.where(k % 20 == 0).join(points.select((F.col("id") % 20).alias("turn"), F.col("embedding").alias("query_embedding")).groupBy("turn").agg(F.min_by("query_embedding", F.xxhash64("query_embedding")).alias("query_embedding")), F.pmod(F.expr("cast(paper_id as long) div 20"), F.lit(20)) == F.col("turn"))
    q = asked.select(F.col("paper_id").alias("query_id"), say(TC.pick(_ASKED, F.expr("cast(paper_id as long) div 20")), F.col("paper_id"), "?").alias("query"), "paper_id", "query_embedding")
    return q, nodes, edges, points


def _retrieved(spark: SparkSession, sf_dir: str, force_mode: str | None = None) -> DataFrame:
    q, *rest = _asked(spark, sf_dir, once=force_mode != "vector")
    return H.hybrid_retrieve(written(q, "queries"), *rest, force_mode=force_mode)


_DEGREE = f"""WITH {_LINES}, p AS (SELECT a AS x FROM e UNION SELECT b FROM e), k AS (SELECT x, (x // 20) % 3 AS kind FROM p WHERE x % 20 = 0),
ahead AS (SELECT a AS x, count(*) AS n FROM e GROUP BY a), back AS (SELECT b AS x, count(*) AS n FROM e GROUP BY b),
h AS (SELECT (vec_id % 400) * 20 AS x, least(count(*), 5) AS n FROM embeddings GROUP BY 1)"""


@register(f"""{_DEGREE} SELECT CAST(k.x AS VARCHAR) AS query_id, CASE WHEN kind = 1 THEN NULL ELSE coalesce(ahead.n, 0) + coalesce(back.n, 0) END AS n_facts, CASE WHEN kind = 2 THEN coalesce(h.n, 0) ELSE 0 END AS n_hits,
kind = 1 AS walked FROM k LEFT JOIN ahead ON k.x = ahead.x LEFT JOIN back ON k.x = back.x LEFT JOIN h ON k.x = h.x""")
def h6_hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of citation and comparison questions, hits of the asked paper alone, paths of evolution questions only."""
    walked = F.size("paths") > 0
    facts = F.when(F.col("query_type") != "EVOLUTION", F.size("facts").cast("long"))
    return _retrieved(spark, sf_dir).select("query_id", facts.alias("n_facts"), F.size("hits").cast("long").alias("n_hits"), walked.alias("walked"))


@register(f"""{_DEGREE} SELECT CAST(k.x AS VARCHAR) AS query_id, CASE WHEN kind = 1 THEN NULL ELSE coalesce(ahead.n, 0) + coalesce(back.n, 0) END AS n_fact_lines, CASE WHEN kind = 2 THEN coalesce(h.n, 0) ELSE 0 END AS n_hit_lines
FROM k LEFT JOIN ahead ON k.x = ahead.x LEFT JOIN back ON k.x = back.x LEFT JOIN h ON k.x = h.x""")
def h7_build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = H.confidence_notes(H.build_context(_retrieved(spark, sf_dir)))
    lines = lambda part: F.size(F.filter(F.split("context_text", "\n"), lambda x: x.contains(part))).cast("long")
    return c.select("query_id", F.when(F.col("query_type") != "EVOLUTION", lines(" CITES ")).alias("n_fact_lines"), lines('"chunk ').alias("n_hit_lines"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    text = lambda x: F.array(F.lit(x))
    q = d.select(S(doc_id()).alias("id"), say("c", doc_id() % 3).alias("category"), text("FOO").alias("expected_entities"), F.when(doc_id() % 2 == 0, "CITES").alias("expected_relation"), F.when(doc_id() % 5 != 0, text("p1")).alias("expected_sources"))
    none = F.lit(None).cast("string")
    place = lambda name: F.struct(name.alias("name"), none.alias("type"), none.alias("paper_id"))
    fact = F.struct(place(F.when(doc_id() % 7 == 1, "foo")).alias("subject"), F.when(doc_id() % 4 == 0, "CITES").otherwise("MENTIONS").alias("relation"), place(F.when(doc_id() % 7 == 2, "Foo").otherwise("food")).alias("object"), none.alias("evidence"), F.array().cast("array<string>").alias("source_paper_ids"))
    r = d.select(S(doc_id()).alias("id"), F.lit("hybrid").alias("mode"), F.array(fact).alias("facts"), F.array(F.struct(F.when(doc_id() % 7 == 3, "FOO").alias("node_name"))).alias("hits"), F.when(doc_id() % 3 == 0, text("p1")).otherwise(text("p2")).alias("source_paper_ids"), F.when(doc_id() % 7 != 0, "a foo b").otherwise("").alias("context_text"))
    return N.score_questions(q, r)


@register("SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 7 IN (1, 2, 3) AS retrieval_hit, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 = 0 END AS source_correct, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 = 0 END AS citation_correct, doc_id % 7 <> 0 AS grounded FROM documents")
def n1_score_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).drop("category", "mode")


@register("""SELECT 'hybrid' AS mode, 'c' || CAST(doc_id % 3 AS VARCHAR) AS category, count(*) AS n, round(avg(CASE WHEN doc_id % 7 IN (1, 2, 3) THEN 1.0 ELSE 0.0 END), 4) AS retrieval_hit_rate,
round(avg(CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 4) AS source_correct_rate, round(avg(CASE WHEN doc_id % 2 = 1 THEN NULL WHEN doc_id % 4 = 0 THEN 1.0 ELSE 0.0 END), 4) AS citation_correct_rate,
round(avg(CASE WHEN doc_id % 7 <> 0 THEN 1.0 ELSE 0.0 END), 4) AS grounded_rate FROM documents GROUP BY doc_id % 3""")
def n2_summarize_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.summarize_eval(_scores(spark, sf_dir), ("category",))


# --- curation, jobs, streams ------------------------------------------------------------------


@register(f"WITH {_SCORE} SELECT paper_id, count(*) AS n FROM scored WHERE c > 0 AND c < 0.85 GROUP BY 1")
def u1_queue_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, audit = U.queue_drafts(_routed(spark, sf_dir))
    return audit.select("paper_id", F.get_json_object("detail", "$.count").cast("long").alias("n"))


@register("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderdate, o_orderkey LIMIT 200 OFFSET 10")
def u2_list_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = TC.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("confidence"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return U.list_drafts(o, {"status": "F"}, 500, 10).select("id")


_ACTIONS = "a AS (SELECT event_id // 20 AS draft_id, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'promoted' END AS wanted, ts, event_id FROM events WHERE event_type IN ('error', 'purchase')), f AS (SELECT draft_id, wanted, row_number() OVER (PARTITION BY draft_id ORDER BY ts, event_id) AS n FROM a)"


def _manual(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = TC.load(spark, sf_dir, "events").where("event_type in ('error', 'purchase')")
    a = e.select(F.col("event_id").alias("id"), F.expr("event_id div 20").alias("draft_id"), F.when(F.col("event_type") == "error", "reject").otherwise("promote").alias("action"), "user_id", "ts")
    return U.manual_resolution(drafts(spark, sf_dir), a)


@register(f"WITH {_ACTIONS} SELECT d.id, coalesce(f.wanted, 'pending') AS status FROM (SELECT DISTINCT event_id // 20 AS id FROM events) d LEFT JOIN f ON d.id = f.draft_id AND f.n = 1")
def u9_manual_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manual(spark, sf_dir)[0].select("id", "status")


@register(f"WITH {_ACTIONS} SELECT a.draft_id, 'already ' || f.wanted AS error, count(*) AS n FROM a JOIN f ON a.draft_id = f.draft_id AND f.n = 1 WHERE a.wanted <> f.wanted GROUP BY 1, 2")
def u9_action_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manual(spark, sf_dir)[1].groupBy("draft_id", "error").agg(F.count("*").alias("n"))


@register(f"{_STEPS} SELECT draft_id, CASE WHEN score > 0 THEN 'draft_promoted' ELSE 'draft_rejected' END AS action, user_id FROM f")
def u10_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.audit_log(U.resolve_drafts(drafts(spark, sf_dir), votes(spark, sf_dir))).select("draft_id", "action", "user_id")


@register(f"{_STEPS} SELECT draft_id AS id FROM f WHERE score > 0 AND draft_id % 3 <> 0")
def u11_pending_graph_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = U.resolve_drafts(drafts(spark, sf_dir), votes(spark, sf_dir))
    d = r.select(F.col("draft_id").alias("id"), say("p", F.col("draft_id") % 20).alias("paper_id"), "status")
    audit = r.where("draft_id % 3 = 0").select("draft_id", F.to_json(F.struct(F.lit(True).alias("graph_written"))).alias("detail"))
    return U.pending_graph_writes(d, audit).select("id")


@register(f"{_STEPS} SELECT draft_id AS id, 'M' || CAST(draft_id % 40 AS VARCHAR) AS name FROM f WHERE score > 0")
def u12_promoted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = U.resolve_drafts(drafts(spark, sf_dir), votes(spark, sf_dir))
    d = r.select(F.col("draft_id").alias("id"), F.lit("p").alias("paper_id"), F.lit("entity").alias("kind"), "status", "resolved_by", F.to_json(F.struct(say("M", F.col("draft_id") % 40).alias("name"), F.lit("Method").alias("type"))).alias("payload"))
    return U.promoted_payloads(d).select("id", "name")


@register(f"""{_STEPS}, p AS (SELECT draft_id AS id, 'p' || CAST(draft_id % 20 AS VARCHAR) AS pid, 'method_' || substr(md5('m' || CAST(draft_id % 40 AS VARCHAR)), 1, 12) AS m,
'method_' || substr(md5('m' || CAST(draft_id % 7 AS VARCHAR)), 1, 12) AS m2, draft_id % 4 AS kind FROM f WHERE score > 0),
old AS (SELECT DISTINCT 'p' || CAST(event_id // 20 % 20 AS VARCHAR) AS pid FROM events)
SELECT 'node' AS kind, 'paper_' || pid AS source_id, NULL AS edge_type, NULL AS target_id, NULL AS curated, NULL AS section FROM old
UNION ALL SELECT 'node', m, NULL, NULL, 'true', CASE WHEN bool_or(kind < 2) THEN 'Intro' END FROM (SELECT m, kind FROM p WHERE kind < 3 UNION ALL SELECT m2, kind FROM p WHERE kind = 2) GROUP BY m
UNION ALL SELECT DISTINCT 'edge', 'paper_' || pid, CASE kind WHEN 0 THEN 'INTRODUCES' ELSE 'MENTIONS' END, m, 'true', NULL FROM p WHERE kind < 2
UNION ALL SELECT DISTINCT 'edge', m, 'IMPROVES_UPON', m2, 'true', NULL FROM p WHERE kind = 2
UNION ALL SELECT 'rejected', CAST(id AS VARCHAR), NULL, NULL, NULL, NULL FROM p WHERE kind = 3""")
def u12_promote_to_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted drafts merged into a graph of their papers: methods with and without role, relations, and drafts of a kind that there isn't."""
    r = U.resolve_drafts(drafts(spark, sf_dir), votes(spark, sf_dir))
    n = F.col("draft_id")
    payload = F.to_json(F.struct(
        say("M", n % 40).alias("name"), F.lit("Method").alias("type"), F.when(n % 4 == 0, "introduces").alias("role"), F.lit("Intro").alias("source_section"), say("M", n % 40).alias("source"), say("m", n % 7).alias("target"),
        F.lit("Method").alias("source_type"), F.lit("Method").alias("target_type"), F.lit("IMPROVES_UPON").alias("relation"),
    ))
    d = r.select(n.alias("id"), say("p", n % 20).alias("paper_id"), F.when(n % 4 < 2, "entity").when(n % 4 == 2, "relation").otherwise("note").alias("kind"), "status", "resolved_by", payload.alias("payload"))
    none = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    old = d.select("paper_id").distinct().select(say("paper_", F.col("paper_id")).alias("node_id"), F.lit("Paper").alias("node_type"), F.col("paper_id").alias("name"), "paper_id", empty.alias("properties"))
    no_edges = old.where("false").select(*[none.alias(c) for c in ("source_id", "source_type", "edge_type", "target_id", "target_type", "evidence")], F.lit(None).cast("double").alias("confidence"), "properties")
    nodes, edges, rejected = U.promote_to_graph(old, no_edges, d)
    get = lambda k: F.col("properties")[k]
    rows = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("source_id"), none.alias("edge_type"), none.alias("target_id"), get("curated").alias("curated"), get("source_section").alias("section"))
    rows = rows.unionByName(edges.select(F.lit("edge").alias("kind"), "source_id", "edge_type", "target_id", get("curated").alias("curated"), none.alias("section")))
    return rows.unionByName(rejected.select(F.lit("rejected").alias("kind"), S(F.col("id")).alias("source_id"), *[none.alias(c) for c in ("edge_type", "target_id", "curated", "section")]))


@register("WITH v AS (SELECT DISTINCT event_id // 20 AS id, user_id FROM events WHERE event_type IN ('click', 'purchase', 'error')) SELECT d.id, count(v.user_id) AS n FROM (SELECT DISTINCT event_id // 20 AS id FROM events) d LEFT JOIN v ON d.id = v.id GROUP BY 1")
def u13_draft_with_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.draft_with_votes(drafts(spark, sf_dir), votes(spark, sf_dir)).select("id", F.size("votes").cast("long").alias("n"))


@register("SELECT CAST(o_custkey AS VARCHAR) AS paper_id, count(*) AS n_steps, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_errors FROM orders GROUP BY o_custkey")
def j2_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = TC.load(spark, sf_dir, "orders")
    steps = o.select(S(F.col("o_custkey")).alias("paper_id"), F.col("o_orderkey").alias("step_no"), F.lit("entities").alias("step_name"), F.lit("done").alias("status"), F.when(F.col("o_orderstatus") == "F", "broken").alias("error"), F.col("o_totalprice").alias("duration_ms"))
    counts = steps.groupBy("paper_id").agg(F.count("error").alias("n")).select("paper_id", F.lit("errors").alias("kind"), "n")
    return J.run_report(steps, counts).select("paper_id", F.size("steps").cast("long").alias("n_steps"), F.col("counts")["errors"].alias("n_errors"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that every executor sees."""
    return f"{shared_dir(spark)}/paperlake/{name}-{uuid.uuid4().hex}"


@register(f"{_STEPS} SELECT draft_id, CASE WHEN score > 0 THEN 'promoted' ELSE 'rejected' END AS status, CAST(score AS BIGINT) AS score, user_id AS resolved_by, id AS resolved_vote FROM f")
def t2_vote_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as one stream of votes; every resolution once, as the batch job has them."""
    place = _scratch(spark, "votes")
    votes(spark, sf_dir).write.parquet(f"{place}/in")
    stream = spark.readStream.schema("id long, draft_id long, user_id long, vote int, ts timestamp").parquet(f"{place}/in")
    q = streams.vote_stream(stream).writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/out/batch={n}")).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(streams.RESOLUTION).parquet(f"{place}/out")
    return out.select("draft_id", "status", F.col("score").cast("long").alias("score"), "resolved_by", "resolved_vote")


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """The decorated corpus as page files through the streaming ingestion, in two batches: later papers cite earlier ones and the other way round."""
    place = _scratch(spark, "ingest")
    for turn in (0, 1):
        own_pages(spark, sf_dir).where(F.pmod(F.xxhash64("paper_id"), F.lit(2)) == turn).write.mode("append").parquet(f"{place}/in")
        streams.ingest_stream(spark, f"{place}/in", f"{place}/out", f"{place}/state", buckets=16).awaitTermination()
        streams.resolve_stream(spark, f"{place}/out", f"{place}/resolved").awaitTermination()
    return f"{place}/out"


@register(f"""{_RESOLVED}, all_edges AS (SELECT 'CITES' AS edge_type, 'paper_' || s AS source_id, 'paper_' || t AS target_id FROM e
UNION ALL SELECT DISTINCT 'IMPROVES_UPON', 'method_' || substr(md5(lower({_M})), 1, 12), 'method_' || substr(md5(lower({_M2})), 1, 12) FROM documents
UNION SELECT DISTINCT 'IMPROVES_UPON', 'method_' || substr(md5(lower({_M2})), 1, 12), 'method_' || substr(md5(lower({_M})), 1, 12) FROM documents
UNION ALL SELECT 'INTRODUCES', 'paper_' || CAST(doc_id AS VARCHAR), 'method_' || substr(md5(lower({_M})), 1, 12) FROM documents
UNION ALL SELECT 'HAS_SECTION', 'paper_' || CAST(doc_id AS VARCHAR), 'section_' || CAST(doc_id AS VARCHAR) || '_' || substr(md5(h), 1, 12) FROM documents, (VALUES ('Abstract'), ('Introduction'), ('Experiments'), ('References')) s(h))
SELECT * FROM all_edges""")
def t1_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the stored graph after both batches, citations resolved in both orders; of papers that have chunks, too."""
    out = _ingested(spark, sf_dir)
    have = streams.current_chunks(spark, out, "paper_id string, chunk_id string, text string").select(say("paper_", F.col("paper_id")).alias("source_id")).distinct()
    edges = streams.current_graph(spark, out)[1].where("edge_type in ('CITES', 'IMPROVES_UPON', 'INTRODUCES', 'HAS_SECTION')").select("edge_type", "source_id", "target_id")
    return edges.where("edge_type = 'IMPROVES_UPON'").unionByName(edges.where("edge_type <> 'IMPROVES_UPON'").join(have, "source_id", "left_semi"))


@register(f"""{_RESOLVED} SELECT 'paper_' || t AS node_id, starts_with(t, 'doi_') OR starts_with(t, 'arxiv_') OR starts_with(t, 'ref_') AS is_stub FROM (SELECT t FROM e UNION SELECT CAST(doc_id AS VARCHAR) FROM documents)""")
def t1_ingested_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers and placeholders that are left in the stored graph after both batches."""
    nodes, _ = streams.current_graph(spark, _ingested(spark, sf_dir))
    return nodes.where("node_type = 'Paper'").select("node_id", (F.col("properties")["is_stub"] == "true").alias("is_stub"))


@register("""WITH l AS (SELECT *, l_linenumber % 4 AS turn FROM lineitem WHERE l_orderkey <> l_partkey),
n AS (SELECT l_orderkey AS p, turn, l_linenumber FROM l UNION ALL SELECT l_partkey, turn, l_linenumber FROM l),
e AS (SELECT l_orderkey AS a, l_partkey AS b, max(turn) AS turn, count(DISTINCT turn) AS n FROM l GROUP BY 1, 2)
SELECT 'node' AS kind, 'paper_' || CAST(p AS VARCHAR) AS source_id, NULL AS target_id, CAST(max(turn) AS VARCHAR) AS last, CAST(max(CASE WHEN turn % 2 = 0 THEN turn END) AS VARCHAR) AS last_even FROM n GROUP BY p
UNION ALL SELECT 'edge', 'paper_' || CAST(a AS VARCHAR), 'paper_' || CAST(b AS VARCHAR), CAST(turn AS VARCHAR), NULL FROM e""")
def s8_merge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in four commits to a stored graph; a fifth one repeats the last and changes nothing. Properties are the last writer's."""
    store = GraphStore(spark, _scratch(spark, "graph"), buckets=8, most_parts=2)
    li = TC.load(spark, sf_dir, "lineitem").withColumn("turn", F.col("l_linenumber") % 4)
    for turn in (0, 1, 2, 3, 3):
        nodes, edges = TC.citation_graph(li.where(F.col("turn") == turn))
        mark = F.lit(turn).cast("string")
        nodes = nodes.withColumn("properties", G.properties(last=mark, last_even=F.when(F.lit(turn % 2 == 0), mark)))
        store.commit(turn, written(nodes, "nodes"), written(edges.withColumn("properties", G.properties(last=mark)), "edges"))
    nodes, edges = store.read()
    none = F.lit(None).cast("string")
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("source_id"), none.alias("target_id"), F.col("properties")["last"].alias("last"), F.col("properties")["last_even"].alias("last_even")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "source_id", "target_id", F.col("properties")["last"].alias("last"), none.alias("last_even"))
    )


@register(f"""WITH {_LINES}, s AS (SELECT DISTINCT a, CASE WHEN b % 3 = 0 THEN a WHEN b % 3 = 1 THEN b END AS t, b FROM e)
SELECT 'paper_' || CAST(a AS VARCHAR) AS source_id, 'paper_' || coalesce(CAST(t AS VARCHAR), 'doi_10.9/s' || CAST(b AS VARCHAR)) AS target_id FROM s WHERE t IS NULL OR t <> a GROUP BY 1, 2""")
def g10_no_self_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation goes to a placeholder: of the citing paper itself, of a paper that there is, or of none. Only the last two stay."""
    nodes, edges = line_graph(spark, sf_dir)
    a, b = F.substring("source_id", 7, 40), F.substring("target_id", 7, 40)
    to = F.when(b.cast("long") % 3 == 0, a).when(b.cast("long") % 3 == 1, b)
    doi = F.coalesce(say("10.9/p", to), say("10.9/s", b))
    edges = edges.withColumn("target_id", say("paper_doi_", doi)).dropDuplicates(["source_id", "target_id"])
    real = nodes.withColumn("properties", G.properties(is_stub=F.lit("false"), doi=say("10.9/p", F.col("paper_id"))))
    stub = edges.select(F.col("target_id").alias("node_id"), F.lit("Paper").alias("node_type"), F.lit(None).cast("string").alias("name"), F.substring("target_id", 7, 40).alias("paper_id"), G.properties(is_stub=F.lit("true")).alias("properties")).dropDuplicates(["node_id"])
    return G.resolve_stubs(real.unionByName(stub), edges)[1].select("source_id", "target_id")


# --- facts and notes ------------------------------------------------------------------


@register(f"""WITH p AS (SELECT {case(vocab.METHODS, 'doc_id')} AS m, {case(vocab.METHODS, 'doc_id + 5')} AS m2, {title('doc_id')} AS t FROM documents),
x AS (SELECT DISTINCT m, m2 FROM p), f AS (SELECT m AS query_id, t AS subject, 'INTRODUCES' AS relation, m AS object FROM p
UNION SELECT m, m, 'IMPROVES_UPON', m2 FROM x UNION SELECT m2, m, 'IMPROVES_UPON', m2 FROM x UNION SELECT m, m2, 'IMPROVES_UPON', m FROM x UNION SELECT m2, m2, 'IMPROVES_UPON', m FROM x)
SELECT f.* FROM f JOIN (SELECT DISTINCT m FROM p) q ON q.m = f.query_id""")
def h3_entity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question on every method that a document is about: who introduces it, what improves upon it and the other way round."""
    nodes, edges = _entity_graph(spark, sf_dir)
    m = docs(spark, sf_dir).select(TC.method(doc_id()).alias("m")).distinct()
    asked = m.select(F.col("m").alias("query_id"), say("Who cites the work on ", F.col("m"), "?").alias("query"), F.lit(None).cast("string").alias("paper_id"))
    facts = H.query_entity_facts(H.route_queries(asked), nodes, edges).where("fact.relation in ('INTRODUCES', 'IMPROVES_UPON')")
    return facts.select("query_id", F.col("fact.subject.name").alias("subject"), "fact.relation", F.col("fact.object.name").alias("object"))


@register(f"""WITH {_LINES}, s AS (SELECT DISTINCT a AS x FROM e WHERE a % 20 = 0), one AS (SELECT x, b AS y, row_number() OVER (PARTITION BY x ORDER BY 'paper_' || CAST(b AS VARCHAR)) AS r FROM s JOIN e ON s.x = e.a)
SELECT CAST(x AS VARCHAR) AS query_id, 'Paper ' || CAST(x AS VARCHAR) AS subject, 'CITES' AS relation, 'Paper ' || CAST(y AS VARCHAR) AS object,
least(CAST(x AS VARCHAR), CAST(y AS VARCHAR)) || ',' || greatest(CAST(x AS VARCHAR), CAST(y AS VARCHAR)) AS sources FROM one WHERE r <= 20""")
def h5_citation_path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = line_graph(spark, sf_dir)
    edges = written(edges, "edges")
    asked = _some_papers(nodes).select(F.col("paper_id").alias("query_id"), F.lit("How did the field evolve?").alias("query"), "paper_id")
    paths = H.citation_paths(H.route_queries(asked), nodes, edges, direction="forward", max_depth=1, max_papers=20)
    f = H.citation_path_facts(paths, nodes)
    return f.select("query_id", F.col("fact.subject.name").alias("subject"), "fact.relation", F.col("fact.object.name").alias("object"), F.array_join("fact.source_paper_ids", ",").alias("sources"))


@register(f"""{_DEGREE} SELECT CAST(k.x AS VARCHAR) AS query_id, CASE WHEN h.n IS NULL THEN '{H.NO_SOURCES}|{H.NO_EVIDENCE}' ELSE '' END AS notes, h.n IS NOT NULL AS answerable FROM k LEFT JOIN h ON k.x = h.x""")
def h8_confidence_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered from texts alone: papers without chunks get both notes."""
    c = H.confidence_notes(H.build_context(_retrieved(spark, sf_dir, "vector")))
    return c.select("query_id", F.array_join("confidence_notes", "|").alias("notes"), "answerable")


@register(f"""{_DEGREE}, v AS (SELECT CASE WHEN h.n IS NULL THEN 0.0 ELSE 1.0 END AS hit FROM k LEFT JOIN h ON k.x = h.x), s AS (SELECT count(*) AS n, round(avg(hit), 4) AS rate FROM v)
SELECT mode, n, CAST(retrieval AS DOUBLE) AS retrieval_hit_rate, CAST(coalesce(source, rate) AS DOUBLE) AS source_correct_rate, CAST(citation AS DOUBLE) AS citation_correct_rate, CAST(coalesce(source, rate) AS DOUBLE) AS grounded_rate
FROM s, (VALUES ('graph', 1.0, 1.0, 1.0), ('vector', 0.0, NULL, 0.0), ('hybrid', 1.0, 1.0, 1.0)) m(mode, retrieval, source, citation)""")
def n2_evaluated_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation: who cites a paper, asked of the graph, of the texts and of both; graded and summed up."""
    q, nodes, edges, points = _asked(spark, sf_dir)
    q = q.withColumn("query", say("Who cites paper ", F.col("paper_id"), "?"))
    wanted = q.select(F.col("query_id").alias("id"), F.lit("citation").alias("category"), F.array(say("paper ", F.col("paper_id"))).alias("expected_entities"), F.lit("CITES").alias("expected_relation"), F.array("paper_id").alias("expected_sources"))
    return N.summarize_eval(N.score_questions(wanted, H.retrieve_modes(q, nodes, edges, points)))


# --- readers --------------------------------------------------------------------------


def _cut(record: Column) -> Column:
    """Every tenth record lacks its last character."""
    return F.when(doc_id() % 10 == 3, F.substring(record, F.lit(1), F.length(record) - 1)).otherwise(record).alias("value")


@register("SELECT CAST(doc_id AS VARCHAR) AS paper_id, 1 AS page_num, sha256(text) AS address FROM documents WHERE doc_id % 10 <> 3")
def s1_read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as page records on disk, read back as a stream of files; broken ones aren't pages."""
    place = _scratch(spark, "pages")
    docs(spark, sf_dir).select(_cut(F.to_json(F.struct(S(doc_id()).alias("paper_id"), F.lit(1).alias("page_num"), "text")))).write.text(f"{place}/in")
    read = io.read_pages(spark, f"{place}/in", "json", stream=True).select("paper_id", "page_num", F.sha2("text", 256).alias("address"))
    read.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("paper_id string, page_num int, address string").parquet(f"{place}/out")


@register("SELECT CAST(doc_id AS VARCHAR) AS paper_id, false AS whole FROM documents WHERE doc_id % 10 = 3")
def s1_broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _scratch(spark, "pages")
    docs(spark, sf_dir).select(_cut(F.to_json(F.struct(S(doc_id()).alias("paper_id"), F.lit(1).alias("page_num"), "text")))).write.text(place)
    d = io.broken_records(spark, place, "pages")
    return d.select(F.regexp_extract("record", r'^\{"paper_id":"(\d+)"', 1).alias("paper_id"), F.col("record").endswith("}").alias("whole"))


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue record for every seventh document, by its doi or arXiv id, with a title of its own."""
    who = F.struct(F.struct(say("Ann ", doc_id() % 50).alias("display_name"), F.lit(None).cast("string").alias("orcid")).alias("author"), F.array(F.struct(say("Uni", doc_id() % 7).alias("display_name"))).alias("institutions"))
    return docs(spark, sf_dir).where(doc_id() % 7 == 0).select(
        doc_id(), say("w", doc_id()).alias("id"), F.md5(S(doc_id())).alias("title"), say("https://doi.org/10.1234/P", doc_id()).alias("doi"), (F.lit(1990) + doc_id() % 30).cast("int").alias("publication_year"), F.array(who).alias("authorships"),
        F.create_map(F.lit("alpha"), F.array(F.lit(0), F.lit(2)), F.lit("beta"), F.array(F.lit(1))).alias("abstract_inverted_index"), F.array().cast("array<struct<display_name:string>>").alias("concepts"), F.array(say("w", doc_id() + 1)).alias("referenced_works"),
    )


@register("SELECT 'w' || CAST(doc_id AS VARCHAR) AS work_id, md5(CAST(doc_id AS VARCHAR)) AS title, '10.1234/p' || CAST(doc_id AS VARCHAR) AS doi, 1990 + doc_id % 30 AS year, 'Ann ' || CAST(doc_id % 50 AS VARCHAR) AS authors, 'alpha beta alpha' AS abstract, 'w' || CAST(doc_id + 1 AS VARCHAR) AS referenced FROM documents WHERE doc_id % 7 = 0 AND doc_id % 10 <> 3")
def s6_read_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _scratch(spark, "works")
    w = _works(spark, sf_dir)
    w.select(_cut(F.to_json(F.struct(*[c for c in w.columns if c != "doc_id"])))).write.text(place)
    n = M.normalize_work(io.read_works(spark, place))
    return n.select("work_id", "title", "doi", F.col("year").cast("long").alias("year"), F.array_join("authors", ",").alias("authors"), "abstract", F.array_join("referenced_works", ",").alias("referenced"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(
        doc_id(), say("doi:10.1234/p", doc_id()).alias("key"), say("Record ", doc_id()).alias("title"), F.when(doc_id() % 2 == 0, say("About ", doc_id())).otherwise("").alias("abstract"), (F.lit(1950) + doc_id() % 50).cast("int").alias("year"),
        (doc_id() % 1000).cast("int").alias("citationCount"), F.array(F.struct(say("Bob ", doc_id() % 9).alias("name"), F.lit("b").alias("authorId"))).alias("authors"), F.struct(F.lit(None).cast("string").alias("model"), say("short ", doc_id()).alias("text")).alias("tldr"),
    )


@register("SELECT 'doi:10.1234/p' || CAST(doc_id AS VARCHAR) AS key, 'Record ' || CAST(doc_id AS VARCHAR) AS title, CASE WHEN doc_id % 2 = 0 THEN 'About ' || CAST(doc_id AS VARCHAR) END AS abstract, 1950 + doc_id % 50 AS year, doc_id % 1000 AS citations, 'Bob ' || CAST(doc_id % 9 AS VARCHAR) AS authors, 'short ' || CAST(doc_id AS VARCHAR) || '/unknown' AS tldr FROM documents WHERE doc_id % 10 <> 3")
def s7_read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _scratch(spark, "records")
    r = _records(spark, sf_dir)
    r.select(_cut(F.to_json(F.struct(*[c for c in r.columns if c != "doc_id"])))).write.text(place)
    n = M.normalize_records(io.read_citation_records(spark, place))
    return n.select("key", F.col("r_title").alias("title"), F.col("r_abstract").alias("abstract"), F.col("r_year").cast("long").alias("year"), F.col("r_citations").cast("long").alias("citations"), F.array_join("r_authors", ",").alias("authors"), say(F.col("r_tldr.text"), "/", F.col("r_tldr.source")).alias("tldr"))


@register("""SELECT '2101.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') AS arxiv_id, 'Title ' || CAST(doc_id AS VARCHAR) AS title, doc_id % 9 AS category FROM documents""")
def s5_read_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom feeds on disk, many entries a file, line breaks inside them."""
    place = _scratch(spark, "feeds")
    entry = say("<entry>\n<id>http://arxiv.org/abs/2101.", F.lpad(S(doc_id() % 100000), 5, "0"), "v2</id>\n<title>Title\n  ", doc_id(), "</title><summary>s</summary>\n<category term=\"", doc_id() % 9, "\"/></entry>")
    docs(spark, sf_dir).select(say("<feed><updated>x</updated>", entry, "</feed>").alias("value")).write.text(place)
    return io.parse_atom(io.read_entries(spark, place)).select("arxiv_id", "title", F.col("categories")[0].cast("long").alias("category"))


# --- the whole ingestion -----------------------------------------------------------------


_PAPER = "'paper_' || CAST(doc_id AS VARCHAR)"


@register(f"""SELECT 'WRITTEN_BY' AS edge_type, {_PAPER} AS source_id, 'author_' || substr(md5('Ann ' || CAST(doc_id % 50 AS VARCHAR)), 1, 12) AS target_id FROM documents WHERE doc_id % 7 = 0 AND doc_id % 3 < 2
UNION ALL SELECT 'INTRODUCES', {_PAPER}, 'method_' || substr(md5(lower({case(vocab.METHODS, 'doc_id')})), 1, 12) FROM documents WHERE 27 + length({case(vocab.METHODS, 'doc_id')}) + length({case(vocab.TASKS, 'doc_id')}) >= 40""")
def w1_ingested_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors come from the catalogue; methods whose evidence is short wait for a review instead."""
    x = _ingest_all(spark, sf_dir)
    return x.edges.where("edge_type in ('WRITTEN_BY', 'INTRODUCES')").select("edge_type", "source_id", "target_id")


def _ingest_all(spark: SparkSession, sf_dir: str) -> workloads.Ingested:
    works = _works(spark, sf_dir).withColumn("doi", F.when(doc_id() % 3 == 1, F.col("doi"))).withColumn("arxiv_id", F.when(doc_id() % 3 == 0, TC.own_arxiv_of(doc_id())))
    records = _records(spark, sf_dir).withColumns({"venue": F.lit("V"), "influentialCitationCount": F.lit(None).cast("int")})
    return workloads.ingest(own_pages(spark, sf_dir), works.drop("doc_id"), records.drop("doc_id"))
