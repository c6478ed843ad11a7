"""Readers with explicit schemas, and writers of the tables that stand for the stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import text as X

PAGES = "paper_id string, page_num int, text string"
WORKS = (
    "id string, title string, doi string, publication_year int, "
    "authorships array<struct<author:struct<display_name:string,orcid:string>,institutions:array<struct<display_name:string>>>>, "
    "abstract_inverted_index map<string,array<int>>, concepts array<struct<display_name:string>>, referenced_works array<string>"
)
RECORDS = (
    "key string, paperId string, title string, abstract string, year int, venue string, citationCount int, influentialCitationCount int, "
    "authors array<struct<name:string,authorId:string>>, tldr struct<model:string,text:string>, externalIds map<string,string>"
)
ENTRY = (
    "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, "
    "category array<struct<_term:string>>, link array<struct<_title:string,_href:string,_rel:string,_type:string>>"
)


#: The column that holds the raw text of a record that couldn't be read.
BROKEN = "_broken"


def _load(spark: SparkSession, path: str, form: str, schema: str, stream: bool, **options: str) -> DataFrame:
    return (spark.readStream if stream else spark.read).format(form).options(**options).schema(schema).load(path)


def _records(spark: SparkSession, path: str, schema: str, stream: bool) -> DataFrame:
    """Whole records, one JSON object a line, with the raw text of those that can't be read or don't fit the schema.

    Lines are parsed as text: a JSON scan would look at the selected columns only, and call
    a record broken or not by what the query selects.
    """
    d = _load(spark, path, "text", "value string", stream).where("trim(value) <> ''")
    r = F.from_json("value", f"{schema}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    return d.select(F.col("_metadata.file_path").alias("file"), r.alias("r"))


def _good(records: DataFrame) -> DataFrame:
    return records.where(f"r.{BROKEN} is null").select("r.*").drop(BROKEN)


def read_pages(spark: SparkSession, path: str, form: str = "parquet", stream: bool = False) -> DataFrame:
    """Pages of papers, as a table or as a stream of new files; of JSON without the records that ``broken_records`` gives."""
    return _good(_records(spark, path, PAGES, stream)) if form == "json" else _load(spark, path, form, PAGES, stream)


def read_works(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Catalogue records, one JSON object a line; without broken ones."""
    return _good(_records(spark, path, WORKS, stream))


def read_citation_records(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Records of cited papers, one JSON object a line; without broken ones."""
    return _good(_records(spark, path, RECORDS, stream))


def read_entries(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Entries of Atom feeds, which are split at ``<entry>``, as text for ``parse_atom``."""
    d = _load(spark, path, "text", "xml string", stream, lineSep="</entry>")
    entry = F.regexp_extract("xml", r"(?s)<entry[ >].*$", 0)  # empty for what follows the last one
    return d.where(F.length(entry) > 0).select(F.concat(entry, F.lit("</entry>")).alias("xml"))


KINDS = {"pages": PAGES, "works": WORKS, "records": RECORDS}


def broken_records(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """``file, record``: raw text of the JSON records of a kind that couldn't be read or don't fit its schema."""
    return _records(spark, path, KINDS[kind], stream).where(f"r.{BROKEN} is not null").select("file", f"r.{BROKEN}").withColumnRenamed(BROKEN, "record")


def parse_atom(entries: DataFrame, col: str = "xml") -> DataFrame:
    """Preprint metadata of Atom entries; titles that begin with "error" mean not found and go."""
    d = entries.select(F.from_xml(F.regexp_replace(col, "arxiv:", ""), ENTRY).alias("e"))
    vid = F.regexp_extract("e.id", r"abs/(.+)$", 1)
    doi = F.get(F.filter("e.link", lambda x: x["_title"] == "doi"), F.lit(0))["_href"]
    return d.select(
        F.regexp_replace(vid, r"v\d+$", "").alias("arxiv_id"), vid.alias("versioned_id"), X.collapse(F.col("e.title")).alias("title"), X.collapse(F.col("e.summary")).alias("abstract"),
        F.transform("e.author", lambda a: X.collapse(a["name"])).alias("authors"), F.transform("e.category", lambda c: c["_term"]).alias("categories"),
        F.regexp_replace(doi, r"^https?://(?:dx\.)?doi\.org/", "").alias("doi"), F.try_to_timestamp("e.published").alias("published"), F.try_to_timestamp("e.updated").alias("updated"),
        F.concat(F.lit("https://arxiv.org/pdf/"), vid, F.lit(".pdf")).alias("pdf_url"),
    ).where("title is not null and title <> '' and not lower(title) like 'error%'")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, partitioned by node and edge type; a type is dealt over as many tasks as a shuffle has."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = lambda *ids: F.pmod(F.xxhash64(*ids), F.lit(n))
    nodes.repartition("node_type", bucket("node_id")).write.mode(mode).partitionBy("node_type").parquet(f"{path}/nodes")
    edges.repartition("edge_type", bucket("source_id", "target_id")).write.mode(mode).partitionBy("edge_type").parquet(f"{path}/edges")


NODES = "node_id string, name string, paper_id string, properties map<string,string>, node_type string"
EDGES = "source_id string, source_type string, target_id string, target_type string, evidence string, confidence double, properties map<string,string>, edge_type string"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes")
    edges = spark.read.schema(EDGES).parquet(f"{path}/edges")
    return nodes.select("node_id", "node_type", "name", "paper_id", "properties"), edges.select("source_id", "source_type", "edge_type", "target_id", "target_type", "evidence", "confidence", "properties")
