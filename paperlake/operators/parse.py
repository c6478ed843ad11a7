"""Papers from page text. One shuffle (pages of a paper), then columns of one row per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions import text as X

IDENTITY_WINDOW = 600


def full_text(pages: DataFrame) -> DataFrame:
    """``paper_id, text, first_page``: pages joined by a blank line, in page order."""
    got = pages.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return got.select("paper_id", F.array_join(F.transform("p", lambda x: x.text), "\n\n").alias("text"), F.get("p", F.lit(0)).text.alias("first_page"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def extract_title(text: Column) -> Column:
    return F.get(F.filter(X.stripped_lines(text), lambda x: (F.length(x) > 10) & (F.length(x) < 300) & ~X.is_heading(x)), F.lit(0))


def self_arxiv_id(first_page: Column) -> Column:
    return X.capture(F.substring(first_page, 1, IDENTITY_WINDOW), r"(?i)arXiv:\s*(\d{4}\.\d{4,5})")


def self_doi(first_page: Column) -> Column:
    return F.regexp_replace(X.capture(F.substring(first_page, 1, IDENTITY_WINDOW), r"(?i)\bdoi:?\s*(10\.\d{4,9}/\S+)"), r"[.,;)]+$", "")


def _with_lines(texts: DataFrame) -> DataFrame:
    """Lines, which of them are headings, and the places of those."""
    d = texts.withColumn("lines", _lines(F.col("text"))).withColumn("bare", X.stripped_lines(F.col("text")))
    d = d.withColumn("heads", F.transform("bare", X.is_heading))
    return d.withColumn("spots", F.filter(F.transform("heads", lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))


def _body(start: Column, end: Column) -> Column:
    return X.collapse(F.array_join(F.slice("lines", start + 1, F.greatest(end - start, F.lit(0))), "\n"))


def parse_papers(pages: DataFrame) -> DataFrame:
    """``paper_id, title, abstract, sections, arxiv_id, doi, text``."""
    d = _with_lines(full_text(pages))
    total = F.size("lines")
    after = lambda i: F.coalesce(F.get("spots", i + 1), total)
    sections = F.transform("spots", lambda s, i: F.struct(i.alias("idx"), F.get("bare", s).alias("heading"), _body(s + 1, after(i)).alias("text")))
    first = F.array_min(F.filter("spots", lambda s: F.lower(F.get("bare", s)).startswith("abstract")))
    stop = F.coalesce(F.array_min(F.filter("spots", lambda s: s > F.col("abstract_at"))), total)
    title = F.get(F.filter("bare", lambda x, i: (F.length(x) > 10) & (F.length(x) < 300) & ~F.get("heads", i)), F.lit(0))
    d = d.withColumn("abstract_at", first)
    return d.select(
        "paper_id",
        title.alias("title"),
        F.nullif(_body(F.col("abstract_at") + 1, stop), F.lit("")).alias("abstract"),
        sections.alias("sections"),
        self_arxiv_id(F.col("first_page")).alias("arxiv_id"),
        self_doi(F.col("first_page")).alias("doi"),
        "text",
    )


def sections(parsed: DataFrame) -> DataFrame:
    """``paper_id, idx, heading, text``."""
    return parsed.select("paper_id", F.explode("sections").alias("s")).select("paper_id", "s.idx", "s.heading", "s.text")


def section_lines(texts: DataFrame) -> DataFrame:
    """The same sections by a line table and a running count of headings, for papers too long for one row's arrays."""
    from pyspark.sql import Window

    lines = texts.select("paper_id", F.posexplode(_lines(F.col("text"))).alias("line_no", "line")).withColumn("head", X.is_heading(X.strip(F.col("line"))))
    run = Window.partitionBy("paper_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("idx", F.sum(F.col("head").cast("int")).over(run) - 1).where("idx >= 0")
    got = lines.groupBy("paper_id", "idx").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    body = F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x.line)
    return got.select("paper_id", F.col("idx").cast("int").alias("idx"), X.strip(F.get("l", F.lit(0)).line).alias("heading"), X.collapse(F.array_join(body, "\n")).alias("text"))


def parse_reference_lines(texts: DataFrame) -> DataFrame:
    """``paper_id, line_no, title, authors, year, doi, arxiv_id`` of lines behind the first references heading."""
    d = texts.withColumn("bare", X.stripped_lines(F.col("text")))
    start = F.array_min(F.filter(F.transform("bare", lambda x, i: F.when(F.lower(x).rlike("^(?:references|bibliography)"), i)), lambda i: i.isNotNull()))
    # an outer generator and no filter on ``start``: either would have the lines worked out anew below it
    lines = d.withColumn("start", start).select("paper_id", "start", F.posexplode_outer("bare").alias("line_no", "line"))
    c = F.col("line")
    lines = lines.where("line_no > start").where(F.length("line") >= 10).withColumn("year", X.year_of(c))
    authors = F.filter(F.transform(F.split(F.regexp_extract(c, r"^(.*?)\b(?:19|20)\d{2}\b", 1), r"\s+and\s+|,"), X.strip), lambda a: a != "")
    return lines.select(
        "paper_id",
        "line_no",
        F.coalesce(X.capture(c, '"([^"]+)"'), F.substring(c, 1, 100)).alias("title"),
        F.when(F.col("year").isNotNull(), authors).otherwise(F.array().cast("array<string>")).alias("authors"),
        "year",
        X.capture(c, r"(?i)doi:\s*([\d.]+/[\w./-]+)").alias("doi"),
        X.capture(c, r"(?i)arxiv:\s*(\d+\.\d+)").alias("arxiv_id"),
    )
