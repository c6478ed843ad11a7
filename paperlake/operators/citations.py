"""Bibliographies, in-text mentions, and normalised citations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import text as X

# Forms of bibliography entries and of mentions in text.
ENTRY_FORMS = [
    r"^\s*\[(\d+)\]\s+.+",
    r"^\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s*[,.(]\s*(?:19|20)\d{2}\b.+",
    r"^\s*.*?(?:doi|DOI)[\s:]*10\.\d{4,}/\S+",
    r"^\s*.*?arXiv[\s:]*\d{4}\.\d{4,5}",
]
NUMERIC_MENTION = r"\[(\d+(?:\s*[,;]\s*\d+)*(?:\s*[-]\s*\d+)?)\]"
AUTHOR_YEAR_MENTIONS = [
    r"\((?:[A-Z][a-z]+(?:\s+(?:et\s+al\.?|[A-Z][a-z]+))*,\s*)*(?:19|20)\d{2}\)",
    r"[A-Z][a-z]+(?:\s+(?:et\s+al\.?))?\s*\((?:19|20)\d{2}\)",
]
DOI = r"(?i)doi[\s:]*(10\.\d{4,}/\S+)"
ARXIV = r"(?i)arXiv[\s.:]*(\d{4}\.\d{4,5})"
QUOTED_TITLES = ['"([^"]+)"', "'([^']+)'"]
TITLE_BEHIND_YEAR = r"(?:19|20)\d{2}[.,)\]]\s*(.+?)(?:\.\s|$)"
TITLE_ENDS_AT = r"(?i)\s*(?:doi|arXiv|available|retrieved|http).*$"
AUTHORS_BEFORE_YEAR = r"^(.*?)(?:19|20)\d{2}"
AUTHOR_SEPARATOR = r"\s*[,;]\s*"
AUTHOR_INDEX = r"^\[\d+\]\s*"
AUTHOR_AND = r"\s*(?:and|&)\s*$"


def is_entry(line: Column) -> Column:
    return line.rlike("|".join(f"(?:{p})" for p in ENTRY_FORMS))


def entry_title(c: Column) -> Column:
    behind = F.regexp_replace(X.strip(X.capture(c, TITLE_BEHIND_YEAR)), TITLE_ENDS_AT, "")
    behind = F.when((F.length(behind) > 5) & (F.length(behind) < 300), behind)
    return F.coalesce(*[X.strip(X.capture(c, p)) for p in QUOTED_TITLES], behind)


def entry_authors(c: Column) -> Column:
    before = F.regexp_extract(c, AUTHORS_BEFORE_YEAR, 1)
    parts = F.transform(F.split(before, AUTHOR_SEPARATOR), lambda p: F.regexp_replace(F.regexp_replace(X.strip(p), AUTHOR_INDEX, ""), AUTHOR_AND, ""))
    return F.filter(parts, lambda p: (F.length(p) > 2) & (F.length(p) < 80) & ~p.rlike(r"^\d+$"))


def parse_reference_entry(lines: DataFrame, col: str = "raw_text") -> DataFrame:
    """Adds ref_index, ref_id, doi, arxiv_id, year, title, authors to rows whose line has an entry's form."""
    c = F.col(col)
    index = X.capture(c, r"^\s*\[(\d+)\]")
    return lines.where(is_entry(c)).withColumns(
        {
            "ref_index": index.try_cast("int"),
            "ref_id": index,
            "doi": X.capture(c, DOI),
            "arxiv_id": X.capture(c, ARXIV),
            "year": X.year_of(c),
            "title": entry_title(c),
            "authors": entry_authors(c),
        }
    )


def extract_references(texts: DataFrame) -> DataFrame:
    """Entries behind the first short line with the word references or bibliography; ``line_number`` from 0."""
    word = r"(?i)\breferences?\b|\bbibliography\b"
    d = texts.select("paper_id", X.stripped_lines(F.col("text")).alias("bare"))
    start = F.array_min(F.filter(F.transform("bare", lambda x, i: F.when((F.length(x) < 30) & x.rlike(word), i)), lambda i: i.isNotNull()))
    # an outer generator and no filter on ``start``: either would have all lines worked out anew below it
    behind = F.posexplode_outer(F.slice("bare", F.col("start") + 2, F.size("bare"))).alias("nth", "raw_text")
    lines = d.withColumn("start", start).select("paper_id", "start", behind).withColumn("line_number", F.col("start") + F.col("nth") + 1)
    lines = lines.select("paper_id", "start", "line_number", "raw_text").where("raw_text <> ''").where(~F.col("raw_text").rlike(r"(?i)^(?:\breferences?\b|\bbibliography\b)$"))
    return parse_reference_entry(lines.drop("start"))


def parse_bibliography(sections: DataFrame) -> DataFrame:
    """Entries of isolated section bodies (``paper_id, text``); a body on one line is split before each ``[n]``."""
    parts = F.when(F.col("text").contains("\n"), F.split("text", "\n")).otherwise(F.split(X.strip(F.col("text")), r"(?=\[\d+\]\s)"))
    kept = F.when(F.col("text").contains("\n"), parts).otherwise(F.filter(parts, lambda p: X.strip(p) != ""))
    lines = sections.where(F.length(X.strip(F.col("text"))) > 0).select("paper_id", F.posexplode(kept).alias("line_number", "raw_text"))
    return parse_reference_entry(lines.withColumn("raw_text", X.strip(F.col("raw_text"))).where("raw_text <> ''"))


#: Numbers of a range in a paper without references; a wider one is no mention there, since nothing says which of them are meant.
WIDEST_RANGE = 100_000


def expand_numeric_group(c: Column) -> Column:
    """'2, 3' to 2 and 3, '1-3' to 1, 2, 3; nothing for an inverted range, or one over ``WIDEST_RANGE``."""

    def ids(part: Column) -> Column:
        lo, hi = (F.regexp_extract(part, r"^(\d+)\s*-\s*(\d+)$", k).try_cast("long") for k in (1, 2))
        span = F.when((lo <= hi) & (hi - lo < WIDEST_RANGE), F.transform(F.sequence(lo, hi), lambda n: n.cast("string"))).otherwise(F.array().cast("array<string>"))
        return F.when(lo.isNotNull() & hi.isNotNull(), span).when(part.rlike(r"^\d+$"), F.array(part)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(F.trim(c), r"\s*[,;]\s*"), ids))


def known_numbers(group: Column, ids: Column) -> Column:
    """The members of ``ids`` that a numeric group names, one for each time it does; a range gives those that lie in it, whatever its width."""
    plain = F.filter(ids, lambda i: i.rlike(r"^(?:0|[1-9]\d*)$") & i.try_cast("decimal(38,0)").isNotNull())

    def named(part: Column) -> Column:
        lo, hi = (F.regexp_extract(part, r"^(\d+)\s*-\s*(\d+)$", k).try_cast("decimal(38,0)") for k in (1, 2))
        inside = F.filter(plain, lambda i: (i.cast("decimal(38,0)") >= lo) & (i.cast("decimal(38,0)") <= hi))
        return F.when(lo <= hi, inside).when(F.array_contains(ids, part), F.array(part)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(F.trim(group), r"\s*[,;]\s*"), named))


_NUMERIC = re.compile(NUMERIC_MENTION)
_AUTHOR = [re.compile(p) for p in AUTHOR_YEAR_MENTIONS]


def _spans(text: str | None) -> list[tuple]:
    """Mentions with code point offsets: numeric groups, and author-year spans that don't overlap, in order."""
    if not text:
        return []
    found = [(m.group(1), m.group(0), m.start(), m.end()) for m in _NUMERIC.finditer(text)]
    named = sorted(((None, m.group(0), m.start(), m.end()) for p in _AUTHOR for m in p.finditer(text)), key=lambda x: x[2])
    end = 0
    for x in named:
        if x[2] >= end:
            found.append(x)
            end = x[3]
    return sorted(found, key=lambda x: x[2])


def mention_spans(text: Column) -> Column:
    """Offsets need a position for every match, which no built-in function gives.

    A plain function: its rows come a hundred at a time, where Arrow's batches hold ten thousand whole texts and their spans at once.
    """
    return F.udf(_spans, "array<struct<group:string,text:string,start:int,end:int>>", useArrow=False)(text)


def find_mentions(texts: DataFrame, raw_refs: DataFrame | None = None) -> DataFrame:
    """``paper_id, ref_id, text, start, end``; with references, numbers must be known ids of the paper.

    Papers without any reference keep all numbers; with references of which none
    has an id, no number is known.
    """
    d = texts.select("paper_id", F.explode(mention_spans(F.col("text"))).alias("m"))
    group = F.col("m.group")
    free = expand_numeric_group(group)
    if raw_refs is not None:
        own = raw_refs.groupBy("paper_id").agg(F.collect_set("ref_id").alias("ids"))
        d = d.join(own, "paper_id", "left")
        free = F.when(F.col("ids").isNull(), free).otherwise(known_numbers(group, F.col("ids")))
    ids = F.when(group.isNull(), F.array(F.lit(None).cast("string"))).otherwise(free)
    return d.select("paper_id", F.explode(ids).alias("ref_id"), "m.text", "m.start", "m.end")


def normalize_citations(raw_refs: DataFrame) -> DataFrame:
    """``paper_id, pos, title, authors, year, doi, arxiv_id, ref_id, ref_ids``.

    Structured fields are used if any of title, doi, arXiv id is present, else
    the raw text. References without an id get ``ref_{position}``.
    """
    structured = X.first_of(F.col("title"), F.col("doi"), F.col("arxiv_id")).isNotNull()
    raw = F.col("raw_text")
    pick = lambda name, other: F.when(structured, F.col(name)).otherwise(other)
    names = F.filter(F.transform(F.coalesce(pick("authors", entry_authors(raw)), F.array().cast("array<string>")), X.collapse), lambda a: a != "")
    d = raw_refs.where(structured | (F.length(X.strip(F.coalesce(raw, F.lit("")))) > 0)).select(
        "paper_id",
        "line_number",
        X.collapse(F.coalesce(pick("title", entry_title(raw)), F.lit(""))).alias("title"),
        names.alias("authors"),
        pick("year", X.year_of(raw)).alias("year"),
        X.clean_doi(pick("doi", X.capture(raw, DOI))).alias("doi"),
        X.clean_arxiv(pick("arxiv_id", X.capture(raw, ARXIV))).alias("arxiv_id"),
        X.blank_to_null(F.col("ref_id")).alias("ref_id"),
    )
    d = d.withColumn("pos", F.row_number().over(Window.partitionBy("paper_id").orderBy("line_number")) - 1)
    d = d.withColumn("ref_id", F.coalesce("ref_id", F.concat(F.lit("ref_"), F.col("pos").cast("string"))))
    return d.select("paper_id", "pos", "title", "authors", "year", "doi", "arxiv_id", "ref_id", F.array("ref_id").alias("ref_ids"))


def merge_duplicate_citations(citations: DataFrame) -> DataFrame:
    """One row per (paper, doi or arXiv id): the first one's fields, the ref ids of all; others stay."""
    key = F.coalesce(F.concat(F.lit("doi:"), F.col("doi")), F.concat(F.lit("arxiv:"), F.col("arxiv_id")), F.concat(F.lit("pos:"), F.col("pos").cast("string")))
    fields = ["pos", "title", "authors", "year", "doi", "arxiv_id", "ref_id"]
    got = citations.withColumn("key", key).groupBy("paper_id", "key").agg(
        F.min_by(F.struct(*fields), "pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "ref_ids"))).alias("all")
    )
    return got.select("paper_id", *[f"first.{f}" for f in fields], F.flatten(F.transform("all", lambda x: x.ref_ids)).alias("ref_ids"))


def citation_contexts(mentions: DataFrame, citations: DataFrame) -> DataFrame:
    """How often a paper's text mentions each cited work: ``paper_id, pos, title, doi, arxiv_id, n_mentions``."""
    ids = citations.select("paper_id", "pos", "title", "doi", "arxiv_id", F.explode("ref_ids").alias("ref_id"))
    return mentions.where("ref_id is not null").join(ids, ["paper_id", "ref_id"]).groupBy("paper_id", "pos", "title", "doi", "arxiv_id").agg(F.count("*").alias("n_mentions"))
