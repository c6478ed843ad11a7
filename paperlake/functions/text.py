"""Text columns: everything stays in Spark's own expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.functions import vocab


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def stripped_lines(text: Column) -> Column:
    """The lines of a text, each as ``strip`` leaves it; the pattern is only tried on lines that begin or end with white space."""
    padded = lambda x: F.substring(x, 1, 1).rlike(r"(?U)\s") | F.substring(x, -1, 1).rlike(r"(?U)\s")
    return F.transform(F.split(text, "\n"), lambda x: F.when(padded(x), strip(x)).otherwise(x))


def collapse(c: Column) -> Column:
    """White space runs become one space, none is left at the ends. Single spaces, which are most, are no match."""
    return F.trim(F.regexp_replace(c, r"(?U)\s(?:\s+|(?<! ))", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_of(*cs: Column) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def any_match(c: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    return c.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def one_of(words: list[str]) -> str:
    """A pattern of fixed words that spells common beginnings once, so that few letters are tried at each place of a text."""
    rest: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    if not rest:
        return ""
    branches = "|".join(re.escape(c) + one_of(ws) for c, ws in rest.items())
    if "" in words:
        return f"(?:{branches})?"
    return f"(?:{branches})" if len(rest) > 1 else branches


def contains_any(c: Column, parts: list[str]) -> Column:
    """Whether a text holds one of the parts, anywhere: plain searches, several times as fast as a pattern. ``c`` should be a plain column."""
    return reduce(Column.__or__, [c.contains(p) for p in parts])


def first_case(c: Column, cases: list[tuple[str, str]]) -> Column:
    """The label of the first pattern that matches."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(v)) for p, v in cases]) if cases else F.lit(None).cast("string")


def is_heading(line: Column) -> Column:
    return line.rlike("(?i)^(?:" + "|".join(vocab.SECTION_HEADINGS) + ")")


def needs_ocr(text: Column, least: int = 20) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < least


def year_of(c: Column) -> Column:
    return capture(c, r"\b((?:19|20)\d{2})\b").try_cast("int")


def valid_doc_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^(?:[0-9a-f]{64}|arxiv-\d{4}\.\d{4,5}|arxiv-[a-z-]+(?:\.[a-z]{2})?/\d{7})$"), F.lit(False))


def normalize_doi(c: Column) -> Column:
    """Lower case without a resolver's prefix; null unless it begins with 10."""
    d = F.lower(F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/|^doi:", ""))
    return F.when(d.startswith("10."), d)


def clean_doi(c: Column) -> Column:
    """A citation's doi in lower case without white space; null unless it begins with 10. as it stands."""
    d = F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.when(d.startswith("10."), d)


def normalize_arxiv_id(c: Column) -> Column:
    """Identifier without prefix, address, file ending and version."""
    d = F.regexp_replace(F.trim(c), r"(?i)^(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/|^arxiv:\s*", "")
    d = F.regexp_replace(F.regexp_replace(d, r"(?i)\.pdf$", ""), r"(?i)v\d+$", "")
    return F.when(d.rlike(r"^\d{4}\.\d{4,5}$|^[a-z-]+(?:\.[A-Z]{2})?/\d{7}$"), d)


def arxiv_version(c: Column) -> Column:
    return capture(F.regexp_replace(F.trim(c), r"(?i)\.pdf$", ""), r"(?i)v(\d+)$").try_cast("int")


def clean_arxiv(c: Column) -> Column:
    d = F.regexp_replace(c, r"\s+", "")
    return F.when(d.rlike(r"^\d{4}\.\d{4,5}$"), d)


def evidence_grounded(evidence: Column, text: Column, least: int = 20) -> Column:
    e = F.lower(collapse(evidence))
    return F.coalesce((F.length(e) >= least) & F.lower(collapse(text)).contains(e), F.lit(False))


def bare_name(c: Column) -> Column:
    """Name without edge punctuation, leading article and trailing type noun."""
    d = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), vocab.NAME_EDGES, "")
    return F.regexp_replace(F.regexp_replace(d, vocab.NAME_ARTICLE, ""), vocab.NAME_NOUN, "")


def can_be_name(d: Column) -> Column:
    """Whether what ``bare_name`` left can be a name."""
    bad = F.lower(d).isin(vocab.NO_NAMES) | d.rlike(vocab.NUMBER_NAME)
    return F.length(d).between(*vocab.NAME_LENGTH) & ~bad


def clean_name(c: Column) -> Column:
    """``bare_name``; null if it can't be a name."""
    d = bare_name(c)
    return F.when(can_be_name(d), d)


def plausible_name(c: Column) -> Column:
    """Not a function word, fragment or clause."""
    words = F.split(F.trim(c), r"\s+")
    low = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", ""))
    stop = F.array(*[F.lit(w) for w in vocab.STOPWORD_NAMES])
    inner = F.array(*[F.lit(w) for w in vocab.INTERIOR_CONNECTORS])
    return (
        ~F.array_contains(stop, F.get(low, F.lit(0)))
        & ~F.element_at(low, -1).isin(vocab.DANGLING_TAILS)
        & ~F.exists(F.slice(low, F.lit(2), F.greatest(F.size(low) - 2, F.lit(0))), lambda w: F.array_contains(inner, w))
        & ~c.rlike(vocab.CLAUSE_MARKERS)
        & (F.size(words) <= vocab.MAX_NAME_WORDS)
        & c.rlike("[A-Za-z]")
    )


def paper_role(evidence: Column, kind: Column) -> Column:
    return F.coalesce(*[F.when((kind == k) & evidence.rlike(p), F.lit(v)) for k, cases in vocab.ROLES.items() for p, v in cases])


def classify_query(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.coalesce(*[F.when(any_match(text, ps, ""), F.lit(k)) for k, ps in vocab.QUERY_CLASSES], F.lit("EXPLANATION"))


def short_hash(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 12)


def uuid5(name: Column, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """Version 5 UUID of a name (the DNS namespace by default)."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.substring(F.sha1(F.concat(space, F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
