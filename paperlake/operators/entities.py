"""Typed entities with evidence, from sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.functions import vocab


def split_sentences(c: Column) -> Column:
    return F.filter(F.split(X.collapse(c), r" (?<=[.!?] )"), lambda s: s != "")  # single spaces are all that is left of white space


def sentences(parsed: DataFrame) -> DataFrame:
    """``paper_id, sec, section, sent, sentence``: abstract first, then the sections in order; else the raw text."""
    sec = F.concat(
        F.when(F.length("abstract") > 0, F.array(F.struct(F.lit("Abstract").alias("heading"), F.col("abstract").alias("text")))).otherwise(
            F.array().cast("array<struct<heading:string,text:string>>")
        ),
        F.transform("sections", lambda s: F.struct(s.heading.alias("heading"), s.text.alias("text"))),
    )
    sec = F.when(F.size(sec) > 0, sec).otherwise(F.array(F.struct(F.lit("Unknown").alias("heading"), F.coalesce("text", F.lit("")).alias("text"))))
    d = parsed.select("paper_id", F.posexplode(sec).alias("sec", "s"))
    return d.select("paper_id", "sec", F.col("s.heading").alias("section"), F.posexplode(split_sentences(F.col("s.text"))).alias("sent", "sentence"))


def words_of(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case. Whatever stands between word boundaries begins and ends with whole ones."""
    return F.split(F.lower(c), "[^a-z0-9]+")


def first_words(terms: list[str]) -> list[str]:
    return sorted({re.split("[^a-z0-9]+", t.lower())[0] for t in terms})


#: Words without which no pattern of a group matches.
CAPTURE_WORDS = {
    "Method": ["model", "method", "architecture", "framework", "algorithm", "approach"],
    "Dataset": ["dataset", "corpus", "benchmark"],
    "Task": ["task", "problem"],
    "Metric": ["score", "rate", "error"],
}
CLAIM_WORDS = [
    "show", "demonstrate", "prove", "find", "observe", "claim", "conclude", "indicate", "suggest",
    *(v + s for v in ("outperform", "improve", "achieve", "reduce", "increase") for s in ("", "s")), "art",
]
EXPERIMENT_WORDS = ["experiment", "experiments", "experimental", "evaluate", "evaluated", "evaluation", "evaluating", "ablation", "benchmark", "baseline", "baselines"]
TERMS = {"Method": vocab.METHODS, "Dataset": vocab.DATASETS, "Task": vocab.TASKS, "Metric": vocab.METRICS}
CAPTURES = {"Method": vocab.METHOD_CAPTURES, "Dataset": vocab.DATASET_CAPTURES, "Task": vocab.TASK_CAPTURES, "Metric": vocab.METRIC_CAPTURES}
ANY_WORDS = sorted({w for t in TERMS.values() for w in first_words(t)} | {w for ws in CAPTURE_WORDS.values() for w in ws} | {*CLAIM_WORDS, *EXPERIMENT_WORDS})
#: Those words as ``words_of`` a sentence in lower case has them (group 1). Most sentences have none, and one pass over their letters tells;
#: what stands before a word is matched, too, since a look behind at each letter takes longer.
ANY_WORD = f"(?:^|[^a-z0-9])({X.one_of(ANY_WORDS)})(?![a-z0-9])"


def has_word(words: Column, wanted: list[str]) -> Column:
    """A look-up of each word in a fixed set."""
    return F.exists(words, lambda w: w.isin(wanted))


def known_terms(c: Column, terms: list[str], ignore_case: bool = False) -> Column:
    """Terms that occur between word boundaries, longer ones first."""
    flag = "(?i)" if ignore_case else ""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    return F.array_compact(F.array(*[F.when(c.rlike(rf"{flag}\b\Q{t}\E\b"), F.lit(t)) for t in ordered]))


def capture_names(c: Column, patterns: list[str]) -> Column:
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns])


def claim_name(c: Column) -> Column:
    words = F.split(X.collapse(c), " ")
    return F.when(F.size(words) <= 12, X.collapse(c)).otherwise(F.concat(F.array_join(F.slice(words, 1, 12), " "), F.lit("…")))


def experiment_name(c: Column, section: Column) -> Column:
    kind = F.when(c.rlike(r"(?i)\bablation\b"), "ablation").when(c.rlike(r"(?i)\bbenchmark\b"), "benchmark").otherwise("experiment")
    return F.concat_ws(" ", F.coalesce(X.clean_name(section), F.lit("Experiment")), kind)


def candidates(c: Column, section: Column, words: Column | None = None) -> Column:
    """Names and types of one sentence, in the order of the rules. A group's patterns are only tried where ``words_of`` the sentence has a word of theirs."""
    words = words_of(c) if words is None else words
    none = F.array().cast("array<string>")
    typed = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))
    where = lambda wanted, names, kind: typed(F.when(has_word(words, wanted), names).otherwise(none), kind)
    groups = []
    for kind, terms in TERMS.items():
        groups.append(where(first_words(terms), known_terms(c, terms, kind in ("Task", "Metric")), kind))
        groups.append(where(CAPTURE_WORDS[kind], capture_names(c, CAPTURES[kind]), kind))
    one = lambda cond, name: F.when(cond, F.array(name)).otherwise(none)
    groups.append(where(CLAIM_WORDS, one(X.any_match(c, vocab.CLAIMS), claim_name(c)), "Claim"))
    groups.append(where(EXPERIMENT_WORDS, one(X.any_match(c, vocab.EXPERIMENTS), experiment_name(c, section)), "Experiment"))
    return F.concat(*groups)


def extract_entities(sents: DataFrame) -> DataFrame:
    """One row per (paper, type, lower name), from its first occurrence: name, type, section, evidence, role, order."""
    s = F.col("sentence")
    d = sents.where(F.lower(s).rlike(ANY_WORD)).withColumn("words", F.regexp_extract_all(F.lower(s), F.lit(ANY_WORD), F.lit(1)))
    d = d.select("paper_id", "sec", "sent", "section", "sentence", F.posexplode(candidates(s, F.col("section"), F.col("words"))).alias("rule", "c"))
    # the bare name comes out of a generator: a filter on it isn't moved below, where each of its uses would be computed anew
    d = d.select("paper_id", "sec", "sent", "rule", "section", "sentence", F.col("c.type").alias("type"), F.explode(F.array(X.bare_name(F.col("c.name")))).alias("name"))
    named = F.col("type").isin("Claim", "Experiment") | X.plausible_name(F.col("name"))
    d = d.where(F.col("name").isNotNull() & X.can_be_name(F.col("name")) & named)
    first = d.groupBy("paper_id", "type", F.lower("name").alias("low")).agg(F.min(F.struct("sec", "sent", "rule", "name", "section", "sentence")).alias("f"))
    # what follows from the sentence is worked out for the entities that are left
    first = first.withColumns({"source_section": F.coalesce(X.clean_name(F.col("f.section")), F.lit("Unknown")), "evidence": X.collapse(F.col("f.sentence"))})
    order = Window.partitionBy("paper_id").orderBy("f.sec", "f.sent", "f.rule")
    return first.withColumn("pos", F.row_number().over(order) - 1).select(
        "paper_id", "pos", "f.name", "type", "source_section", "evidence", X.paper_role(F.col("evidence"), F.col("type")).alias("role")
    )


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("paper_id", "type").agg(F.count("*").alias("n"))
