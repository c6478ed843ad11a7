"""Relations between entities that share a sentence."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.functions import vocab
from paperlake.operators.ontology import valid_edges
from paperlake.sources.shared import written


WORD_GAPS = r"(?U)\W+"


def index_word(low: Column) -> Column:
    """The longest word of a name, the first of equal ones; empty where it has none.

    A name between word boundaries begins and ends whole words, so each word of it is a word of the sentence.
    """
    words = F.split(low, WORD_GAPS)
    return F.get(words, F.array_position(F.transform(words, F.length), F.array_max(F.transform(words, F.length))).cast("int") - 1)


LANES = 16  # of 64 bits: a paper's bitmap of name words


def _lane(word: Column) -> Column:
    return F.floor(F.pmod(F.xxhash64(word), F.lit(64 * LANES)) / 64).cast("int")


def _bit(word: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(word), F.lit(64)).cast("int"))


def sentence_index(sents: DataFrame, named: DataFrame) -> DataFrame:
    """``paper_id, word, sec, sent``: the different words of each sentence (the empty word for names without any) that may be a name's.

    ``named`` has ``paper_id, word``. A paper's bitmap of them, 1,024 bits whatever their number, leaves
    out most other words before the shuffle; where many names fill it, the join tells.
    """
    lanes = [F.coalesce(F.bit_or(F.when(_lane(F.col("word")) == i, _bit(F.col("word")))), F.lit(0).cast("long")) for i in range(LANES)]
    maps = named.groupBy("paper_id").agg(F.array(*lanes).alias("lanes"))
    words = F.array_distinct(F.concat(F.split(F.lower("sentence"), WORD_GAPS), F.array(F.lit(""))))
    d = sents.select("paper_id", "sec", "sent", "sentence").join(maps, "paper_id").select("paper_id", "lanes", F.explode(words).alias("word"), "sec", "sent")
    w = F.col("word")
    return d.where(F.get("lanes", _lane(w)).bitwiseAND(_bit(w)) != 0).drop("lanes")


def entities_in_sentences(sents: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of a paper in each of its sentences (``paper_id, sec, sent`` is their key), by lower name between word boundaries.

    Names meet an index of the sentences' words under their longest word, so a long paper
    isn't the product of its names and sentences, and its index is dealt over all tasks.
    """
    last = Window.partitionBy("paper_id", "type", F.lower("name"))
    kinds = Window.partitionBy("paper_id", "type")
    e = entities.select("paper_id", "name", "type", F.min("pos").over(last).alias("first"), "pos", F.min("pos").over(kinds).alias("kind")).withColumn(
        "last", F.max("pos").over(last)
    )
    e = e.where("pos = last").select("paper_id", "name", "type", "kind", F.col("first").alias("pos"), F.lower("name").alias("low"))
    named = e.withColumn("word", index_word(F.col("low")))
    hits = sentence_index(sents, named).join(named, ["paper_id", "word"]).drop("word")
    found = sents.select("paper_id", "sec", "sent", "sentence").join(hits, ["paper_id", "sec", "sent"])
    found = found.select("paper_id", "sec", "sent", "sentence", F.lower("sentence").alias("text"), "name", "type", "kind", "pos", "low")
    return found.where(_stands_alone(F.col("text"), F.col("low")))


def _stands_alone(text: Column, name: Column) -> Column:
    """Whether ``name`` stands in ``text`` between word boundaries: it is replaced by a mark, so that fixed patterns tell."""
    marked = F.replace(text, name, F.lit("\x00"))
    cases = []
    for first, last in product((True, False), repeat=2):
        begins, ends = name.rlike(r"(?U)^\w"), name.rlike(r"(?U)\w$")
        before = r"(?<![\w\x00])" if first else r"(?<=[\w\x00])" if last else r"(?<=\w)"
        after = r"(?![\w\x00])" if last else r"(?=[\w\x00])" if first else r"(?=\w)"
        cases.append((begins if first else ~begins) & (ends if last else ~ends) & marked.rlike(f"(?U){before}\x00{after}"))
    return reduce(Column.__or__, cases)


def relation_candidates(found: DataFrame) -> DataFrame:
    """Ordered pairs of one of the seven typed kinds with a pattern in the text strictly between the names.

    A sentence and its entities are one row, so pairs are made in the row.
    """
    names = ("name", "type", "kind", "pos", "low")
    one = found.groupBy("paper_id", "sec", "sent").agg(F.first("sentence").alias("sentence"), F.first("text").alias("text"), F.collect_list(F.struct(*names)).alias("found"))
    typed = lambda a, b: F.concat_ws(">", a.type, b.type).isin([f"{x}>{y}" for x, y in vocab.RELATIONS]) & ((a.type != b.type) | (a.low != b.low))
    pair = lambda a, b: F.struct(*[a[c].alias(f"{c}_a") for c in names], *[b[c].alias(f"{c}_b") for c in names])
    pairs = F.flatten(F.transform("found", lambda a: F.transform(F.filter("found", lambda b: typed(a, b)), lambda b: pair(a, b))))
    pairs = one.select("paper_id", "sec", "sent", "sentence", "text", F.inline(pairs))
    i, j = F.instr("text", F.col("low_a")), F.instr("text", F.col("low_b"))
    between = F.when(i < j, F.substring("text", i + F.length("low_a"), F.greatest(j - i - F.length("low_a"), F.lit(0)))).otherwise(
        F.substring("text", j + F.length("low_b"), F.greatest(i - j - F.length("low_b"), F.lit(0)))
    )
    pairs = pairs.withColumn("between", between)
    edge = F.coalesce(
        *[F.when((F.col("type_a") == a) & (F.col("type_b") == b), X.first_case(F.col("between"), cases)) for (a, b), cases in vocab.RELATIONS.items()]
    )
    return pairs.withColumn("relation", edge).where("relation is not null")


#: What each alternative of the patterns of ``vocab.RELATIONS`` begins with.
RELATION_STEMS = [
    "improve", "outperform", "better than", "superior to", "surpass", "beat", "extend", "build", "incorporate", "introduce", "propose", "variant of", "variation of", "version of",
    "derivative of", "compare", "vs", "versus", "against", "evaluate", "test", "train", "benchmark", "use", "applie", "achieve", "solve", "address", "design", "tackle", "target",
    "dataset for", "standard for", "created for", "report", "obtain", "measured by", "show", "yield",
]


def may_relate(sents: DataFrame) -> DataFrame:
    """Sentences that hold the beginning of a relation's pattern, inside a word or not: without it no two names of theirs are related."""
    # lower case comes out of a generator: otherwise each of the searches would make it anew
    low = sents.select("*", F.explode(F.array(F.lower("sentence"))).alias("low"))
    return low.where(X.contains_any(F.col("low"), RELATION_STEMS)).drop("low")


def extract_relations(sents: DataFrame, entities: DataFrame) -> DataFrame:
    """``paper_id, pos, source, source_type, relation, target, target_type, evidence``; the first of (source, relation, target) stays."""
    said = written(may_relate(sents), "said")  # read twice
    c = relation_candidates(entities_in_sentences(said, entities))
    c = valid_edges(c.withColumns({"source_type": F.col("type_a"), "edge_type": F.col("relation"), "target_type": F.col("type_b")}))
    order = ["sec", "sent", "kind_a", "pos_a", "kind_b", "pos_b"]
    rest = [F.col("name_a").alias("source"), "source_type", F.col("name_b").alias("target"), "target_type", F.trim("sentence").alias("evidence")]
    first = c.groupBy("paper_id", "low_a", "relation", "low_b").agg(F.min(F.struct(*order, *rest)).alias("f"))
    w = Window.partitionBy("paper_id").orderBy(*[f"f.{o}" for o in order])
    return first.withColumn("pos", F.row_number().over(w) - 1).select(
        "paper_id", "pos", "f.source", "f.source_type", "relation", "f.target", "f.target_type", "f.evidence"
    )
