"""Entities, relations, model output and routing."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.functions import vocab
from paperlake.operators import entities as E
from paperlake.operators import llm_output as L
from paperlake.operators import ontology as O
from paperlake.operators import relations as R
from paperlake.operators import routing as T


def sents(spark, *texts, section="Introduction"):
    rows = [("p", 0, section, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "paper_id string, sec int, section string, sent int, sentence string")


def found(spark, *texts, **more):
    return [(r.type, r.name) for r in E.extract_entities(sents(spark, *texts, **more)).orderBy("pos").collect()]


def test_one_of_every_type(spark):
    got = found(spark, "We propose the DeepFoo model for machine translation.", "It is trained on the ImageNet dataset.", "The BarNet method achieves a BLEU score.", "An ablation was run.")
    assert ("Method", "DeepFoo") in got and ("Task", "machine translation") in got and ("Dataset", "ImageNet") in got
    assert ("Method", "BarNet") in got and ("Metric", "BLEU") in got and ("Metric", "BLEU score") in got
    assert ("Experiment", "Introduction ablation") in got and any(t == "Claim" for t, _ in got)


def test_looking_words_up_first_loses_nothing(spark):
    """Every pattern on every sentence, against only those of which a word is there."""
    rng = random.Random(2)
    nouns = [w for ws in E.CAPTURE_WORDS.values() for w in ws]
    pool = vocab.METHODS + vocab.DATASETS + vocab.TASKS + vocab.METRICS + nouns + E.CLAIM_WORDS + E.EXPERIMENT_WORDS
    pool += "we We the a of on for using propose Deep Net results state art reports achieves é_ BERT_x xBERT éBERT BERTé CIFAR-100s F1-scores state-of-the-art".split()
    texts = ["".join(rng.choice(pool).replace("e", rng.choice("eeeeE")) + rng.choice([" ", " ", " ", ", ", "-", "_", "é", "’s ", "."]) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    texts += [w for p in pool for w in (p, p.upper(), f"We show {p}s")]
    d = spark.createDataFrame([(t,) for t in texts], "s string")
    c = F.col("s")
    typed = lambda names, kind: F.transform(names, lambda n: F.concat(F.lit(f"{kind} "), n))
    plain = F.array_sort(F.concat(
        *[typed(E.known_terms(c, t, k in ("Task", "Metric")), k) for k, t in E.TERMS.items()],
        *[typed(E.capture_names(c, p), k) for k, p in E.CAPTURES.items()],
        F.when(X.any_match(c, vocab.CLAIMS), F.array(F.lit("Claim"))).otherwise(F.array().cast("array<string>")),
        F.when(X.any_match(c, vocab.EXPERIMENTS), F.array(F.lit("Experiment"))).otherwise(F.array().cast("array<string>")),
    ))
    found = F.when(E.has_word(E.words_of(c), E.ANY_WORDS), E.candidates(c, F.lit("S")))
    named = F.transform(F.coalesce(found, F.array().cast("array<struct<name:string,type:string>>")), lambda x: F.when(x["type"].isin("Claim", "Experiment"), x["type"]).otherwise(F.concat(x["type"], F.lit(" "), x["name"])))
    rows = d.select("s", plain.alias("want"), F.array_sort(named).alias("got")).collect()
    assert [r for r in rows if r.want != r.got] == [] and sum(bool(r.want) for r in rows) > 300


@pytest.mark.parametrize("text", ["The model works.", "Our approach is good.", "This enables the method.", "All dataset items.", "We use the method."])
def test_function_words_are_no_names(spark, text):
    assert [x for x in found(spark, text) if x[0] in ("Method", "Dataset")] == []


def test_longer_terms_first_and_one_per_lower_name(spark):
    got = found(spark, "Multi-Head Attention and GraphRAG, RAG.", "rag is not matched but RAG is.")
    assert got == [("Method", "Multi-Head Attention"), ("Method", "GraphRAG"), ("Method", "RAG")]


def test_section_names_that_are_type_words_become_unknown(spark):
    r = E.extract_entities(sents(spark, "BERT is evaluated.", section="Method")).collect()
    assert {x.source_section for x in r} == {"Unknown"} and "Experiment experiment" in {x.name for x in r}


def test_roles(spark):
    r = {x.name: x.role for x in E.extract_entities(sents(spark, "We introduce BERT.", "We use ResNet on MNIST.", "GPT exists.", "It addresses question answering.")).collect()}
    assert r["BERT"] == "introduces" and r["ResNet"] == "uses_method" and r["MNIST"] == "uses_dataset" and r["GPT"] is None and r["question answering"] == "solves_task"


def test_claims_are_cut_after_twelve_words(spark):
    long = "We show that " + " ".join(f"w{i}" for i in range(20))
    name = [n for t, n in found(spark, long) if t == "Claim"][0]
    assert name.endswith("…") and len(name.split()) == 12


@pytest.mark.parametrize("name,want", [("the BERT model", "BERT"), (" (x) ", None), ("3.14", None), ("Method", None), ("A", None), ("an Odd  Name,", "Odd Name"), ("x" * 121, None)])
def test_clean_name(spark, name, want):
    assert spark.range(1).select(X.clean_name(F.lit(name)).alias("x")).first().x == want


def test_sentences_of_a_parsed_paper(spark):
    p = spark.createDataFrame([("a", "One. Two!", [(0, "Intro", "Three?  Four")], "t"), ("b", None, [], "Raw text. More")], "paper_id string, abstract string, sections array<struct<idx:int,heading:string,text:string>>, text string")
    got = sorted((r.paper_id, r.sec, r.sent, r.section, r.sentence) for r in E.sentences(p).collect())
    assert got == [("a", 0, 0, "Abstract", "One."), ("a", 0, 1, "Abstract", "Two!"), ("a", 1, 0, "Intro", "Three?"), ("a", 1, 1, "Intro", "Four"), ("b", 0, 0, "Unknown", "Raw text."), ("b", 0, 1, "Unknown", "More")]


def relations(spark, entities, *texts):
    e = spark.createDataFrame([("p", i, n, t) for i, (n, t) in enumerate(entities)], "paper_id string, pos int, name string, type string")
    return [(r.source, r.relation, r.target) for r in R.extract_relations(sents(spark, *texts), e).orderBy("pos").collect()]


def test_relations(spark):
    e = [("Foo", "Method"), ("Bar", "Method"), ("MNIST", "Dataset"), ("question answering", "Task")]
    got = relations(spark, e, "Foo outperforms Bar.", "Foo was evaluated on MNIST.", "Foo solves question answering.", "Foo outperforms Bar.")
    assert got == [("Foo", "IMPROVES_UPON", "Bar"), ("Bar", "IMPROVES_UPON", "Foo"), ("Foo", "USES_DATASET", "MNIST"), ("Foo", "SOLVES_TASK", "question answering")]
    assert relations(spark, e, "Foobar outperforms Bar.", "Bar and MNIST.", "Foo alone.") == []


def test_relation_text_must_be_between_the_names(spark):
    assert relations(spark, [("Foo", "Method"), ("Bar", "Method")], "It outperforms Foo and Bar.") == []


def test_names_in_sentences_equal_every_pair(spark):
    """The index of words gives what each name against each sentence gives, for names of any form."""
    names = ["Foo", "foo bar", "F1-score", "C++", ".NET", "++", "Net", "\u03b1-Net", "d\u00e9j\u00e0 vu", "a b", "x_1", " ", "Q"]
    texts = ["Foo bar and foo-bar", "C++ isn't xC++y or C++z", "the .NET and a.NET.", "++", "a++b", "\u0391-net, \u03b1-Net2", "D\u00e9j\u00e0 Vu again; d\u00e9j\u00e0 vus", "a b a b", "x_1 x_11", "", "f1-score F1 score", "Foo Foo Foo", "q. Q? qq"]
    s = spark.createDataFrame([(p, 0, i, "S", t) for p in "pq" for i, t in enumerate([*texts, None])], "paper_id string, sec int, sent int, section string, sentence string")
    e = spark.createDataFrame([("p", i, n, k) for i, (n, k) in enumerate((n, k) for n in names for k in ("Method", "Task"))] + [("q", 0, "Foo", "Method")], "paper_id string, pos int, name string, type string")
    got = sorted((r.paper_id, r.sent, r.name, r.type) for r in R.entities_in_sentences(s, e).collect())

    def edge(a, b):
        word = lambda c: c.isalnum() or c == "_"
        return word(a or " ") != word(b or " ")

    def inside(name, text):
        low, t = name.lower(), text.lower()
        return any(t.startswith(low, i) and edge(t[i - 1 : i], low[0]) and edge(low[-1], t[i + len(low) : i + len(low) + 1]) for i in range(len(t)))

    pairs = [("p", i, n, k) for n in names for k in ("Method", "Task") for i, t in enumerate(texts) if inside(n, t)]
    assert got == sorted(pairs + [("q", i, "Foo", "Method") for i, t in enumerate(texts) if inside("Foo", t)])
    assert {n for _, _, n, _ in got} >= {"Foo", "foo bar", "C++", ".NET", "++", "\u03b1-Net", "d\u00e9j\u00e0 vu"}


def test_a_long_paper_is_no_product_of_names_and_sentences(spark):
    """Names meet sentences under (paper, word): only the bitmaps, one of each paper, have the paper alone as their key."""
    s = spark.createDataFrame([("p", 0, 0, "S", "Foo")], "paper_id string, sec int, sent int, section string, sentence string")
    e = spark.createDataFrame([("p", 0, "Foo", "Method")], "paper_id string, pos int, name string, type string")
    plan = R.entities_in_sentences(s, e)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 3 and sum(line.count(" = ") >= 2 for line in joins) == 2


def test_ontology(spark):
    assert O.ontology(spark).count() == 26
    df = spark.createDataFrame([("Paper", "CITES", "Paper"), ("Paper", "CITES", "Dataset")], "source_type string, edge_type string, target_type string")
    assert [r.target_type for r in O.valid_edges(df).collect()] == ["Paper"]
    rules = {r.rule for r in O.describe_ontology(spark).collect()}
    assert len(rules) == len(vocab.ONTOLOGY) and "Paper MENTIONS Dataset|Method|Metric|Task" in rules


RAW = [
    ("bare", '[{"name": "Foo", "type": "Method", "evidence": "we propose the Foo model here", "confidence": 2}]'),
    ("fence", 'Sure:\n```json\n[{"name": "Foo", "type": "Method", "evidence": "we propose the Foo model here"}]\n```\ndone'),
    ("prose", 'I found [{"name": "Foo", "type": "Method", "evidence": "We  propose the foo model here"}] in it'),
    ("single", '{"name": "Foo", "type": "Method", "evidence": "we propose the Foo model here", "confidence": "x"}'),
    ("garbage", "no json at all"),
    ("empty", ""),
    ("ungrounded", '[{"name": "Foo", "type": "Method", "evidence": "this is not in the text at all"}]'),
    ("short", '[{"name": "Foo", "type": "Method", "evidence": "Foo"}]'),
    ("kind", '[{"name": "Foo", "type": "Author", "evidence": "we propose the Foo model here"}]'),
]


def test_model_entities(spark):
    raw = spark.createDataFrame(RAW, "paper_id string, raw string")
    texts = raw.select("paper_id", F.lit("In this paper we propose the Foo model here.").alias("text"))
    got = {r.paper_id: r.confidence for r in L.validate_llm_entities(raw, texts).collect()}
    assert got == {"bare": 1.0, "fence": 0.5, "prose": 0.5, "single": 0.5}


def test_model_entities_keep_their_section_and_model(spark):
    item = '{"name": "Foo", "type": "Method", "evidence": "we propose the Foo model here"'
    raw = spark.createDataFrame([("a", item + ', "source_section": " Intro ", "section": "no"}'), ("b", item + ', "section": "no"}')], "paper_id string, raw string")
    texts = raw.select("paper_id", F.lit("In this paper we propose the Foo model here.").alias("text"))
    got = {r.paper_id: (r.source_section.strip(), r.extracted_by) for r in L.validate_llm_entities(raw, texts, "model-7").collect()}
    assert got == {"a": ("Intro", "model-7"), "b": ("", "model-7")}


def test_names_stand_between_word_boundaries(spark):
    import re

    from pyspark.sql import functions as F

    rows = [(t, n) for t in ["foo foobar", "foobar", "barfoo foo", "a.foo,b", "foofoo", "foo-foo", "c++ is", "c++x", "xc++", "(c++)", "naïve bayes", "naïvefoo", "éfoo", ".net core", "x.net"] for n in ["foo", "c++", "naïve", ".net"]]
    d = spark.createDataFrame(rows, "t string, n string")
    for r in d.select("t", "n", R._stands_alone(F.col("t"), F.col("n")).alias("ok")).collect():
        assert r.ok == bool(re.search(rf"\b{re.escape(r.n)}\b", r.t)), r


def test_model_relations(spark):
    ev = "Foo outperforms Bar by a large margin"
    item = lambda s, t, r="IMPROVES_UPON": f'{{"source": "{s}", "relation": "{r}", "target": "{t}", "evidence": "{ev}"}}'
    raw = spark.createDataFrame([("p", f"[{item('foo', 'Bar')}, {item('Foo', 'FOO')}, {item('Foo', 'Nix')}, {item('Foo', 'Bar', 'CITES')}]")], "paper_id string, raw string")
    texts = spark.createDataFrame([("p", f"{ev}.")], "paper_id string, text string")
    ents = spark.createDataFrame([("p", 0, "Foo", "Task"), ("p", 1, "Foo", "Method"), ("p", 2, "Bar", "Method")], "paper_id string, pos int, name string, type string")
    assert [(r.source, r.relation, r.target) for r in L.validate_llm_relations(raw, texts, ents).collect()] == [("foo", "IMPROVES_UPON", "Bar")]


LONG = "e" * 40


@pytest.mark.parametrize(
    "conf,evidence,agreed,score,routing",
    [
        (None, LONG, False, 0.9, "auto_insert"), ("x", LONG, False, 0.9, "auto_insert"), ("0.85", LONG, False, 0.85, "auto_insert"), ("0.8499", LONG, False, 0.8499, "draft"),
        ("0.5", LONG, False, 0.5, "draft"), ("0.49", LONG, False, 0.49, "manual"), ("0.9", " ", True, 0.0, "discarded"), ("0.9", "short", False, 0.7, "draft"),
        ("0.8", LONG, True, 0.95, "auto_insert"), ("0.95", LONG, True, 1.0, "auto_insert"), ("0.1", "short", False, 0.0, "discarded"),
    ],
)
def test_scores(spark, conf, evidence, agreed, score, routing):
    df = spark.createDataFrame([(conf, evidence, agreed)], "confidence string, evidence string, agreed boolean")
    r = T.route(df).first()
    assert r.confidence == pytest.approx(score) and r.routing == routing


def test_merge_and_split(spark):
    s = "paper_id string, pos int, name string, type string, evidence string, confidence double, extracted_by string"
    h = spark.createDataFrame([("p", 0, "Foo", "Method", "h1", None, "heuristic"), ("p", 1, "foo", "Method", "h2", None, "heuristic"), ("p", 2, "Solo", "Task", LONG, None, "heuristic")], s)
    m = spark.createDataFrame([("p", 0, "FOO", "Method", "m1", 0.4, "llm"), ("p", 1, "Foo", "Method", LONG, 0.6, "llm"), ("p", 2, "New", "Task", LONG, 0.3, "llm")], s)
    got = {r.name: r for r in T.route(T.merge_sources(h, m, "entity")).collect()}
    assert got["Foo"].extracted_by == "both" and got["Foo"].confidence == 0.75 and got["Solo"].extracted_by == "heuristic" and got["New"].routing == "manual"
    routed = T.route(T.merge_sources(h, m, "entity"))
    graph, queue = T.split_routed(routed)
    assert (graph.count(), queue.count()) == (1, 2)
    assert T.split_routed(routed, has_queue=False)[0].count() == 3
    with pytest.raises(ValueError):
        T.decide(F.lit(0.5), 0.5, 0.8)


def test_names_are_cleaned_once(spark):
    """No filter repeats the cleaning of a name for each of its uses."""
    sents = spark.createDataFrame([("p", 0, "Abstract", 0, "We use the BERT model.")], "paper_id string, sec int, section string, sent int, sentence string")
    plan = E.extract_entities(sents)._jdf.queryExecution().optimizedPlan().toString()
    assert vocab.NAME_ARTICLE in plan and not [line for line in plan.splitlines() if " Filter " in f" {line.lstrip('+-: ')}" and vocab.NAME_ARTICLE in line]


def test_sentences_without_a_word_of_a_rule_are_left_out_by_one_pattern(spark):
    assert X.one_of(["use", "used", "show", "user"]) == "(?:show|use(?:d|r)?)"
    texts = ["We SHOW it.", "showy art-house", "f1score", "an F1 score", "the proposed", "état-of-the-artà", "ünshow", "", "BERT", "bert2 ärt"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(E.has_word(E.words_of(F.col("t")), E.ANY_WORDS).alias("by_words"), F.lower("t").rlike(E.ANY_WORD).alias("by_pattern")).collect()
    assert [r.by_words for r in got] == [r.by_pattern for r in got] and {r.by_words for r in got} == {True, False}


def test_every_relation_begins_with_a_stem(spark):
    for pattern, _ in [c for cases in vocab.RELATIONS.values() for c in cases]:
        for way in re.fullmatch(r"\\b\(\?:(.*)\)\\b", pattern).group(1).split("|"):
            fixed = re.match(r"[a-z ]*", way).group()
            assert any(fixed.removesuffix(fixed[-1] if way[len(fixed) :].startswith("?") else "").startswith(s) for s in R.RELATION_STEMS), way
    s = spark.createDataFrame([("Foo OUTPERFORMS Bar",), ("Foobeats Bar",), ("the red ones",)], "sentence string")
    assert sorted(r.sentence for r in R.may_relate(s).collect()) == ["Foo OUTPERFORMS Bar", "Foobeats Bar"]
