"""The pipeline: stages in order, columns, decisions."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline as P
from paperlake.llm import queries, sentencepiece, toxicity
from tests.llm.test_line_dedup import model as line_model
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_are_named_in_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near duplicates", "source mixing", "sentencepiece"]
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES)
    assert len(queries.QUERIES) == 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, stages = docs.columns, dict(P.STAGES)

    def step(name, df):
        out = P.materialize(stages[name](spark, df, SF), "test")
        assert out.columns == columns
        return out, {r.doc_id: r.text for r in out.collect()}

    before = {r.doc_id: r.text for r in docs.collect()}
    low = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    docs, now = step("toxicity", docs)
    assert now == {i: before[i] for i in low} and len(now) < len(before)

    before, (docs, now) = now, step("line dedup", docs)
    may, must = line_model(list(before.items()))
    for i, t in before.items():
        lines = t.split("\n")
        may_go, must_go = ({j for j in range(len(lines)) if (i, j) in which} for which in (may, must))
        if i not in now:
            assert len(may_go) == len(lines)
            continue
        kept = now[i].split("\n")
        assert len(lines) - len(may_go) <= len(kept) <= len(lines) - len(must_go)
        assert not Counter(kept) - Counter(lines)
        if not may_go:
            assert now[i] == t

    before, (docs, now) = now, step("near duplicates", docs)
    _, groups = brute(list(before.items()))
    assert all(before[i] == t for i, t in now.items())
    assert sorted(groups[i] for i in now) == sorted(set(groups.values()))

    before, (docs, now) = now, step("source mixing", docs)
    assert now == before  # nothing is left out
    times = Counter(r.doc_id for r in docs.collect())
    assert set(times.values()) <= {1, 2}

    out = stages["sentencepiece"](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in out) == times
    sp = sentencepiece.codec(sentencepiece.default_path()).sp
    assert all(list(r.input_ids) == sp.encode(now[r.doc_id]) and r.n_tokens == len(r.input_ids) for r in out)


def test_odd_rows_and_an_empty_table_pass_every_stage(spark, odd_docs, no_docs, tmp_path):
    """Nulls, empty and very long texts, repeated rows; a table without rows; a table without language and source."""
    odd_docs.sparkSession.createDataFrame([(1, 1), (4, 0), (5, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs, odd_docs.drop("lang", "source").withColumn("source", odd_docs.text.substr(1, 1)).drop("lang")):
        for name, stage in P.STAGES[:-1]:
            out = P.materialize(stage(spark, docs, str(tmp_path)), "odd")
            assert out.columns == docs.columns, name
            docs = out
        out = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert len(out) == docs.count()
        assert not docs.columns or {r.doc_id for r in docs.collect()} == {r.doc_id for r in out}
