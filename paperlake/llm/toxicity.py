"""Operator 5, toxicity by non-negative positive-unlabelled learning.

``fit`` trains a linear numpy classifier from confirmed toxic texts (P) and
unlabelled texts (U) with the class-prior-corrected risk
``prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])``. When the
second part turns negative, its gradient is followed backwards. The prior is
the share of toxic rows among the labelled training rows. Only rows outside the
held-out fold (CRC-32 of the id as text, mod 3, equal to 1) give labels or texts
to training.

The fit takes at most ``max_positive`` and ``max_unlabelled`` different rows (id
and text), chosen by a hash, and of a text with more than ``max_words`` distinct
words those with the smallest hashes. These bounds keep the sample, its keys
(joined as a broadcast of at most 160 kB) and the driver's matrix small, however
often an id is repeated. The trained weights have ``1 << HASH_BITS`` entries at
most. Scoring reads every whole text in one narrow step.

Defined results: null and empty texts are scored from the bias alone; rows with
a null id are in no fold (``held_out`` false) and never train; repeated labels
of a row count once, toxic if any says so; labels that are null don't count;
without any confirmed example every score is 0; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import free_name, slices

HASH_BITS = 18
MAX_POSITIVE = 2_000
MAX_UNLABELLED = 8_000
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
EPOCHS = 120
#: Standard errors by which a feature's rate in P must differ from that in U.
MIN_Z = 5.0
#: Distinct words of one text that the fit takes at most.
MAX_WORDS = 2_048
#: Words that a worker remembers.
MEMO = 50_000
_MARKS = str.maketrans(dict.fromkeys(".,;:!?|\"'()[]{}", " "))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def words(text: str) -> set[str]:
    return set(text.lower().translate(_MARKS).split())


def features(word: str) -> list[int]:
    """Hashed slots of a word and of its beginnings."""
    parts = [word, *(f"{k}^{word[:k]}" for k in PREFIXES if len(word) > k)]
    return [zlib.crc32(p.encode()) & ((1 << HASH_BITS) - 1) for p in parts]


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def value(self, word: str) -> float:
        return float(self.weights[features(word)].sum())


def fit_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 2e-4) -> Classifier:
    """Adam on the non-negative risk; rows are arrays of feature slots."""
    size = 1 << HASH_BITS
    if not positive or not unlabelled:
        return Classifier(np.zeros(size), -30.0)
    rows = positive + unlabelled
    slots = np.concatenate(rows)
    counts = np.bincount(slots, minlength=size)
    p = len(positive)
    among = np.bincount(np.concatenate(positive), minlength=size)
    gap = among / p - (counts - among) / len(unlabelled)
    spread = counts / len(rows) * (1 / p + 1 / len(unlabelled))
    # slots whose rate in P is not beyond chance from that in U would only be learned by heart
    told = (counts >= 4) & (np.abs(gap) >= MIN_Z * np.sqrt(np.maximum(spread, 1e-12)))
    keep = told[slots]
    used, cols = np.unique(slots[keep], return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])[keep]
    n = len(rows)
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, epochs + 1):
        z = np.bincount(row, weights=w[cols], minlength=n) + b
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z)
        rest = loss_neg[p:].mean() - prior * loss_neg[:p].mean()
        g = np.zeros(n)
        if rest >= 0:
            g[:p] = prior * (s[:p] - 1) / p - prior * s[:p] / p
            g[p:] = s[p:] / (n - p)
        else:
            g[:p] = prior * s[:p] / p
            g[p:] = -s[p:] / (n - p)
        grad = np.append(np.bincount(cols, weights=g[row], minlength=len(used)) + decay * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= float(step[-1])
    weights = np.zeros(size)
    weights[used] = w
    return Classifier(weights, b)


def _feature_rows(max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text in b.column(1).to_pylist():
                w = words(text)
                if len(w) > max_words:
                    w = sorted(w, key=lambda x: (zlib.crc32(x.encode()), x))[:max_words]
                out.append(np.array([f for x in sorted(w) for f in features(x)], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["positive", "slots"])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    max_words: int = MAX_WORDS,
) -> Classifier:
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .where("id is not null and y is not null")
        .where(~held_out("id"))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic:
        return fit_pu([], [], 0.5)
    row = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("id", "text"))
    free = row.where("id is not null").where(~held_out("id")).select("id", "h").distinct()
    # rows and ids are told apart by hash only, so equal rows count once; a draw is the rows with the smallest hashes
    draw = lambda rows, n, y: rows.select("h").orderBy("h").limit(n).withColumn("positive", F.lit(y))
    chosen = draw(free.join(known.where("y = 1"), "id", "left_semi"), max_positive, True).unionByName(draw(free, max_unlabelled, False))
    # at most max_positive + max_unlabelled hashes are broadcast
    sample = row.join(F.broadcast(chosen), "h").groupBy("positive", "h").agg(F.first("text").alias("text"))
    got = sample.select("positive", "text").mapInArrow(_feature_rows(max_words), "positive boolean, slots binary").toArrow().to_pydict()
    rows = sorted(zip(got["positive"], got["slots"], strict=True))  # in one order, so that one sample gives one model
    pos, unl = ([np.frombuffer(x, np.int32) for y, x in rows if y == kind] for kind in (True, False))
    return fit_pu(pos, unl, min(max(toxic / total, 1e-4), 0.9))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """``id_col``, the ``keep`` columns and ``out`` (the score) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [id_col, *keep]
    src = docs.select(*[F.col(c) for c in names], F.coalesce(F.col(text_col), F.lit("")).alias(free_name(names, "__text")))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        for b in slices(batches):
            z = []
            for text in b.column(b.num_columns - 1).to_pylist():
                if len(memo) > MEMO:
                    memo.clear()
                w = words(text)
                for x in w:
                    if x not in memo:
                        memo[x] = m.value(x)
                z.append(sum(map(memo.__getitem__, sorted(w))))  # in order: equal texts, equal sums
            s = 1 / (1 + np.exp(-np.clip(np.array(z, dtype=float) + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row."""
    return score(docs, fit(docs, labels, id_col, text_col), id_col, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with their columns."""
    rest = tuple(c for c in docs.columns if c != id_col)
    name = free_name(docs.columns, "__score")
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col, rest, out=name)
    return scored.where(F.col(name) < threshold).select(*docs.columns)
