"""Operator 2, n-gram Jaccard join with Bayesian candidate pruning.

Every document is the set of its five-word shingles. Documents with the same
set are one class, represented by its smallest key. Representatives with
similarity of at least 0.8 are linked:

1. MinHash signatures (128 values) are cut into 32 bands of 4. Two sets of
   similarity 0.8 share no band with probability 5e-8.
2. Bands that representatives share connect them to clusters (components of
   star edges, linear in the number of postings). A cluster is split by set
   size into layers in the ratio 0.8 (sets of which one is smaller than 0.8 of
   the other can't be similar, so only neighbouring layers meet) and each layer
   into blocks of about ``BLOCK`` documents by hash.
3. Pairs of blocks are the unit of work. In a task the values of two signatures
   are compared 16 at a time; after each step the posterior probability that
   the similarity reaches the threshold (uniform prior) is read from a table,
   and pairs below ``TOLERANCE`` are dropped.
4. The rest are verified exactly, as sizes of intersections of the shingle
   sets, by products of 0/1 matrices.

Pairs never become rows: a task returns, for each document, its links and the
edges of a spanning forest. A large group of copies with different texts is
therefore spread over many tasks of bounded size and compared in full.

Words are runs of characters other than ASCII white space, compared as they
are. A text of one to four words has one shingle, all its words. Defined
results: null and empty texts (no word) are classes of their own without links;
rows with equal id and text are one document, and each gets its result; rows
with null ids take part; extra columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import join_values, materialize, row_key, slices
from paperlake.llm.components import components

WORDS = 5
THRESHOLD = 0.8
HASHES, BANDS = 128, 32
STEP = 16
TOLERANCE = 1e-7
BLOCK = 256
#: Shingle columns of one 0/1 matrix.
COLUMNS = 8_192
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up = np.cumprod(np.full(n, _BASE, np.uint64))
    down = np.cumprod(np.full(n, inverse, np.uint64))
    return up, down


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(10, len(data).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(words, len(word))
    out = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * _BASE + word[i : len(word) - k + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for i, m in enumerate(_multipliers()):
        h = flat * m
        h = ((h ^ (h >> np.uint64(29))) * m) >> np.uint64(32)
        out[:, i] = np.minimum.reduceat(h.astype(np.uint32), at)
    return out


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After each step, the least number of equal values with which a pair stays.

    Under a uniform prior the similarity given m of n equal values is
    Beta(m + 1, n - m + 1), and P(similarity >= t) is the probability that a
    binomial of n + 1 trials at t has at most m successes.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while m <= n:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs of two lists of signatures pass every step."""
    alive = np.ones((len(a), len(b)), bool)
    equal = np.zeros((len(a), len(b)), np.int16)
    for step, least in enumerate(least_matches(threshold, tolerance)):
        part = range(step * STEP, (step + 1) * STEP)
        if alive.sum() * 8 > alive.size:
            for i in part:
                equal += a[:, i, None] == b[None, :, i]
        else:  # few pairs are left
            r, c = np.nonzero(alive)
            equal[r, c] += (a[r, part.start : part.stop] == b[c, part.start : part.stop]).sum(1).astype(np.int16)
        alive &= equal >= least
        if not alive.any():
            break
    return alive


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, in slices of the shingles that both lists hold."""
    left, right = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), np.float32)
    row_l, row_r = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])

    def places(flat: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        ok = common[at] == flat
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    if not len(common):
        return out
    (at_l, row_l), (at_r, row_r) = places(left, row_l), places(right, row_r)
    for lo in range(0, len(common), COLUMNS):
        hi = min(lo + COLUMNS, len(common))
        x, y = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
        for m, at, rows in ((x, at_l, row_l), (y, at_r, row_r)):
            s = slice(*np.searchsorted(at, [lo, hi]))
            m[rows[s], at[s] - lo] = 1
        out += x @ y.T
    return out


def links(sig_a, sig_b, sets_a, sets_b, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """The 0/1 matrix of pairs that reach the threshold: pruned by signatures, verified by sets."""
    alive = surviving(sig_a, sig_b, threshold, tolerance)
    rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    out = np.zeros(alive.shape, bool)
    if len(rows):
        size_a, size_b = (np.array([len(s[i]) for i in idx], np.float64) for s, idx in ((sets_a, rows), (sets_b, cols)))
        both = intersections([sets_a[i] for i in rows], [sets_b[i] for i in cols]).astype(np.float64)
        exact = both >= threshold * (size_a[:, None] + size_b[None, :] - both) - 1e-9
        out[np.ix_(rows, cols)] = exact & alive[np.ix_(rows, cols)]
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, n, set_hash, bands`` of every document with a word."""
    src = docs.select(row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            if not some:
                continue
            sets = [sets[i] for i in some]
            sig = signatures(sets).astype(np.uint64).reshape(len(sets), BANDS, -1)
            band = np.arange(BANDS, dtype=np.uint64)[None, :] * _BASE
            for r in range(sig.shape[2]):
                band = mix(band + sig[:, :, r])
            whole_set = [int(mix(np.array([s.sum(), len(s)], np.uint64).cumsum())[1].astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(some)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(whole_set, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(range(0, (len(sets) + 1) * BANDS, BANDS), pa.int32()), pa.array(band.astype(np.int64).ravel())),
                ],
                names=["key", "n", "set_hash", "bands"],
            )

    return src.mapInArrow(run, "key long, n int, set_hash long, bands array<long>")


def _compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks (or a block with itself): links of each document and a spanning forest."""
    side = pdf.side.to_numpy()
    sets = [shingles(t) for t in pdf.text]
    sig = signatures(sets)
    ids, weight = pdf.key.to_numpy(), pdf.copies.to_numpy()
    same = not (side == 1).any()
    a = np.flatnonzero(side == 0)
    b = a if same else np.flatnonzero(side == 1)
    empty = pd.DataFrame({"key": np.zeros(0, np.int64), "texts": np.zeros(0, np.int64), "docs": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
    if not len(a) or not len(b):
        return empty
    m = links(sig[a], sig[b], [sets[i] for i in a], [sets[i] for i in b])
    if same:
        np.fill_diagonal(m, False)
    parent = {int(i): int(i) for i in np.concatenate([a, b])}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x in np.flatnonzero(m.any(1)):  # each row joins its whole neighbourhood, so a few unions a document suffice
        for y in np.flatnonzero(m[x]):
            p, q = root(int(a[x])), root(int(b[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
    texts, docs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    np.add.at(texts, a, m.sum(1))
    np.add.at(docs, a, m @ weight[b])
    if not same:
        np.add.at(texts, b, m.sum(0))
        np.add.at(docs, b, m.T @ weight[a])
    some = np.flatnonzero(texts)
    return pd.DataFrame({"key": ids[some], "texts": texts[some], "docs": docs[some], "to": [ids[root(int(i))] for i in some]})


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, class_key, group_key, n_links, n_text_links, copies`` of every document with a word.

    ``class_key``: the representative of the documents with the same shingles;
    ``group_key``: smallest representative of those connected by links;
    ``n_links``: other documents at 0.8 or more, copies included;
    ``n_text_links``: other classes at 0.8 or more.
    """
    seen = materialize(sketch(docs, id_col, text_col), "sketches")
    rows = seen.groupBy("key").agg(F.first("n").alias("n"), F.first("set_hash").alias("set_hash"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    rows = materialize(rows, "rows")
    same = rows.select("key", "n", "rows", F.struct("set_hash", "n").alias("same"))
    classes = same.groupBy("same").agg(F.min("key").alias("class_key"), F.sum("rows").alias("copies"), F.count("*").alias("c"))
    members = materialize(join_values(same, classes, "same", same.count()).select("key", "class_key", "n", "copies"), "members")
    reps = rows.join(members.where("key = class_key").select("key"), "key", "left_semi").select("key", F.explode("bands").alias("band"))
    postings = reps.repartition("band")
    star = postings.groupBy("band").agg(F.min("key").alias("low"), F.count("*").alias("c")).where("c > 1")
    edges = postings.join(star, "band").where("key <> low").select(F.col("key").alias("u"), F.col("low").alias("v"))
    clusters = materialize(components(edges), "clusters")

    layer = F.floor(F.log("n") / float(np.log(1 / THRESHOLD))).cast("int")
    placed = clusters.withColumnRenamed("id", "key").join(members.select("key", "n", "copies"), "key").withColumn("layer", layer)
    counts = placed.groupBy("component", "layer").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    near = counts.select("component", F.col("layer").alias("other"), F.col("blocks").alias("other_blocks"))
    placed = placed.join(counts, ["component", "layer"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = placed.join(near, "component").where(F.abs(F.col("other") - F.col("layer")) <= 1)
    met = met.withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    mine, theirs = F.struct(F.col("layer").alias("l"), F.col("block").alias("b")), F.struct(F.col("other").alias("l"), F.col("other_block").alias("b"))
    units = materialize(
        met.select("key", "copies", "component", F.least(mine, theirs).alias("lo"), F.greatest(mine, theirs).alias("hi"), (mine > theirs).cast("int").alias("side")),
        "units",
    )
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # both sides grow with the corpus: never a broadcast, at any size
    needed = texts.hint("merge").join(clusters.select(F.col("id").alias("key")), "key", "left_semi").dropDuplicates(["key"])
    work = units.join(needed, "key").select("component", "lo", "hi", "side", "key", "copies", "text")
    found = materialize(
        work.groupBy("component", "lo", "hi").applyInPandas(_compare, "key long, texts long, docs long, to long"), "links"
    )
    per = found.groupBy("key").agg(F.sum("texts").alias("n_text_links"), F.sum("docs").alias("linked"))
    groups = components(found.select(F.col("key").alias("u"), F.col("to").alias("v")))
    return (
        members.join(per.withColumnRenamed("key", "class_key"), "class_key", "left")
        .join(groups.select(F.col("id").alias("class_key"), F.col("component")), "class_key", "left")
        .select(
            "key",
            "class_key",
            F.coalesce("component", "class_key").alias("group_key"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
            "copies",
        )
    )


def with_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, and ids (smallest of the class, of the group) instead of keys."""
    ids = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"))
    found = materialize(ids.join(join(docs, id_col, text_col), "key", "left"), "joined")
    alone = found.where("class_key is null").select(
        "id", F.col("id").alias("class_id"), F.col("id").alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links")
    )
    some = found.where("class_key is not null")
    total = some.count()
    class_ids = some.groupBy("class_key").agg(F.min("id").alias("class_id"), F.count("*").alias("c"))
    group_ids = some.groupBy("group_key").agg(F.min("id").alias("group_id"), F.count("*").alias("c"))
    out = join_values(join_values(some, class_ids, "class_key", total), group_ids, "group_key", total).select("id", "class_id", "group_id", "n_links", "n_text_links")
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group (the one with the smallest key, of equal rows the first), and every row without words."""
    found = join(docs, id_col, text_col)
    low = found.groupBy("group_key").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("stays"))
    row = docs.select(F.struct(*docs.columns).alias("__row"), row_key(id_col, text_col).alias("key"))
    drop = materialize(found.select("key").join(low, "key", "left").where("stays is null").select("key"), "dropped")
    left = row.hint("merge").join(drop, "key", "left_anti")
    wordless = ~F.coalesce(F.col(f"__row.{text_col}"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    some = left.where(~wordless).groupBy("key").agg(F.first("__row").alias("__row"))
    return some.select("__row.*").unionByName(left.where(wordless).select("__row.*"))
