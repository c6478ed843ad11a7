"""Operator 13, exact top-k search by a vector-approximation file.

Components are integers (``floor(256 x)``), nearness is the inner product. Each
block of vectors is stored as its approximation: 256 cells a dimension, cut at
the block's own quantiles, with the least and largest value of each cell, and
a byte a component. The bounds of a cell and the sign of the query's
component bound each product, so a block of codes and a block of queries give
an upper and a lower bound of every score without any exact vector.

First the codes are scanned: of each block those vectors stay whose upper bound
reaches the block's k-th lower bound, then those that reach the k-th lower bound of
all blocks. Exact vectors are read in the order of their bounds: the first
``FIRST`` of a query, then, since the k-th of these is a score that is surely
reached, only those whose upper bound reaches it. What isn't read can't be among the k.

Equal vectors have equal scores, so one of them stands for all in the scan and
carries their smallest ids; a large group of copies is one candidate.

Spark's part: only ids and codes are dealt to the blocks of queries (an
equi-join on block and salt, neither side is broadcast); exact vectors are joined
to the few candidates by id. No vector pair becomes a row unless it survives the scan.

Defined results: vectors that are null or hold null or non-finite components,
and rows without id, take no part; vectors meet queries of their own length;
of several vectors with one id the smallest counts; repeated rows are candidates
each, but not those with the query's own id; ties go to the smaller id; components and scores outside of the range of long are its ends; other columns are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import materialize

CELLS = 256
BLOCK = 16_384
QUERIES = 1_024
#: Exact vectors that are read for a query at first.
FIRST = 16
LONG = np.iinfo(np.int64)


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows by dimensions), and the least and largest value of each cell (dimensions by cells)."""
    n, d = x.shape
    edges = np.sort(x, axis=0)[np.arange(1, CELLS) * n // CELLS]
    codes = np.zeros((n, d), np.uint8)
    low, high = np.zeros((d, CELLS)), np.zeros((d, CELLS))
    for j in range(d):
        codes[:, j] = np.searchsorted(edges[:, j], x[:, j], side="right")
        order = np.argsort(codes[:, j], kind="stable")
        used, first = np.unique(codes[order, j], return_index=True)
        values = x[order, j]
        low[j, used] = np.minimum.reduceat(values, first)
        high[j, used] = np.maximum.reduceat(values, first)
    return codes, low, high


def scan(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: its number, places of the vectors that may be among the ``k`` best of the block, lower and upper bounds."""
    d = codes.shape[1]
    cells = np.arange(d)[None, :], codes
    least, most = low[cells], high[cells]
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    peak = np.abs(queries).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * max(d, 1)
    size = np.maximum(np.abs(least), np.abs(most)) if peak >= 2.0**52 else None
    for a in range(0, len(queries), 64):
        p, m = plus[a : a + 64], minus[a : a + 64]
        upper, lower = p @ most.T + m @ least.T, p @ least.T + m @ most.T
        if size is not None:  # sums aren't exact any more
            slack = (p - m) @ size.T * 2.0**-40
            upper, lower = upper + slack, lower - slack
        for i in range(len(p)):
            u, lo = upper[i], lower[i]
            at = np.arange(len(u)) if len(u) <= k else np.flatnonzero(u >= np.partition(lo, len(lo) - k)[len(lo) - k])
            yield a + i, at, lo[at], u[at]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of equal length; those that no long holds are the ends of its range."""
    if float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1) < 2.0**62:
        return (a * b).sum(1)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(p, q, strict=True)), LONG.min), LONG.max) for p, q in zip(a, b, strict=True)], np.int64)


def _products(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), np.int64)
    sizes = a.map(len).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size:
            out[at] = products(np.stack(a.iloc[at].to_numpy()), np.stack(b.iloc[at].to_numpy()))
    return pd.Series(out)


def integer_vectors(vectors: DataFrame, query_filter: str, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, v`` (array of long), ``asks``; only rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"), F.coalesce(F.expr(query_filter), F.lit(False)).alias("asks"))


def one_per_id(rows: DataFrame) -> DataFrame:
    """``id, v, c, asks``: the smallest vector of each id and how many rows hold it."""
    once = rows.groupBy("id", "v").agg(F.count("*").alias("c"), F.max("asks").alias("asks"))
    return once.groupBy("id").agg(F.min(F.struct("v", "c")).alias("x"), F.max("asks").alias("asks")).select("id", "x.v", "x.c", "asks")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``key, v, ids``: equal vectors under one key, with their ``k`` + 1 smallest ids and how often each occurs (``k`` times at most); write it before keys are used."""
    order = Window.partitionBy("v").orderBy("id")
    few = rows.select("v", "id", F.least("c", F.lit(k)).cast("int").alias("c")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)  # limited before the shuffle too
    out = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "c"))).alias("ids"))
    return out.select(F.monotonically_increasing_id().alias("key"), "v", "ids")


def candidates(base: DataFrame, queries: DataFrame, k: int, n_base: int, n_queries: int) -> DataFrame:
    """``query_id, key, lower, upper``: what the scan of the approximations leaves of each block."""
    spark = base.sparkSession
    n_blocks, n_asks = max(1, -(-n_base // BLOCK)), max(1, -(-n_queries // QUERIES))
    salts = min(n_blocks, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.v.to_numpy()).astype(np.float64)
        codes, low, high = build(x)
        return pd.DataFrame({"d": [x.shape[1]], "b": [int(pdf.b.iloc[0])], "keys": [pdf.key.to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "low": [low.tobytes()], "high": [high.tobytes()]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.v.to_numpy()).astype(np.float64)
        return pd.DataFrame({"d": [x.shape[1]], "qb": [int(pdf.qb.iloc[0])], "qids": [pdf.id.to_numpy(np.int64).tobytes()], "qs": [x.tobytes()]})

    blocks = base.select(F.size("v").alias("d"), F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("b"), "key", "v").groupBy("d", "b").applyInPandas(encode, "d int, b long, keys binary, codes binary, low binary, high binary")
    asks = queries.select(F.size("v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(n_asks)).alias("qb"), "id", "v").groupBy("d", "qb").applyInPandas(gather, "d int, qb long, qids binary, qs binary")
    asks = asks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asks - 1).cast("long")))).withColumn("salt", F.pmod("b", F.lit(salts)).cast("int"))
    pairs = dealt.join(asks, ["d", "qb", "salt"]).select("d", "keys", "codes", "low", "high", "qids", "qs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                keys, qids = np.frombuffer(r.keys, np.int64), np.frombuffer(r.qids, np.int64)
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(keys), r.d)
                low, high = (np.frombuffer(x, np.float64).reshape(r.d, CELLS) for x in (r.low, r.high))
                found = list(scan(np.frombuffer(r.qs, np.float64).reshape(len(qids), r.d), codes, low, high, k))
                at = [x[1] for x in found]
                yield pd.DataFrame({"query_id": np.repeat(qids[[x[0] for x in found]], [len(x) for x in at]), "key": keys[np.concatenate(at)], "lower": np.concatenate([x[2] for x in found]), "upper": np.concatenate([x[3] for x in found])})

    return pairs.mapInPandas(run, "query_id long, key long, lower double, upper double")


def exact_top_k(vectors: DataFrame, query_filter: str = "vec_id % 50 = 0", id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, first: int = FIRST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of each query with all other rows."""
    rows = materialize(one_per_id(integer_vectors(vectors, query_filter, id_col, vector_col, scale)), "va-rows")
    base = materialize(distinct_vectors(rows, k), "va-vectors")
    queries = rows.where("asks").select("id", "v")
    keep = k + 1  # one of them may be the query alone
    found = materialize(candidates(base, queries, keep, base.count(), queries.count()), "va-candidates")

    def reached(scored: DataFrame, value: str) -> DataFrame:
        """``query_id, floor``: the ``keep``-th largest ``value`` of each query that has so many."""
        order = Window.partitionBy("query_id").orderBy(F.desc(value), "key")
        return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).groupBy("query_id").agg(F.when(F.count("*") == keep, F.min(value)).alias("floor"))

    def read(some: DataFrame) -> DataFrame:
        """Exact scores of candidates."""
        exact = F.pandas_udf(_products, "long")
        asked = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        return some.select("query_id", "key").join(base.select("key", F.col("ids")[0]["id"].alias("least"), "v"), "key").join(asked, "query_id").select("query_id", "key", "least", exact("q", "v").alias("score"))

    beats = F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "key")
    live = found.join(reached(found, "lower"), "query_id").where(beats).select("query_id", "key", "upper", F.row_number().over(by_bound).alias("r"))
    live = materialize(live, "va-live")
    first = max(first, keep)
    sure = materialize(read(live.where(F.col("r") <= first)), "va-first")
    rest = live.where(F.col("r") > first).join(reached(sure, "score"), "query_id").where(beats)
    scored = sure.unionByName(read(rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "least")
    best = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).drop("r")
    each = best.join(base.select("key", "ids"), "key").select("query_id", "score", F.explode("ids").alias("i"))
    each = each.where("i.id <> query_id").select("query_id", "score", F.col("i.id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.col("i.c"))).alias("copy"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB's SQL, by comparing each query with all rows.
SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
    select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
), r as (
    select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int rank, vec_id, score from s
)
select * from r where rank <= 5
"""
