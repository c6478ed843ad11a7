"""Operator 6, approximate nearest neighbours by score-aware quantisation.

Vectors are extended by ``-|x|^2 / 2`` (queries by 1), so that the largest inner
product is the smallest Euclidean distance. A product quantiser with 16 centres
in each two-dimensional subspace (four bits a code) is trained on a bounded
sample with the anisotropic loss: the residual's part along the vector weighs
``eta`` times its orthogonal part, in the assignment (coordinate descent over
subspaces) and in the update (weighted least squares). Every vector is encoded.
A query block scans a code block through lookup tables of 16 entries, and the
``rerank`` best of the block are measured exactly, in double precision.

Spark's part: vectors are packed in blocks of at most about ``BLOCK`` rows by a
hash of the id, queries in blocks of ``QUERIES``; code blocks meet query blocks
through an equi-join on (query block, salt), so neither side is broadcast and
no vector pair becomes a row; each pair of blocks yields 10 exact neighbours a
query, merged by a window over (blocks x k) rows of one query at most.

Only training is sampled (``TRAIN`` vectors, by hash of the id, on the driver:
5 MB at 64 dimensions); every row is indexed. Recall against brute force is
measured in the tests. Lengths are measured in the sample's median norm; vectors
of more than ``FAR`` of it take no part in training, whose centres they would
take, and aren't judged by their codes: each is measured exactly, and a query
that is one is compared with all rows exactly. So one huge vector spoils nothing.

Defined results: vectors that are null, of zero length or norm, or hold null or
non-finite components take no part, nor do rows without id; rows of another
dimension than the most frequent one of the sample take no part; repeated rows
are candidates each (a query doesn't match rows with its own id); ties go to
the smaller id; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN = 20_000
BLOCK = 4_096
QUERIES = 1_024
SALTS = 16
CENTRES = 16
RERANK = 128
#: Median norms beyond which a vector is measured exactly.
FAR = 16.0


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms of rows; by way of the largest component where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((x**2).sum(1))
        odd = ~np.isfinite(out) | (out < 1e-140)
        if odd.any():
            top = np.abs(x[odd]).max(1, initial=0, keepdims=True)
            out[odd] = top[:, 0] * np.sqrt(((x[odd] / np.where(top > 0, top, 1)) ** 2).sum(1))
    return out


def extend(x: np.ndarray) -> np.ndarray:
    """Database vectors with the coordinate that turns distance to inner product, padded to an even width."""
    out = np.concatenate([x, -0.5 * (x**2).sum(1, keepdims=True)], axis=1)
    return np.pad(out, ((0, 0), (0, out.shape[1] % 2)))


@dataclass
class Quantiser:
    centres: np.ndarray  # subspaces, 16, 2
    eta: float
    unit: float = 1.0  # the norm that counts as one

    def assign(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes by coordinate descent on ``|r|^2 + (eta - 1) <r, x/|x|>^2``."""
        m = len(self.centres)
        parts = x.reshape(len(x), m, 2)
        unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(parts.shape)
        gaps = ((parts[:, :, None, :] - self.centres[None]) ** 2).sum(-1)  # n, m, 16
        along = np.einsum("nmd,mcd->nmc", unit, self.centres)
        own = (parts * unit).sum(-1)
        codes = gaps.argmin(2)
        at = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
        parallel = (own - at).sum(1)
        for _ in range(rounds):
            for j in range(m):
                others = parallel - (own[:, j] - at[:, j])
                cost = gaps[:, j] + (self.eta - 1) * (others[:, None] + own[:, j, None] - along[:, j]) ** 2
                codes[:, j] = cost.argmin(1)
                at[:, j] = np.take_along_axis(along[:, j], codes[:, j, None], 1)[:, 0]
                parallel = others + own[:, j] - at[:, j]
        return codes.astype(np.uint8)


def train(x: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 1) -> Quantiser:
    """Alternate assignment and anisotropic update on extended vectors."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    m = d // 2
    parts = x.reshape(n, m, 2)
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(parts.shape)
    own = (parts * unit).sum(-1)
    start = rng.choice(n, CENTRES, replace=n < CENTRES)
    q = Quantiser(parts[start].transpose(1, 0, 2) + rng.normal(0, 1e-6, (m, CENTRES, 2)), 1.0)
    for r in range(rounds):
        q.eta = 1.0 if r < rounds // 2 else eta  # plain centres first
        codes = q.assign(x, 1)
        along = np.take_along_axis(np.einsum("nmd,mcd->nmc", unit, q.centres), codes[:, :, None].astype(int), 2)[:, :, 0]
        parallel = (own - along).sum(1)
        for j in range(m):
            u, c = unit[:, j], codes[:, j]
            rest = parallel - own[:, j] + along[:, j] + own[:, j]  # what <c, u> should make up
            a = np.zeros((CENTRES, 2, 2))
            b = np.zeros((CENTRES, 2))
            np.add.at(a, c, np.eye(2) + (q.eta - 1) * u[:, :, None] * u[:, None, :])
            np.add.at(b, c, parts[:, j] + (q.eta - 1) * rest[:, None] * u)
            used = np.bincount(c, minlength=CENTRES) > 0
            q.centres[j][used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
            fresh = (u * q.centres[j][c]).sum(1)
            parallel += along[:, j] - fresh
            along[:, j] = fresh
    q.eta = eta
    return q


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def scan(q: Quantiser, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate inner products, queries by rows, from one table of 256 sums for every two subspaces. ``queries`` are in the model's unit."""
    m = len(q.centres)
    ext = np.concatenate([queries, np.ones((len(queries), 1))], axis=1)
    ext = np.pad(ext, ((0, 0), (0, ext.shape[1] % 2))).reshape(len(queries), m, 2)
    tables = np.einsum("qmd,mcd->mqc", ext, q.centres).astype(np.float32)
    out = np.zeros((len(queries), len(packed)), np.float32)
    for k in range(packed.shape[1]):
        low = tables[2 * k]
        high = tables[2 * k + 1] if 2 * k + 1 < m else np.zeros_like(low)
        both = (high[:, :, None] + low[:, None, :]).reshape(len(queries), 256)
        out += np.take(both, packed[:, k], axis=1)
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of one row; of equal ones the first, so that ties go to smaller ids."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])


def search_blocks(q: Quantiser, qid: np.ndarray, qv: np.ndarray, vid: np.ndarray, v: np.ndarray, packed: np.ndarray, k: int, rerank: int):
    """For each query its ``k`` nearest of the block, exactly measured: query ids, ids, distances."""
    ids, found, far = [], [], []
    beyond = np.flatnonzero(norms(v) > FAR * q.unit)
    lost = norms(qv) > FAR * q.unit
    for a in range(0, len(qid), 64):
        approx = scan(q, np.where(lost[a : a + 64, None], 0, qv[a : a + 64]) / q.unit, packed)
        for i, row in enumerate(approx):
            own = qid[a + i]
            if lost[a + i]:
                c = np.arange(len(vid))
            else:
                row = np.where(vid == own, -np.inf, row)
                row[beyond] = -np.inf
                c = np.union1d(best(row, min(rerank, len(row))), beyond)
            c = c[vid[c] != own]
            d = norms(v[c] - qv[a + i])
            o = np.lexsort((vid[c], d))[:k]
            ids.append(np.full(len(o), own))
            found.append(vid[c][o])
            far.append(d[o])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(ids, np.int64), cat(found, np.int64), cat(far, np.float64)


def nearest(
    vectors: DataFrame, query_filter: str = "vec_id % 100 = 0", id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, rerank: int = RERANK
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query among all other rows, by Euclidean distance."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    clean = good.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(F.expr(query_filter), F.lit(False)).alias("is_query"))
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(TRAIN).select("v").toPandas()
    empty = "query_id long, rank int, vec_id long, score double"
    if sample.empty:
        return spark.createDataFrame([], empty)
    dim = int(sample.v.map(len).mode()[0])
    distinct = np.unique(np.stack(sample.v[sample.v.map(len) == dim].values), axis=0)  # copies would take the centres
    size = norms(distinct)
    unit = float(np.median(size))
    model = train(extend(distinct[size <= FAR * unit] / unit))
    model.unit = unit
    shared = spark.sparkContext.broadcast(model)
    clean = clean.where(F.size("v") == dim)
    counts = clean.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    n_blocks, n_queries = max(1, -(-counts["n"] // BLOCK)), max(1, -(-counts["q"] // QUERIES))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.stack(pdf.v.values).astype(np.float64)
        near = np.where(norms(x)[:, None] > FAR * shared.value.unit, 0, x) / shared.value.unit
        codes = pack(shared.value.assign(extend(near)))
        return pd.DataFrame({"b": [int(pdf.b.iloc[0])], "ids": [pdf.id.to_numpy(np.int64).tobytes()], "vs": [x.tobytes()], "codes": [codes.tobytes()]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.v.values).astype(np.float64)
        return pd.DataFrame({"qb": [int(pdf.qb.iloc[0])], "qids": [pdf.id.to_numpy(np.int64).tobytes()], "qs": [x.tobytes()]})

    blocks = clean.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).select("b", "id", "v").groupBy("b").applyInPandas(encode, "b long, ids binary, vs binary, codes binary")
    queries = (
        clean.where("is_query").dropDuplicates(["id"]).withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_queries))).select("qb", "id", "v")
        .groupBy("qb").applyInPandas(gather, "qb long, qids binary, qs binary")
    )
    salted = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).withColumn("salt", F.pmod("b", F.lit(SALTS)).cast("int")).join(
        salted, ["qb", "salt"]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                vid = np.frombuffer(r.ids, np.int64)
                x = np.frombuffer(r.vs, np.float64).reshape(len(vid), -1)
                qid = np.frombuffer(r.qids, np.int64)
                qv = np.frombuffer(r.qs, np.float64).reshape(len(qid), -1)
                packed = np.frombuffer(r.codes, np.uint8).reshape(len(vid), -1)
                a, b, c = search_blocks(shared.value, qid, qv, vid, x, packed, k, rerank)
                yield pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    near = pairs.select("ids", "vs", "codes", "qids", "qs").mapInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
