"""Operator 11, spelling variant grouping by Bloom-guided neighbourhoods.

The vocabulary is kept in split-block Bloom filters (256 bits, one bit in each
of eight lanes), one filter for each word length. Every word generates its
neighbourhood: each character deleted, and each character replaced by a larger
one of the alphabet. (An insertion is a deletion seen from the longer word, and
a replacement by a smaller character is one by a larger seen from the other
word, so no pair is lost.) Neighbours aren't written out: hashes are polynomials,
so the hash of an edit follows from that of its word. Only those that the filter
of their length claims to hold become strings and are shuffled to an exact join with the
vocabulary, which drops the false ones.

Filters are built by bitwise aggregates on the cluster. Those that are broadcast
together hold at most ``ROUND_BLOCKS`` blocks (64 MB); a larger vocabulary is
probed in several rounds, each with the next range of blocks.

A word's form is its most frequent near word, if that is ``ratio`` times as
frequent or more; its root is the end of the chain of forms, found by doubling
steps. Frequencies grow tenfold with each step, so a chain has at most 18.

Defined results: null and empty texts have no words; a null id counts as an
empty one; repeated rows count each; words of any length are handled (those of
``LAST`` characters or more share a filter); other columns aren't read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import materialize

#: Characters of words, upper and lower case, and those that a word may hold (A-Z become lower case).
LETTERS = "A-Za-zÀ-ÿ"
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Bits of filter a word; blocks of 32 bytes that are broadcast at a time; blocks in one row on the way to the driver.
BITS, ROUND_BLOCKS, PACK = 16, 1 << 21, 4_096
#: Words of this length or more share a filter.
LAST = 64
#: Hashes that a worker computes at a time; words whose neighbours one task probes, about.
PROBES, TASK_WORDS = 1 << 20, 1 << 15

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LANES = np.array([pow(0x85EBCA6B, i, 1 << 32) for i in range(1, 9)], np.uint32)  # eight odd multipliers


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """``id, run``: every maximal run of letters of at least ``least`` characters, with A-Z as a-z."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate(F.col(text_col), upper, lower), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def with_slips(run: Column, doc_id: Column, every: int = 31) -> Column:
    """A run in which one character was left out where the hash of id and run says so."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(words: DataFrame, word_col: str = "word", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words that are long and frequent enough."""
    long = words.where(F.length(word_col) >= least_length)
    return long.groupBy(F.col(word_col).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of mixed hashes: the block among ``blocks``, and the lower half that chooses the lanes' bits."""
    h = mix(h)
    with np.errstate(over="ignore"):
        return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), h.astype(np.uint32)


def lane_bits(low: np.ndarray, lane: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.uint32(1) << ((low * LANES[lane]) >> np.uint32(27))


def codes_by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and their code points as a matrix, for each length; very long words come in small groups."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, PROBES // int(size))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            text = "".join(words[i] for i in part)
            yield part, np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(part), size).astype(np.uint64)


class Filters:
    """Block counts and first blocks of all lengths, and the blocks from ``first`` on that are here."""

    def __init__(self, counts: dict[int, int], bits: int = BITS):
        self.blocks = {s: max(1, -(-n * bits // 256)) for s, n in counts.items()}
        self.begin, at = {}, 0
        for s in sorted(self.blocks):
            self.begin[s], at = at, at + self.blocks[s]
        self.total, self.first, self.data = at, 0, np.zeros((0, 8), np.uint32)

    def covers(self, size: int) -> bool:
        s = min(size, LAST)
        return s in self.blocks and self.begin[s] < self.first + len(self.data) and self.begin[s] + self.blocks[s] > self.first

    def holds(self, h: np.ndarray, size: int) -> np.ndarray:
        """Places in ``h`` of hashes that the filter of their length claims to hold, if their blocks are here."""
        s = min(size, LAST)
        block, low = places(h, self.blocks[s])
        block = block.astype(np.int64) + (self.begin[s] - self.first)
        at = np.arange(len(h))
        if self.first > self.begin[s] or self.first + len(self.data) < self.begin[s] + self.blocks[s]:
            at = np.flatnonzero((block >= 0) & (block < len(self.data)))
        for lane in range(8):
            bit = lane_bits(low[at], lane)
            at = at[self.data[block[at], lane] & bit != 0]
        return at


def neighbours(words: list[str], filters: Filters) -> tuple[list[int], list[str]]:
    """Of every deletion, and every replacement by a larger character, those that the filters claim to hold: numbers of words, and neighbours."""
    who: list[int] = []
    near: list[str] = []
    for part, code in codes_by_length(words):
        w, size = code.shape
        shorter, same = filters.covers(size - 1), filters.covers(size)
        if not (shorter or same):
            continue
        power = powers(size)
        with np.errstate(over="ignore"):
            terms = code * power
            whole = terms.sum(1)
            if shorter:
                before = np.cumsum(terms, 1) - terms
                cut = before + (whole[:, None] - before - terms) * INVERSE
                first = np.ones_like(code, bool)  # of equal characters in a row only the first is deleted
                first[:, 1:] = code[:, 1:] != code[:, :-1]
                row, col = np.nonzero(first)
                for k in filters.holds(cut[row, col], size - 1):
                    word, i = words[part[row[k]]], int(col[k])
                    who.append(int(part[row[k]]))
                    near.append(word[:i] + word[i + 1 :])
            if not same:
                continue
            step = max(1, PROBES // (w * len(ALPHABET)))
            for a in range(0, size, step):
                here = code[:, a : a + step]
                larger = ALPHABET[None, None, :] > here[:, :, None]
                row, col, c = np.nonzero(larger)
                h = whole[row] + (ALPHABET[c] - here[row, col]) * power[a + col]
                for k in filters.holds(h, size):
                    word, i = words[part[row[k]]], a + int(col[k])
                    who.append(int(part[row[k]]))
                    near.append(word[:i] + chr(int(ALPHABET[c[k]])) + word[i + 1 :])
    return who, near


def filter_blocks(vocab: DataFrame, filters: Filters) -> DataFrame:
    """``block, w0 .. w7``: the words of all filters, blocks numbered through all lengths."""
    lanes = [f"w{i}" for i in range(8)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, code in codes_by_length(b.word.tolist()):
                size = min(code.shape[1], LAST)
                with np.errstate(over="ignore"):
                    block, low = places((code * powers(code.shape[1])).sum(1), filters.blocks[size])
                bits = {x: lane_bits(low, i).view(np.int32) for i, x in enumerate(lanes)}
                yield pd.DataFrame({"block": block.astype(np.int64) + filters.begin[size], **bits})

    made = vocab.select("word").mapInPandas(run, "block long, " + ", ".join(f"{x} int" for x in lanes))
    return made.groupBy("block").agg(*[F.bit_or(x).alias(x) for x in lanes])


def load_filters(blocks: DataFrame, filters: Filters, first: int, count: int) -> Filters:
    """The filters with the blocks from ``first`` on, ``count`` of them or fewer, collected as packed rows."""
    lanes = [f"w{i}" for i in range(8)]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros((PACK, 8), np.int32)
        data[pdf.block.to_numpy() % PACK] = pdf[lanes].to_numpy(np.int32)
        return pd.DataFrame({"pack": [int(pdf.block.iloc[0]) // PACK], "data": [data.tobytes()]})

    here = blocks.where(F.col("block").between(first, first + count - 1)).withColumn("pack", F.expr(f"block div {PACK}"))
    out = np.zeros((-(-count // PACK) * PACK, 8), np.uint32)
    for r in here.groupBy("pack").applyInPandas(pack, "pack long, data binary").toLocalIterator():
        at = r["pack"] * PACK - first
        out[at : at + PACK] = np.frombuffer(r["data"], np.uint32).reshape(-1, 8)
    loaded = Filters({})
    loaded.blocks, loaded.begin, loaded.total, loaded.first, loaded.data = filters.blocks, filters.begin, filters.total, first, out[:count]
    return loaded


def near_pairs(vocab: DataFrame, bits: int = BITS, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """``word, n, near, near_n``: every pair of near words, once, from the side that generates the other. ``vocab`` is read several times: pass a written table."""
    spark = vocab.sparkSession
    shard = F.least(F.length("word"), F.lit(LAST)).alias("shard")
    counts = {r["shard"]: r["count"] for r in vocab.groupBy(shard).count().collect()}
    filters = Filters(counts, bits)
    dealt = vocab.select("word", "n").repartition(max(1, -(-sum(counts.values()) // TASK_WORDS)))  # a small table, but much work
    blocks = materialize(filter_blocks(vocab, filters), "bloom-blocks")
    round_blocks = max(1, round_blocks // PACK) * PACK
    claimed = None
    for first in range(0, max(filters.total, 1), round_blocks):
        shared = spark.sparkContext.broadcast(load_filters(blocks, filters, first, min(round_blocks, filters.total - first)))

        def probe(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                who, near = neighbours(b.word.tolist(), shared.value)
                yield pd.DataFrame({"word": b.word.to_numpy()[who], "n": b.n.to_numpy()[who], "near": near})

        found = dealt.mapInPandas(probe, "word string, n long, near string")
        if filters.total > round_blocks:  # one broadcast at a time
            found = materialize(found, "bloom-positives")
            shared.unpersist()
        claimed = found if claimed is None else claimed.unionByName(found)
    return claimed.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain from ``word`` over ``form``, for every word with a form; each round doubles the step."""
    steps = materialize(forms.select("word", F.col("form").alias("to")), "form-steps")
    while True:
        further = steps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        steps = materialize(steps.join(further, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "form-steps")
        if steps.where("moved").isEmpty():
            return steps.select("word", F.col("to").alias("root"))


def spelling_groups(vocab: DataFrame, ratio: int = RATIO, bits: int = BITS, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """``word, n, form, root, n_near, form_n`` for every word of ``vocab`` (``word, n``, distinct words)."""
    vocab = materialize(vocab.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    pair = near_pairs(vocab, bits, round_blocks)
    ends = F.array(F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("m")), F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("m")))
    sides = pair.select(F.inline(ends))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    known = vocab.join(best, "word", "left").withColumn("takes", -F.col("best.m") >= ratio * F.col("n"))
    known = materialize(
        known.select("word", "n", F.when(F.col("takes"), F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), -F.col("best.m")).alias("form_n")),
        "spelling-forms",
    )
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, every: int = 31) -> DataFrame:
    """``word``: the runs of the documents, some with a slip. A slip only shortens, so shorter runs can be left out."""
    found = runs(docs, id_col, text_col, least)
    return found.select(with_slips(F.col("run"), F.col("id"), every).alias("word"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return spelling_groups(vocabulary(document_words(docs, id_col, text_col)))


#: The same rows in DuckDB's SQL: checksums by a table, near words by what they are without one character.
SQL = r"""
with recursive bits(i, k, v) as (
    select i, 0, i::bigint from range(256) t(i)
    union all
    select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8
), crc as (
    select list(v order by i) c from bits where k = 8
), found as (
    select coalesce(doc_id::varchar, '') id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) run
    from documents
), counted as (
    select id, run, count(*) n, hex(encode(id || ':' || run)) x from found group by all
), hashed as (
    select run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::bigint, 2))::bigint), lambda s, b: xor(s >> 8, c[(xor(s, b) & 255) + 1]), 4294967295), 4294967295) h
    from counted, crc
), words as (
    select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end word, n from hashed
), vocab as (
    select word, sum(n)::bigint n from words where length(word) >= 7 group by word having sum(n) >= 2
), cuts as (
    select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) cut from (select word, n, unnest(range(1, length(word) + 1)) i from vocab)
), near as (
    select a.word, a.n, b.word other, b.n m from cuts a join cuts b on a.i = b.i and a.cut = b.cut and a.word <> b.word
    union select a.word, a.n, b.word, b.n from cuts a join vocab b on a.cut = b.word
    union select b.word, b.n, a.word, a.n from cuts a join vocab b on a.cut = b.word
), best as (
    select word, count(*) n_near, first(other order by m desc, other) other, max(m) m from near group by word
), forms as (
    select v.word, v.n, case when m >= 10 * v.n then other end form, coalesce(n_near, 0) n_near, case when m >= 10 * v.n then m end form_n
    from vocab v left join best b on v.word = b.word
), walk(word, stop, depth) as (
    select word, word, 0 from forms
    union all
    select w.word, f.form, depth + 1 from walk w join forms f on w.stop = f.word where f.form is not null
)
select f.word, f.n, f.form, w.root, f.n_near, f.form_n from forms f join (select word, max_by(stop, depth) root from walk group by word) w on f.word = w.word
"""
