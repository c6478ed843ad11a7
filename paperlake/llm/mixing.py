"""Operator 7, mixing sources to target weights by temperature.

Token shares ``p`` of the sources are raised to an exponent ``a`` and
normalised. The exponent is found by bisection (many points a round, each round
one aggregation over the table of sources): the largest one that reaches a
target entropy, or the smallest one that holds a repetition limit. The weights
are realised as block permutations: the documents of a source are dealt to
blocks by a hash; every epoch is a permutation of the blocks by another hash;
the last, broken epoch takes blocks in that order while the token budget lasts.

Without a budget the source that is repeated least is read exactly once, so no
document is left out; with one, sources may be read in part.

Scale: token counts are pre-aggregated per source and per (source, block). The
running sums that find where a budget ends go over 1024 slices of a source's
permutation first and then over the one slice that holds the end, so no task
gets a whole source. Each document then needs only its source's row (epochs and
cut), so texts aren't shuffled. That table is broadcast only if it was counted
to have at most ``BROADCAST_SOURCES`` rows.

Defined results: a null source is a source of its own; tokens are runs of
characters other than white space; null and empty texts have none; a source
without tokens is read once; rows with null or repeated ids are dealt like
others (equal rows share a block); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import materialize, row_key, text_or_empty

BLOCK_TOKENS = 4_096
SLICES = 1_024
POINTS = 32
ROUNDS = 8
MAX_REPETITION = 1.5
BROADCAST_SOURCES = 10_000
_TOP = 1 << 62
OUT = ("mix_epoch", "mix_block", "mix_place", "mix_tokens", "mix_weight", "mix_epochs")


def tokens(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(r"\S+")).cast("long")


@dataclass
class Temperature:
    exponent: float
    norm: float
    total: int
    budget: float


def entropy_and_spread(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: entropy of the weights, largest ratio of epochs between sources, and sum of powers."""
    parts = []
    for i, a in enumerate(exponents):
        q = F.pow("p", F.lit(a))
        parts += [F.sum(q).alias(f"n{i}"), F.sum(q * F.log("p") * a).alias(f"l{i}"), F.max(q / F.col("p")).alias(f"h{i}"), F.min(q / F.col("p")).alias(f"m{i}")]
    row = shares.agg(*parts).first()
    return [(math.log(row[f"n{i}"]) - row[f"l{i}"] / row[f"n{i}"], row[f"h{i}"] / row[f"m{i}"], row[f"n{i}"]) for i in range(len(exponents))]


def find_exponent(shares: DataFrame, target_entropy: float | None, max_repetition: float | None) -> tuple[float, float]:
    """The exponent in [0, 1] and the sum of powers there.

    Entropy falls and the ratio of epochs falls as the exponent grows. If both
    aims are given and disagree, the repetition limit wins.
    """
    def search(fits, largest: bool) -> float:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
            good = [fits(x) for x in entropy_and_spread(shares, grid)]
            k = max((i for i, g in enumerate(good) if g), default=0) if largest else min((i for i, g in enumerate(good) if g), default=POINTS - 1)
            low, high = (grid[k], grid[min(k + 1, POINTS - 1)]) if largest else (grid[max(k - 1, 0)], grid[k])
            if high - low < 1e-9:
                break
        return low if largest else high

    a = 1.0
    if target_entropy is not None:
        a = search(lambda x: x[0] >= target_entropy, largest=True)
    if max_repetition is not None:
        limit = search(lambda x: x[1] <= max_repetition * (1 + 1e-12), largest=False)
        a = max(a, limit) if target_entropy is not None else limit
    return a, entropy_and_spread(shares, [a])[0][2]


def permuted(source: str, epoch: str | Column, block: str, seed: int) -> Column:
    """Place of a block in an epoch's order, 0 to 2**62 - 1."""
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.pmod(F.xxhash64(F.lit(seed), F.col(source), e.cast("int"), F.col(block)), F.lit(_TOP))


def plan(
    docs: DataFrame, source_col: str, text_col: str, id_col: str, target_entropy: float | None, max_repetition: float | None, budget_tokens: float | None, seed: int
) -> tuple[DataFrame, bool]:
    """Per source: tokens, weight, epochs, whole epochs, blocks and cut; and whether it may be broadcast."""
    rows = docs.select(
        F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null")).alias("__s"), row_key(id_col, text_col).alias("k"), tokens(text_col).alias("t")
    )
    # one read of the texts: tokens by source and by the finest blocks, which later blocks are unions of
    fine = materialize(rows.groupBy("__s", F.pmod("k", F.lit(1 << 20)).alias("f")).agg(F.sum("t").alias("t")), "mix-blocks")
    sources = fine.groupBy("__s").agg(F.sum("t").alias("tokens"))
    totals = sources.agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.max("tokens").alias("most")).first()
    total = totals["total"] or 0
    if not total:
        return sources.select("__s", "tokens", *[F.lit(x).cast(t).alias(n) for n, x, t in (("weight", 0.0, "double"), ("epochs", 1.0, "double"), ("whole", 1, "int"), ("blocks", 1, "long"), ("cut", -1, "long"))]), True
    shares = sources.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(total))
    a, norm = find_exponent(shares, target_entropy, max_repetition)
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(a)) / F.lit(norm)
    if budget_tokens is None:  # the largest source is repeated least
        budget_tokens = total * norm / (totals["most"] / total) ** (a - 1)
    epochs = F.round(weight * F.lit(float(budget_tokens)) / F.col("tokens"), 9)
    per = sources.select(
        "__s",
        "tokens",
        F.when(F.col("tokens") > 0, weight).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, epochs).otherwise(1.0).alias("epochs"),
    ).withColumn("whole", F.floor("epochs").cast("int")).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long"))
    per = materialize(per.withColumn("rest", (F.col("epochs") - F.col("whole")) * F.col("tokens")), "mix-sources")
    small = totals["n"] <= BROADCAST_SOURCES
    side = F.broadcast(per) if small else per
    blocks = (
        fine.join(side.where("rest > 0").select("__s", "whole", "blocks", "rest"), "__s")
        .withColumn("b", block_of("f"))
        .groupBy("__s", "b", "whole", "rest")
        .agg(F.sum("t").alias("t"))
        .withColumn("place", permuted("__s", "whole", "b", seed))
        .withColumn("slice", F.floor(F.col("place") / (_TOP // SLICES)).cast("int"))
    )
    run = Window.partitionBy("__s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = blocks.groupBy("__s", "slice").agg(F.sum("t").alias("st")).withColumn("before", F.coalesce(F.sum("st").over(run), F.lit(0)))
    inner = Window.partitionBy("__s", "slice").orderBy("place", "b").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        blocks.join(slices, ["__s", "slice"])
        .where("before < rest")
        .withColumn("sofar", F.col("before") + F.coalesce(F.sum("t").over(inner), F.lit(0)))
        .where("sofar + t / 2 <= rest")
    )
    cuts = taken.groupBy("__s").agg(F.max("place").alias("cut"))
    out = per.drop("rest").join(cuts, "__s", "left").withColumn("cut", F.coalesce("cut", F.lit(-1)))
    return materialize(out, "mix-plan"), small


def block_of(fine: str) -> Column:
    """The block of a fine block: a hash, so that blocks have like sizes."""
    return F.pmod(F.xxhash64(F.col(fine)), F.col("blocks"))


def mix(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    target_entropy: float | None = None,
    max_repetition: float | None = MAX_REPETITION,
    budget_tokens: float | None = None,
    seed: int = 7,
) -> DataFrame:
    """Every drawn copy of a document: its columns and ``mix_epoch, mix_block, mix_place, mix_tokens, mix_weight, mix_epochs`` (columns of those names are replaced).

    Reading by (mix_epoch, mix_place) gives the block permutation of each source.
    """
    per, small = plan(docs, source_col, text_col, id_col, target_entropy, max_repetition, budget_tokens, seed)
    per = per.drop("tokens")
    keyed = docs.select(
        F.struct(*[c for c in docs.columns if c not in OUT]).alias("__row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\x00null")).alias("__s"),
        F.pmod(row_key(id_col, text_col), F.lit(1 << 20)).alias("f"),
        tokens(text_col).alias("mix_tokens"),
    )
    joined = keyed.join(F.broadcast(per) if small else per, "__s").withColumn("mix_block", block_of("f"))
    last = permuted("__s", "whole", "mix_block", seed) <= F.col("cut")
    epochs = F.when(F.col("whole") + last.cast("int") > 0, F.sequence(F.lit(0), F.col("whole") + last.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    drawn = joined.withColumn("mix_epoch", F.explode(epochs))
    return drawn.select("__row.*", "mix_epoch", "mix_block", permuted("__s", "mix_epoch", "mix_block", seed).alias("mix_place"), "mix_tokens", F.col("weight").alias("mix_weight"), F.col("epochs").alias("mix_epochs"))
