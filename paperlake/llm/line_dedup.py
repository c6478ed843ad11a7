"""Operator 10, line dedup by winnowing, in DataFrame functions only.

Each document is its sequence of line hashes. Grams of ``k`` lines are hashed;
of every window of ``w`` grams the (last) smallest is kept as a fingerprint, so
any run of at least ``k + w - 1`` equal lines shares one in every such window.
Positions are joined through keys: the gram, and the gram with 1 to ``w - 1``
lines before or behind. Each later position meets the first one of its key,
never all others. Every line and every gram of more than ``LONG`` words is a key
of its own, so a repeated passage of whole lines and over ``LONG`` words always
meets its first place, however few lines it has.

A position carries the hashes of ``w - 1`` lines on either side, so a match is
extended both ways in its own row. No match has to go further: behind at most
``w - 1`` lines comes a fingerprint with a match of its own, or the run's end. The lines of a
match, ``k`` or more or a single one of more than ``LONG`` words, are deleted from
the later place.

"Later" is by (id, row key, line number), null ids first. Lines are equal if
their text is, byte for byte; a text of n line feeds has n + 1 lines.

Defined results: null and empty texts have no line to delete; rows with equal
id and text count as one document, each of them gets its result; extra columns
stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import materialize, row_key, text_or_empty

K = 2
W = 2
#: Lines and grams of more words (runs of characters that are no ASCII white space) need no fingerprint to be found.
LONG = 50


def lines(text_col: str) -> Column:
    t = text_or_empty(text_col)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n"))


def fingerprints(k: int, w: int) -> Column:
    """Positions in ``g`` (grams) that are the last minimum of a window; of all of them, if fewer than ``w``."""
    n = F.size("g")

    def last_min(s: Column) -> Column:
        part = F.slice("g", s + 1, F.least(F.lit(w), n))
        return s + F.size(part) - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

    starts = F.sequence(F.lit(0), F.greatest(n - w, F.lit(0)))
    return F.when(n > 0, F.array_distinct(F.transform(starts, last_min))).otherwise(F.array().cast("array<int>"))


def line_spots(docs: DataFrame, id_col: str, text_col: str, k: int = K, w: int = W) -> DataFrame:
    """``id, key, f, i, n, near``: the keys of each document's fingerprints; ``n`` lines from line ``i``, and what stands around them."""
    h = docs.select(
        F.col(id_col).alias("id"),
        row_key(id_col, text_col).alias("key"),
        F.transform(lines(text_col), lambda x: F.xxhash64(x)).alias("h"),
        F.transform(lines(text_col), lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("m"),
    ).where(F.size("h") > 0)
    starts = F.when(F.size("h") >= k, F.sequence(F.lit(0), F.size("h") - k)).otherwise(F.array().cast("array<int>"))
    grams = h.withColumn("g", F.transform(starts, lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(k)]))).withColumn("p", fingerprints(k, w))
    words = lambda i: sum((F.get("m", i + j) for j in range(1, k)), F.get("m", i))
    numbers = lambda c: F.transform(c, lambda x, i: i)
    long_grams = F.array_except(F.filter(numbers("g"), lambda i: words(i) > LONG), "p")
    long_lines = F.filter(numbers("h"), lambda i: F.get("m", i) > LONG)

    def spot(i: Column, n: int, f: Column) -> Column:
        near = F.transform(F.sequence(i - (w - 1), i + (n + w - 2)), lambda j: F.get("h", j))
        return F.struct(f.alias("f"), i.alias("i"), F.lit(n).alias("n"), near.alias("near"))

    def keys(i: Column) -> Column:
        whole = lambda a, b: F.when((a >= 0) & (b < F.size("h")), F.xxhash64(i - a, *[F.get("h", a + j) for j in range(k + t)]))
        found = [F.xxhash64(F.lit(0), F.get("g", i))]
        for t in range(1, w):
            found += [whole(i - t, i + (k - 1)), whole(i, i + (k - 1 + t))]
        return F.filter(F.array(*[spot(i, k, f) for f in found]), lambda x: x["f"].isNotNull())

    found = F.concat(
        F.flatten(F.transform("p", keys)),
        F.transform(long_grams, lambda i: spot(i, k, F.xxhash64(F.lit(0), F.get("g", i)))),
        F.transform(long_lines, lambda i: spot(i, 1, F.xxhash64(F.lit("line"), F.get("h", i)))),
    )
    return grams.select("id", "key", F.inline(found))


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, k: int = K, w: int = W) -> DataFrame:
    """``key, a, b``: later repeated runs of lines, from line ``a`` to line ``b``; they may overlap."""
    spots = materialize(line_spots(docs, id_col, text_col, k, w), "line-spots")
    first = spots.groupBy("f").agg(F.min(F.struct("id", "key", "i", "near")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = spots.select("key", "f", "i", "n", "near").join(first, "f").where((F.col("first.key") != F.col("key")) | (F.col("first.i") != F.col("i")))

    def equal_lines(places: list[Column]) -> Column:
        """How many lines are equal one after the other."""
        so_far, out = F.lit(True), F.lit(0)
        for j in places:
            so_far = so_far & F.coalesce(F.get("near", j) == F.get("first.near", j), F.lit(False))
            out = out + so_far.cast("int")
        return out

    left = equal_lines([F.lit(w - 2 - t) for t in range(w - 1)])
    right = equal_lines([F.col("n") + (w - 1 + t) for t in range(w - 1)])
    return later.select("key", (F.col("i") - left).alias("a"), (F.col("i") + F.col("n") - 1 + right).alias("b")).distinct()


def _kept(docs: DataFrame, id_col: str, text_col: str, k: int, w: int) -> DataFrame:
    """``row`` (struct of all columns), ``lines``, ``spans`` of kept lines (null: all are), ``behind`` (the first line behind the last run)."""
    runs = repeated_runs(docs, id_col, text_col, k, w)
    before = Window.partitionBy("key").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("from", F.coalesce(F.max("b").over(before) + 1, F.lit(0)))
    span = F.when(F.col("a") > F.col("from"), F.struct(F.col("from").alias("from"), (F.col("a") - F.col("from")).alias("n")))
    spans = runs.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"), (F.max("b") + 1).alias("behind"))
    row = docs.select(F.struct(*docs.columns).alias("row"), row_key(id_col, text_col).alias("key"))
    return row.join(spans, "key", "left").select("row", lines(f"row.{text_col}").alias("lines"), "spans", "behind")


def _deduped(docs: DataFrame, id_col: str, text_col: str, k: int, w: int) -> DataFrame:
    """``row`` (struct of all columns), ``text`` without repeated runs, ``n_lines``, ``n_gone``."""
    kept = _kept(docs, id_col, text_col, k, w)
    size = F.size("lines")
    tail = F.slice("lines", F.col("behind") + 1, F.greatest(size - F.col("behind"), F.lit(0)))
    left = F.concat(F.flatten(F.transform("spans", lambda s: F.slice("lines", s["from"] + 1, s["n"]))), tail)
    parts = kept.select("row", "spans", size.alias("n_lines"), left.alias("left"))
    return parts.select(
        "row",
        F.when(F.col("spans").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join("left", "\n")).alias("text"),
        "n_lines",
        F.when(F.col("spans").isNull(), 0).otherwise(F.col("n_lines") - F.size("left")).alias("n_gone"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """All rows with their columns, ``text_col`` without repeated runs."""
    out = _deduped(docs, id_col, text_col, k, w)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its lines, how many went, and the SHA-256 of what is left."""
    return _deduped(docs.select(id_col, text_col), id_col, text_col, K, W).select(
        F.col("row").getField(id_col).alias(id_col),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_gone").cast("long").alias("n_removed"),
        F.sha2(text_or_empty("text"), 256).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without repeated runs; those of which no line is left go. ``n_chars``, if there, is counted anew."""
    out = _deduped(docs, id_col, text_col, K, W).where("n_gone = 0 or n_gone < n_lines")
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_gone") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
