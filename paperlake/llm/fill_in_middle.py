"""Operator 12, fill-in-middle transformation over a Roaring-style boundary set.

A text is read as tokens, runs of ASCII letters or single other characters, and
is cut only between tokens. The ends of its tokens, in code points from 0, are
kept as a set of integers like a Roaring bitmap: each range of 65,536 positions
is a container that is a sorted array, a bitmap or a list of runs, whichever is
smallest; cumulative cardinalities over the containers tell which of them holds
the k-th boundary, and a select inside of it tells where. So two cuts need two
searches, and a long text is read one container at a time.

Both cuts are uniform over the n + 1 boundaries; they and the form come from a
hash of the seed and the id alone, so a row gets the same result whatever
partition it is in and however often it is computed. The step is narrow.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is
``<S>suffix<P>prefix<M>middle``, ``plain`` is the text itself.

Defined results: null and empty texts, and texts that hold a sentinel, are
plain; a null id draws like an empty one; repeated rows get equal results;
other columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from paperlake.llm.common import free_name, slices, text_or_empty

SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are cut, and of a hundred of those so many begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
CONTAINER = 1 << 16


class Boundaries:
    """A set of growing integers in containers; ``select(k)`` is the k-th, from 0."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.upto = [0]  # members before each container, and behind the last
        self.parts: list[tuple[str, np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return self.upto[-1]

    def add(self, key: int, low: np.ndarray) -> None:
        """The members of container ``key`` by their lower 16 bits, in order; containers come in order too."""
        if not len(low):
            return
        breaks = np.flatnonzero(np.diff(low) != 1) + 1
        begins = np.concatenate([[0], breaks])
        sizes = {"array": 2 * len(low), "bitmap": CONTAINER // 8, "run": 4 * len(begins) + 2}
        kind = min(sizes, key=sizes.__getitem__)
        if kind == "array":
            part = (kind, low.astype(np.uint16), low[:0])
        elif kind == "run":  # starts, and members before each run
            part = (kind, low[begins].astype(np.uint16), begins.astype(np.uint32))
        else:  # words of 64 bits, and members before each word
            bits = np.zeros(CONTAINER, np.uint8)
            bits[low] = 1
            ones = bits.reshape(-1, 64).sum(1)
            part = (kind, np.packbits(bits, bitorder="little").view("<u8"), (np.cumsum(ones) - ones).astype(np.uint32))
        self.keys.append(key)
        self.parts.append(part)
        self.upto.append(self.upto[-1] + len(low))

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = bisect_right(self.upto, k) - 1
        kind, members, before = self.parts[at]
        k -= self.upto[at]
        if kind == "array":
            low = int(members[k])
        else:
            j = int(np.searchsorted(before, k, side="right")) - 1
            rest = k - int(before[j])
            if kind == "run":
                low = int(members[j]) + rest
            else:
                word = np.unpackbits(members[j : j + 1].view(np.uint8), bitorder="little")
                low = 64 * j + int(np.flatnonzero(word)[rest])
        return self.keys[at] * CONTAINER + low


def token_boundaries(text: str) -> Boundaries:
    """0 and the end of every token, read one container of the text at a time."""
    found, ascii_only, before = Boundaries(), text.isascii(), False
    for a in range(0, len(text) + 1, CONTAINER):
        part = text[a : a + CONTAINER]
        code = np.frombuffer(part.encode(), np.uint8) if ascii_only else np.frombuffer(part.encode("utf-32-le"), "<u4")
        letter = np.zeros(len(part) + 1, bool)
        letter[0] = before
        np.less((code | 32) - np.asarray(97, code.dtype), 26, out=letter[1:])
        inside = letter[:-1] & letter[1:]  # position a + i stands between two letters
        low = np.flatnonzero(~inside)
        if len(part) < CONTAINER:  # the end of the text
            low = np.append(low, len(part))
        found.add(a // CONTAINER, low)
        before = bool(letter[-1])
    return found


def transform(text: str, draw: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, code points of prefix and middle (null if plain), and the text in its form. ``draw``: 32 hexadecimal digits or more."""
    h = [int(draw[8 * i : 8 * i + 8], 16) for i in range(4)]
    ends = token_boundaries(text)
    n = len(ends) - 1
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = map(ends.select, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, s, m = SENTINELS
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed; it holds no sentinel unless its form is plain, so the parts are unambiguous."""
    part = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """All columns of ``docs`` and ``fim_tokens, fim_form, fim_prefix_chars, fim_middle_chars, fim_text`` (longer names where those are taken)."""
    others = [c for c in docs.columns if c != text_col]
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    src = docs.select(F.struct(*others).alias("row"), F.col(text_col).isNull().alias("absent"), draw.alias("draw"), text_or_empty(text_col).alias("text"))
    fields = [("n", LongType()), ("form", StringType()), ("prefix", LongType()), ("middle", LongType()), ("output", StringType())]
    schema = StructType([*src.schema.fields[:2], *(StructField(n, t) for n, t in fields), StructField("text", StringType())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, draws = b.column(3).to_pylist(), b.column(2).to_pylist()
            rows = zip(*(transform(t, d, rate, suffix_first) for t, d in zip(texts, draws, strict=True)), strict=True)
            made = [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made, b.column(3)], names=schema.names)

    out = src.mapInArrow(run, schema)
    text = F.when(~F.col("absent"), F.col("text"))
    kept = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    new, taken = [], list(docs.columns)
    for inner, name in zip(("n", "form", "prefix", "middle", "output"), ("fim_tokens", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"), strict=True):
        taken.append(free_name(taken, name))
        new.append(F.col(inner).alias(taken[-1]))
    return out.select(*kept, *new)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: tokens, form, lengths, and the SHA-256 of the output and of the text that is rebuilt from it."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = fill_in_middle(plain, "doc_id", "text")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("fim_tokens").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2(F.col("fim_text"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


#: The digest's rows in DuckDB's SQL, by lists of tokens.
SQL = """
with cut as (
    select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, '')) h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') w
    from documents
), drawn as (
    select doc_id, t, w, len(w) n, ('0x' || h[1:8])::bigint % (len(w) + 1) a, ('0x' || h[9:16])::bigint % (len(w) + 1) b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
            when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end form
    from cut
), parts as (
    select doc_id, t, n, form, array_to_string(w[1:least(a, b)], '') p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') m, array_to_string(w[greatest(a, b) + 1:], '') s
    from drawn
)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end::bigint prefix_chars, case when form <> 'plain' then length(m) end::bigint middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
    sha256(t) restored_sha256
from parts
"""
