"""Operator 1, token counts with overlap resynchronisation.

A text of up to ``chunk`` bytes is one chunk. A longer one is encoded as
overlapping chunks, with the offset of every token; neighbouring encodings are
spliced at a stable boundary on which both agree, and the overlap is doubled
when there is none, until in the worst case (no white space at all) the chunks
merge into one.

Offsets are in bytes: a byte-level vocabulary gives every token its number of
bytes, and an encoding covers its chunk without gaps, so they are running sums.

Why a boundary is stable: with the byte-level pre-tokenizer, a single space
between two characters that aren't white space always begins a pre-token,
whatever stands before or after, because no alternative of its pattern matches
a space behind another character, and the pattern never looks back. So the
tokens on each side don't depend on the other side. Only spaces between visible
ASCII characters are taken. Special strings hold no space, and the check in
``Backend`` makes sure of that; files of another kind are encoded whole.

Defined results: null and empty texts count 0 tokens and 0 bytes; rows with
null or repeated ids are counted like any other; extra columns are left out,
so their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import library_threads, slices

#: Bytes of a chunk, and by how many neighbours overlap at first.
CHUNK = 4_096
OVERLAP = 128
#: Chunks that the library's threads encode together.
GROUP = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Backend:
    def __init__(self, path: str):
        library_threads()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        shape = str(self.tok.pre_tokenizer)
        added = {i: a.content for i, a in self.tok.get_added_tokens_decoder().items()}
        #: Splicing is proven for the byte-level pattern only.
        self.splices = (
            self.tok.normalizer is None
            and shape.startswith("ByteLevel(add_prefix_space=False")
            and "use_regex=True" in shape
            and not any(a.lstrip or a.rstrip or a.single_word for a in self.tok.get_added_tokens_decoder().values())
            and not any(c.isspace() for text in added.values() for c in text)
        )
        vocabulary = self.tok.get_vocab()
        self.splices &= sum(len(token) == 1 for token in vocabulary) >= 256  # every byte is a token: no gaps
        #: Bytes of each token: its characters stand for one byte each, but for special strings.
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(added[i].encode()) if i in added else len(token)

    def ids(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(list(texts), add_special_tokens=False)]

    def starts(self, data: bytes, spans: Sequence[tuple[int, int]]) -> Iterator[np.ndarray]:
        """For each span of a text, the offsets at which its tokens begin."""
        for i in range(0, len(spans), GROUP):
            for x in self.ids([data[a:b].decode() for a, b in spans[i : i + GROUP]]):
                n = self.bytes[np.array(x, np.int64)]
                yield np.cumsum(n) - n


@lru_cache(maxsize=4)
def backend(path: str) -> Backend:
    return Backend(path)


def character_start(data: bytes, at: int) -> int:
    """The last position up to ``at`` where a character begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def stable_boundary(data: bytes, left: np.ndarray, a: int, right: np.ndarray, b: int, end: int) -> int | None:
    """The last position before ``end`` that begins a token in both encodings and is proven stable.

    ``left`` and ``right`` hold token starts of the chunks that begin at ``a`` and ``b``.
    """
    both = np.intersect1d(left[np.searchsorted(left, b - a, side="right") :] + a, right[: np.searchsorted(right, end - b)] + b)
    for p in both[(both > b) & (both < end - 1)][::-1].tolist():
        if data[p] == 32 and 32 < data[p - 1] < 127 and 32 < data[p + 1] < 127:
            return p
    return None


def count_long(tok: Backend, data: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text by overlapping chunks."""
    spans, at = [], 0
    while True:
        end = character_start(data, min(len(data), at + max(chunk, 8)))
        spans.append((at, end))
        if end == len(data):
            break
        at = max(at + 1, character_start(data, end - min(overlap, max(chunk, 8) // 2)))
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
    others = tok.starts(data, spans)
    (a, b), *rest = spans
    starts, base, total = next(others), 0, 0
    for (c, d), further in zip(rest, others, strict=True):
        if d <= b:  # a merged chunk has covered it
            continue
        width, p = b - c, None
        while (p := stable_boundary(data, starts, a, further, c, b) if c > base else None) is None:
            width *= 2
            if b - width <= base:  # the overlap has reached the last splice: one larger chunk instead
                break
            c = character_start(data, b - width)
            further = next(tok.starts(data, [(c, d)]))
        if p is None:
            a, b = base, max(d, character_start(data, min(len(data), 2 * b - base)))
            starts = next(tok.starts(data, [(a, b)]))
            continue
        total += int(np.searchsorted(starts, p - a) - np.searchsorted(starts, base - a))
        base, a, b, starts = p, c, d, further
    return total + int(len(starts) - np.searchsorted(starts, base - a))


def count_batch(tok: Backend, texts: Sequence[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    data = [t.encode() for t in texts]
    long = [tok.splices and len(x) > chunk for x in data]
    short = iter(tok.ids([t for t, is_long in zip(texts, long, strict=True) if not is_long]))
    return [count_long(tok, x, chunk, overlap) if is_long else len(next(short)) for x, is_long in zip(data, long, strict=True)]


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    limit: int = 1024,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row; a narrow step, without shuffle."""
    path = path or default_path()
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {kind.simpleString()}, n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = backend(path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            counts = pa.array(count_batch(tok, texts, chunk, overlap), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], names=["id", "n_bytes", "n_tokens"])

    out = src.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
