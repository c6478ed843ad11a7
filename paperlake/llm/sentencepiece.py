"""Operator 3, SentencePiece encoding and decoding on the tokenizers library.

The model file is read as a protobuf (wire format, no generated code). From it
come the normaliser, the metaspace marker, the scores (unigram scores, or for
BPE models merges ranked by the score of what they make) and byte fallback, and
a ``tokenizers.Tokenizer`` with decoder is built.

Units: if no piece of the vocabulary has the marker behind another character,
no token can reach across such a place, so a text is the concatenation of its
units (a marker run plus following characters). Units that a worker doesn't
remember are strung together and encoded in batches on several threads, by the
rebuilt tokenizer and by the sentencepiece library; so every distinct unit's
parity is verified. Otherwise every text is encoded whole by both. Where the two
differ, the library's ids are returned and ``parity`` is false for the row.

Every row's ids are decoded again; ``round_trip`` says whether that gives the text.

Defined results: null and empty texts give no ids and count as round trips;
rows with null or repeated ids are treated like others; other columns are kept
by ``encode`` only when named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import THREADS, free_name, library_threads, slices

MARK = "▁"
#: Distinct units that a worker remembers; beyond it starts anew.
MEMO = 100_000
#: Units that are strung together for one call of the libraries.
STRUNG = 200
#: A unit in front of a lone one, since the library gives nothing for a lone marker.
LEAD = MARK + "a"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1
    byte_fallback: bool = False
    whitespace_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for k, v in fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                m.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(fields(value))
                m.kind = spec.get(3, 1)
                m.byte_fallback = bool(spec.get(35, 0))
                m.whitespace_suffix = bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(fields(value))
                m.charsmap = spec.get(2, b"")
                m.dummy_prefix, m.remove_extra, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if m.kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if m.whitespace_suffix or not m.escape:
            raise ValueError("models with a marker behind words or without a marker are not supported")
        return m


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that join into a piece, the best scored result first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (_NORMAL, _USER)}
    found = []
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if a in ids and b in ids:
                found.append((-model.pieces[i][1], ids[a], ids[b], a, b))
    found.sort(key=lambda x: x[:3])
    return [(a, b) for *_, a, b in found]


def build(model: Model):
    """A ``tokenizers.Tokenizer`` for the parsed model; units go in, without pre-tokenizer."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = next(p for p, _, kind in model.pieces if kind == _UNKNOWN)
    if model.kind == 1:
        unk_id = next(i for i, x in enumerate(model.pieces) if x[2] == _UNKNOWN)
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id, model.byte_fallback)
    else:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)},
            merges(model),
            unk_token=unknown,
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    tok = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    if user := [p for p, _, kind in model.pieces if kind == _USER]:
        tok.add_tokens([AddedToken(p, normalized=False) for p in user])
    return tok


class Codec:
    """Both backends for one model file, with a memory of distinct units."""

    def __init__(self, path: str):
        library_threads()
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model = Model.parse(data)
        self.tok = build(self.model)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.normalizer, self.tok.normalizer = self.tok.normalizer, None
        plain = not self.model.charsmap and not self.model.remove_extra
        self.plain = plain and self.model.dummy_prefix
        known = [p for p, _, kind in self.model.pieces if kind in (_NORMAL, _USER)]
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in known)
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not crossing and self.model.dummy_prefix and MARK in known else None
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.bytes = [piece_bytes(p, kind) for p, _, kind in self.model.pieces]
        self.memo: dict[str, bytes] = {}
        #: The few units on which the two differ.
        self.flaws: set[str] = set()

    def normalize(self, text: str) -> str:
        if self.plain:  # what the rebuilt normaliser does with an identity rule, without its bookkeeping
            return MARK + text.replace(" ", MARK) if text else ""
        return self.normalizer.normalize_str(text)

    def both(self, normal: Sequence[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of normalised strings by the rebuilt tokenizer and by the library, which puts its own marker in front."""
        raw = [(x[1:] if self.model.dummy_prefix else x).replace(MARK, " ") for x in normal]
        mine = self.tok.encode_batch_fast(list(normal), add_special_tokens=False)
        return zip((e.ids for e in mine), self.sp.encode(raw, num_threads=THREADS), strict=True)

    def learn(self, units: Sequence[str]) -> None:
        """Ids and parity of units that are new."""
        # a unit with a single marker begins at each piece with a marker, so its ids are found again in a string of units
        simple, lone = [], []
        for u in units:
            (simple if len(u) > 1 and u[1] != MARK else lone).append(u)
        strung = [simple[i : i + STRUNG] for i in range(0, len(simple), STRUNG)]
        for part, (mine, right) in zip(strung, self.both(["".join(x) for x in strung]), strict=True):
            ids = np.array(right, np.int32)
            at = np.flatnonzero(self.begins[ids]) * 4
            if mine != right or len(at) != len(part):
                lone += part
                continue
            whole, ends = ids.tobytes(), [*at[1:].tolist(), len(ids) * 4]
            for u, a, b in zip(part, at.tolist(), ends, strict=True):
                self.memo[u] = whole[a:b]
        if lone:
            (mine_lead, right_lead), *found = self.both([LEAD, *(LEAD + u for u in lone)])
            for u, (mine, right) in zip(lone, found, strict=True):
                if mine[len(mine_lead) :] != right[len(right_lead) :]:
                    self.flaws.add(u)
                self.memo[u] = np.array(right[len(right_lead) :], np.int32).tobytes()

    def encode(self, texts: Sequence[str]) -> list[tuple[bytes, bool]]:
        """For each text its ids as int32 bytes, and parity with the library."""
        normal = [self.normalize(t) for t in texts]
        if self.units is None:
            return [(np.array(right, np.int32).tobytes(), mine == right) for mine, right in self.both(normal)]
        if len(self.memo) > MEMO:
            self.forget()
        cut = [self.units.findall(t) for t in normal]
        if new := list({u for units in cut for u in units if u not in self.memo}):
            self.learn(new)
        return [(b"".join(map(self.memo.__getitem__, units)), not self.flaws or self.flaws.isdisjoint(units)) for units in cut]

    def forget(self) -> None:
        self.memo.clear()
        self.flaws.clear()

    def decode(self, ids: Sequence[int]) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:  # bytes that are no text: the decoder's own replacement
            text = self.tok.decode(list(ids), skip_special_tokens=True)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def piece_bytes(piece: str, kind: int) -> bytes:
    """What a piece stands for in a decoded text: the decoder's steps, done once for each piece."""
    if kind == _BYTE:
        return bytes([int(piece[3:5], 16)])
    if kind == _CONTROL:
        return b""
    return piece.replace(MARK, " ").encode() if kind != _UNKNOWN else " \u2047 ".encode()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(
    docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None
) -> DataFrame:
    """``keep`` columns, ``input_ids array<int>, n_tokens, parity, round_trip`` of every row."""
    path = path or default_path()
    src = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias(free_name(keep, "__text")))
    schema = T.StructType(
        [
            *src.schema.fields[:-1],
            T.StructField("input_ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("parity", T.BooleanType()),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = codec(path)
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            got = backend.encode(texts)
            sizes = np.array([len(x) // 4 for x, _ in got], np.int64)
            ends = np.cumsum(sizes)
            flat = np.frombuffer(b"".join(x for x, _ in got), np.int32)
            back = [backend.decode(flat[e - n : e].tolist()) == t for n, e, t in zip(sizes, ends, texts, strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            cols = [*batch.columns[:-1], ids, pa.array(sizes), pa.array([x for _, x in got]), pa.array(back)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        backend.forget()

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids_col: str = "input_ids", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` columns and ``text``; null ids give null."""
    path = path or default_path()
    src = encoded.select(*[F.col(c) for c in keep], F.col(ids_col).alias(free_name(keep, "__ids")))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = codec(path)
        for b in batches:
            texts = [backend.decode(x.as_py()) if x.is_valid else None for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``ids_sha256`` of the ids as comma-separated text instead of the ids."""
    return encoded.select(
        id_col,
        "n_tokens",
        F.sha2(F.concat_ws(",", F.col("input_ids").cast("array<string>")), 256).alias("ids_sha256"),
        "parity",
        "round_trip",
    )


def sha(ids: Sequence[int]) -> str:
    """``digest``'s value for plain Python ids."""
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
