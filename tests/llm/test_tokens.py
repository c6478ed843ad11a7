"""Token counts and SentencePiece against the libraries."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest

from paperlake.llm import sentencepiece as S
from paperlake.llm import token_counts as T

pytest.importorskip("public_tokenizers")


def reference_counts(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(T.default_path())
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "\t", "don't", "ñu", "漢字", "🙂", "12", "...", "<|endoftext|>", "a" * 9, " ", " \n ", ",", "'s"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 400))) for _ in range(n)]


def test_counts_equal_library_for_odd_texts():
    texts = random_texts(200, 1) + ["", " ", "\n", "<|endoftext|>"]
    b = T.backend(T.default_path())
    assert b.splices
    assert T.count_batch(b, texts) == reference_counts(texts)
    assert max(len(t.encode()) for t in texts) < T.CHUNK


def test_every_text_over_a_chunk_is_spliced(monkeypatch):
    texts = [" ".join(random_texts(12, seed)) for seed in range(6)]
    b, seen = T.backend(T.default_path()), []
    spliced = T.stable_boundary
    monkeypatch.setattr(T, "stable_boundary", lambda *a: seen.append(spliced(*a)) or seen[-1])
    assert min(len(t.encode()) for t in texts) > T.CHUNK
    assert T.count_batch(b, texts) == reference_counts(texts)
    assert sum(p is not None for p in seen) >= len(texts)


@pytest.mark.parametrize("chunk,overlap", [(50, 8), (64, 20), (200, 1)])
def test_overlap_resynchronisation_equals_whole_encoding(chunk, overlap):
    b = T.backend(T.default_path())
    texts = [t for t in random_texts(60, 2) + ["x" * 700, "ab " * 300, "漢" * 300 + " a b" * 30] if t]
    assert [T.count_long(b, t.encode(), chunk, overlap) for t in texts] == reference_counts(texts)


def test_count_tokens_operator(spark, odd_docs, no_docs):
    rows = T.count_tokens(odd_docs).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    assert sorted(r.n_tokens for r in rows) == sorted(reference_counts(texts))
    assert sorted(r.n_bytes for r in rows) == sorted(len(t.encode()) for t in texts)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert T.count_tokens(no_docs).count() == 0


def test_sentencepiece_parity_and_round_trip():
    c = S.codec(S.default_path())
    texts = random_texts(150, 3) + ["", " ", "a▁b", "a ", "  ", " a", "a  b   c ▁▁"]
    got = c.encode(texts)
    for t, (ids, parity) in zip(texts, got, strict=True):
        ids = list(struct.unpack(f"<{len(ids) // 4}i", ids))
        assert ids == c.sp.encode(t), t
        assert parity
        assert c.decode(ids) == c.sp.decode(ids) == c.tok.decode(ids)[1 if ids else 0 :]
        assert (c.decode(ids) == t) == ("▁" not in t)


def test_sentencepiece_ids_that_are_no_text():
    c = S.codec(S.default_path())
    ids = [c.sp.piece_to_id("<0xE6>"), c.sp.piece_to_id("▁the"), c.sp.piece_to_id("<0xFF>")]
    assert c.decode(ids) == c.tok.decode(ids)


def test_sentencepiece_disagreement_is_reported(monkeypatch):
    """Where the rebuilt tokenizer differs, the library's ids come back and parity is false."""
    c = S.Codec(S.default_path())
    both = c.both
    monkeypatch.setattr(c, "both", lambda normal: ((mine + [5] if "wrong" in x else mine, right) for x, (mine, right) in zip(normal, both(normal), strict=True)))
    (a, good), (b, bad) = c.encode(["all is well", "this is wrong here"])
    assert good and not bad
    assert np.frombuffer(b, np.int32).tolist() == c.sp.encode("this is wrong here")


def message(*pairs):
    out = b""
    for number, value in pairs:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


@pytest.mark.parametrize("extra", [0, 1])
def test_unigram_model_written_by_hand(tmp_path, extra):
    """Unigram scores, byte fallback and white space rules, against the library on the same protobuf."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -3.0, 1), ("▁a", -2.0, 1), ("ab", -2.5, 1), ("b", -3.5, 1), ("a", -3.2, 1), ("▁abc", -4.0, 1), ("c", -3.9, 1), ("bc", -3.0, 1)]
    spec = message((3, 1), (35, 1), (40, 0))
    normal = message((1, "identity"), (3, 1), (4, extra), (5, 1))
    data = message(*[(1, message((1, p), (2, s), (3, k))) for p, s, k in pieces], (2, spec), (3, normal))
    path = tmp_path / "hand.model"
    path.write_bytes(data)
    c = S.Codec(str(path))
    assert c.model.kind == 1 and c.model.byte_fallback
    for t in ["abc", "ab abc", "aab  bc", "ü abc", " a ", ""]:
        ids, parity = c.encode([t])[0]
        assert list(struct.unpack(f"<{len(ids) // 4}i", ids)) == c.sp.encode(t), t
        assert parity, t


def test_encode_and_decode_operators(spark, odd_docs, no_docs):
    enc = S.encode(odd_docs)
    c = S.codec(S.default_path())
    want = sorted(S.sha(c.sp.encode(r.text or "")) for r in odd_docs.collect())
    assert sorted(r.ids_sha256 for r in S.digest(enc).collect()) == want
    assert sorted(r.text for r in S.decode(enc).collect()) == sorted(r.text or "" for r in odd_docs.collect())
    assert S.encode(no_docs).count() == 0
