"""TIFF: codecs, forms, pages, round trips."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from paperlake.llm import tiff as T


@pytest.mark.parametrize("seed", range(4))
def test_codecs_round_trip(seed):
    rng = random.Random(seed)
    for n in [0, 1, 2, 127, 128, 129, 255, 256, 257, 511, 3000, 9000]:
        for d in (bytes(rng.choices(b"ab", k=n)), os.urandom(n), b"\0" * n, bytes(rng.choices(b"the cat \xff", k=n))):
            assert T.lzw_decode(T.lzw_encode(d)) == d
            assert T.packbits_decode(T.packbits_encode(d)) == d


def test_known_streams():
    # the example of the format's description
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert T.packbits_decode(packed).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    assert T.lzw_decode(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("codec", [T.NONE, T.LZW, T.DEFLATE, T.OLD_DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("tile", [None, 16, (16, 48)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_files_round_trip(codec, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, (h, w, s)).astype(t) for h, w, s, t in ((1, 1, 1, "u1"), (40, 33, 3, "u1"), (17, 70, 1, "u2"))]
    for predictor in (False, True):
        got = list(T.read_pages(T.write_tiff(pages, codec, predictor, tile, 7, order)))
        assert [p.number for p in got] == [0, 1, 2]
        for want, p in zip(pages, got, strict=True):
            assert p.compression == codec and p.tiled == bool(tile) and np.array_equal(p.samples, want)


def test_text_media(spark, odd_docs, no_docs):
    rows = T.text_media(odd_docs).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    want = []
    for t in texts:
        b = t.encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    same = [r for r in rows if r.doc_id in (None, 1)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1
    assert T.text_media(no_docs).count() == 0


def test_one_row_per_page_and_faults(spark):
    a = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    good = T.write_tiff([a, a + 1, a + 2], T.LZW)
    loop = bytearray(good)
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"no")), (4, bytearray(good[:-30])), (5, loop)], "doc_id long, media binary")
    rows = T.tiff_pages(df).collect()
    assert [(r.page, r.width, r.height, r.samples) for r in rows if r.doc_id == 1] == [(0, 2, 2, 3), (1, 2, 2, 3), (2, 2, 2, 3)]
    assert bytes([r for r in rows if r.doc_id == 1][1].payload) == (a + 1).tobytes()
    assert not [r for r in rows if r.doc_id == 2]
    assert [r.error is not None for r in rows if r.doc_id == 3] == [True]
    assert [r.error is not None for r in rows if r.doc_id == 4][-1]
    assert T.tiff_pages(df.where("false")).count() == 0


@pytest.mark.parametrize("rows", [1, 5, 63, 65, 300])
def test_payloads_of_every_size_meet_every_codec(rows):
    rng = random.Random(rows)
    seen = set()
    for _ in range(24):
        data = T.payload("".join(rng.choices("etaoin shrdlu\n", k=rows * T.BLOCK - 7)))
        media = T.to_tiff(data)
        pages = list(T.read_pages(media))
        tiled = pages[0].tiled
        assert len(pages) == -(-rows // (T.TILE[0] if tiled else T.PAGE_ROWS)) and all(p.tiled == tiled for p in pages)
        assert T.from_tiff(media)[0] == data and T.to_tiff(data) == media
        seen |= {(p.compression, p.tiled) for p in pages}
    assert {c for c, _ in seen} == {T.DEFLATE, T.LZW, T.PACKBITS} and {t for _, t in seen} == {True, False}


def tagged(entries):
    """A file of one directory without image data."""
    import struct

    out = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(entries))
    return out + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(entries)) + b"\0" * 64


def test_sizes_that_cannot_be_are_faults_not_crashes(spark):
    good = {256: 4, 257: 4, 258: 8, 259: 1, 273: 100, 277: 1, 278: 4, 279: 16}
    assert len(list(T.read_pages(tagged(good.items())))) == 1
    bad = [{278: 0}, {256: 0}, {257: 0}, {277: 0}, {256: 2**32 - 1}, {257: 2**32 - 1}, {256: 2**32 - 1, 257: 2**32 - 1}, {258: 4}, {317: 3}, {279: 2**32 - 1, 256: 2**31}, {259: 7}]
    rows = [(i, tagged((good | b).items())) for i, b in enumerate(bad)]
    out = T.tiff_pages(spark.createDataFrame(rows, "doc_id int, media binary")).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(bad)))
    assert all(r.error and r.payload is None for r in out)


def test_a_stream_that_expands_for_ever_is_not_followed():
    import zlib

    assert len(T.decompress(zlib.compress(bytes(10**7)), T.DEFLATE, 1000)) <= 1001
    assert len(T.decompress(T.lzw_encode(bytes(10**6)), T.LZW, 1000)) < 6000


def test_every_codec_holds_texts_of_every_size():
    seen = set()
    for n in (1, 500, 3_000, 40_000, 300_000):
        for i in range(12):
            data = T.payload(f"{i} some words of text. " * (n // 20 + 1))
            media = T.to_tiff(data)
            assert T.from_tiff(media)[0] == data
            seen.add((n, next(T.read_pages(media)).compression))
    assert len(seen) == 15
