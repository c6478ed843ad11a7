"""Operator 8, media columns: TIFF.

``read_pages`` walks the image directories of a TIFF, decodes PackBits, LZW or
deflate strips and tiles, undoes the horizontal predictor, and gives one page
per directory; ``tiff_pages`` does so for a binary column, one row per page.
``write_tiff`` makes such files. ``text_media`` stores texts as TIFF, reads the
stored bytes back, and computes a feature from what it read.

Defined results: null media give no page row; a broken file gives one row with
``error`` set and null samples, the pages before the fault stay (faults are also
sizes of 0 or beyond what the stored bytes can make, samples of other than 8 or
16 bits, the floating-point predictor); null texts are
empty texts, whose payload is one block of bytes 255; null or repeated ids are
carried through; other columns are kept only when named in ``keep``; an empty
table gives an empty result. Each text is handled whole, by itself, without a
shuffle; a page holds at most ``PAGE_ROWS`` rows, or a tile's, so a longer text has many pages.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import free_name, slices

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
BLOCK = 576
#: A row of a page: 192 pixels of three samples.
WIDTH, SAMPLES = 192, 3
#: Rows of a page in strips; rows of a page in tiles and of a tile, and columns of a tile.
PAGE_ROWS, TILE = 8, (16, 96)
#: More bytes than this for each stored byte no codec gives.
EXPANDS = 4096

# Tags of the TIFF 6.0 format, and bytes of each field type.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES_PER_PIXEL, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I"}


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    """Runs of 3 to 128 equal bytes, and literal stretches of up to 128 between them."""
    out, done = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(done, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(run.start())
        done = run.end()
        out.extend((257 - (done - run.start()), data[done - 1]))
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


#: Codes of LZW that clear the table and end the stream; the table is cleared once its codes reach ``_FULL``.
_CLEAR, _END, _FULL = 256, 257, 4095


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes behind a clear code: from 9 to 12, one code earlier than needed."""
    return np.minimum(np.searchsorted([512, 1024, 2048], np.arange(n) + 258, side="right") + 9, 12)


_WIDTH = _widths(_FULL + 2)
#: At which bit behind a clear code each code begins.
_BIT = np.cumsum(_WIDTH) - _WIDTH


def _pack(codes: list[int], width: np.ndarray) -> np.ndarray:
    """The bits of codes, most significant first."""
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return bits[np.arange(16) >= 16 - width[:, None]]


def lzw_encode(data: bytes) -> bytes:
    """Codes from 9 to 12 bits, most significant first; widths grow one code early."""
    stretches, codes, word = [_pack([_CLEAR], _WIDTH[:1])], [], b""
    table, code = {bytes((i,)): i for i in range(256)}, _END
    for i in range(len(data)):
        letter = data[i : i + 1]
        longer = word + letter
        if longer in table:
            word = longer
            continue
        codes.append(table[word])
        code += 1
        table[longer] = code
        word = letter
        if code == _FULL - 1:  # the last code is never used: start anew
            codes.append(_CLEAR)
            stretches.append(_pack(codes, _WIDTH[: len(codes)]))
            table, codes, code = {bytes((i,)): i for i in range(256)}, [], _END
    codes += [table[word], _END] if word else [_END]
    stretches.append(_pack(codes, _WIDTH[: len(codes)]))
    return np.packbits(np.concatenate(stretches)).tobytes()


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """The bytes of a stream, or no more than about the first ``most`` of them."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    at, end, size, out = 0, len(data) * 8, 0, []
    while at + 9 <= end:
        # all codes up to the next clear code, wherever that is
        place = at + _BIT
        n = int(np.searchsorted(place + _WIDTH, end, side="right"))
        byte, width = place[:n] >> 3, _WIDTH[:n].astype(np.uint32)
        bits = padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]
        codes = (bits >> (24 - width - (place[:n] & 7).astype(np.uint32)) & ((1 << width) - 1)).tolist()
        table, last = list(first), b""
        for k, code in enumerate(codes):
            if code == _END or code == _CLEAR:
                break
            if not last:
                if code > 255:
                    raise ValueError("LZW stream begins with a code that isn't a byte")
                word = first[code]
            else:
                known = 257 + k  # entries of the table by now
                if code > known:
                    raise ValueError("LZW code beyond the table")
                word = table[code] if code < known else last + last[:1]
                table.append(last + word[:1])
            out.append(word)
            size += len(word)
            if most is not None and size >= most:
                return b"".join(out)
            last = word
        else:
            if n == len(_BIT):
                raise ValueError("LZW table is never cleared")
            break
        if code == _END:
            break
        at = int(place[k] + _WIDTH[k])
    return b"".join(out)


def inflate(data: bytes, most: int) -> bytes:
    """At most ``most`` bytes of a deflate stream."""
    return zlib.decompressobj().decompress(data, most)


def compress(data: bytes, codec: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, OLD_DEFLATE: zlib.compress, PACKBITS: packbits_encode}[codec](data)


def decompress(data: bytes, codec: int, most: int) -> bytes:
    """The bytes of one strip or tile, which has ``most``; a stream that goes on for ever isn't followed."""
    if codec in (DEFLATE, OLD_DEFLATE):
        return inflate(data, most + 1)  # one more, so that the checksum is read
    if codec == LZW:
        return lzw_decode(data, most)
    if codec in (NONE, PACKBITS):
        return packbits_decode(data) if codec == PACKBITS else bytes(data)
    raise ValueError(f"compression {codec}")


def write_tiff(
    pages: Sequence[np.ndarray], codec: int = DEFLATE, predictor: bool = True, tile: int | tuple[int, int] | None = None, strip_rows: int = 64, order: str = "<"
) -> bytes:
    """A file of pages (rows, width, samples) of 8 or 16 bits, in strips, or in tiles of side ``tile``, or of its rows and columns."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    tile = (tile, tile) if isinstance(tile, int) else tile
    for page in pages:
        h, w, s = page.shape
        bits = page.dtype.itemsize * 8
        rows, cols = tile or (strip_rows, w)
        offsets, sizes = [], []
        for y in range(0, h, rows):
            for x in range(0, w, cols):
                part = page[y : y + rows, x : x + cols]
                if tile:
                    part = np.pad(part, ((0, rows - part.shape[0]), (0, cols - part.shape[1]), (0, 0)))
                if predictor:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                data = compress(part.astype(part.dtype.newbyteorder(order)).tobytes(), codec)
                offsets.append(len(out))
                sizes.append(len(data))
                out += data
        entries = [
            (IMAGE_WIDTH, 4, [w]), (IMAGE_LENGTH, 4, [h]), (BITS, 3, [bits] * s), (COMPRESSION, 3, [codec]),
            (PHOTOMETRIC, 3, [2 if s >= 3 else 1]), (SAMPLES_PER_PIXEL, 3, [s]), (PLANAR, 3, [1]), (PREDICTOR, 3, [2 if predictor else 1]),
        ]
        if tile:
            entries += [(TILE_WIDTH, 4, [cols]), (TILE_LENGTH, 4, [rows]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, sizes)]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_COUNTS, 4, sizes)]
        packed = []
        for tag, kind, values in sorted(entries):
            data = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                place, data = len(out), data
                out += data
                data = struct.pack(order + "I", place)
            packed.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(packed)) + b"".join(packed)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    compression: int
    predictor: int
    tiled: bool
    samples: np.ndarray  # rows, width, samples


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages in the order of the directories; raises ValueError at a fault."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, number, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        try:
            tags, at_next = directory(data, at, order)
            yield page(data, tags, number, order)
        except (struct.error, zlib.error, KeyError, IndexError, MemoryError) as e:
            raise ValueError(f"page {number}: {type(e).__name__} {e}") from e
        at, number = at_next, number + 1


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    count = struct.unpack_from(order + "H", data, at)[0]
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in TYPES:
            place = at + 10 + 12 * i
            if n * struct.calcsize(TYPES[kind]) > 4:
                place = struct.unpack_from(order + "I", data, place)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{TYPES[kind]}", data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def page(data: bytes, tags: dict[int, tuple[int, ...]], number: int, order: str) -> Page:
    one = lambda tag, default=None: tags[tag][0] if default is None else tags.get(tag, (default,))[0]
    w, h, s = one(IMAGE_WIDTH), one(IMAGE_LENGTH), one(SAMPLES_PER_PIXEL, 1)
    codec, predictor, bits = one(COMPRESSION, 1), one(PREDICTOR, 1), one(BITS, 1)
    if set(tags.get(BITS, (1,))) not in ({8}, {16}) or predictor not in (1, 2):
        raise ValueError(f"page {number}: {bits} bits, predictor {predictor}")
    kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
    tiled = TILE_OFFSETS in tags
    if tiled:
        cols, rows, offsets, sizes = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        cols, rows, offsets, sizes = w, min(h, one(ROWS_PER_STRIP, h)), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if not all((w, h, s, cols, rows)):
        raise ValueError(f"page {number}: a size is 0")
    if max(h * w * s, rows * cols) * kind.itemsize > EXPANDS * sum(sizes):
        raise ValueError(f"page {number}: larger than its strips or tiles can make it")
    planes = s if one(PLANAR, 1) == 2 else 1
    depth = s // planes
    out = np.zeros((h, w, s), np.dtype(f"u{bits // 8}"))
    across, down = -(-w // cols), -(-h // rows)
    if len(offsets) < across * down * planes:
        raise ValueError(f"page {number}: too few strips or tiles")
    for i in range(across * down * planes):
        plane, place = divmod(i, across * down)
        y, x = place // across * rows, place % across * cols
        tall = rows if tiled else min(rows, h - y)
        raw = decompress(data[offsets[i] : offsets[i] + sizes[i]], codec, tall * cols * depth * kind.itemsize)
        part = np.frombuffer(raw, kind, count=min(len(raw) // kind.itemsize, tall * cols * depth))
        if len(part) < tall * cols * depth:
            raise ValueError(f"page {number}: strip or tile {i} is short")
        part = part.astype(out.dtype).reshape(tall, cols, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        high, wide = min(tall, h - y), min(cols, w - x)
        out[y : y + high, x : x + wide, plane * depth : (plane + 1) * depth] = part[:high, :wide]
    return Page(number, codec, predictor, tiled, out)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, payload binary, error string"


def tiff_pages(media: DataFrame, media_col: str = "media", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per page: ``keep`` columns, the page's form, and its samples in ``payload``."""
    src = media.select(*[F.col(c) for c in keep], F.col(media_col).alias(free_name(keep, "__media")))
    schema = T.StructType([*src.schema.fields[:-1], *T._parse_datatype_string(PAGE_SCHEMA).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(b.num_columns - 1)[i].as_py()
                if data is None:
                    continue
                rows, fault = [], None
                try:
                    for p in read_pages(data):
                        h, w, s = p.samples.shape
                        rows.append((p.number, w, h, s, p.samples.dtype.itemsize * 8, p.compression, p.predictor, p.tiled, p.samples.tobytes(), None))
                except ValueError as e:
                    fault = str(e)
                if fault is not None:
                    rows.append((len(rows), *[None] * 8, fault))
                at = pa.array([i] * len(rows), pa.int32())
                kept = [c.take(at) for c in b.columns[:-1]]
                if rows:
                    arrow = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
                    cols = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept, *cols], names=schema.names)

    return src.mapInArrow(run, schema)


def payload(text: str) -> bytes:
    data = text.encode()
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def to_tiff(data: bytes) -> bytes:
    """The stored form of a payload; equal payloads give equal files. Its checksum chooses codec, and strips or tiles, whatever its size."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH, SAMPLES)
    choice = zlib.crc32(data)
    codec = (DEFLATE, LZW, PACKBITS)[choice % 3]
    tile = TILE if choice // 3 % 2 else None
    height = tile[0] if tile else PAGE_ROWS
    pages = [rows[i : i + height] for i in range(0, len(rows), height)]
    return write_tiff(pages, codec, predictor=codec != PACKBITS, tile=tile, strip_rows=PAGE_ROWS)


def from_tiff(media: bytes) -> tuple[bytes, str]:
    """The payload read back, and the feature: pages, size, mean and deviation of samples, share of each of 8 levels."""
    pages = list(read_pages(media))
    data = b"".join(p.samples.tobytes() for p in pages)
    x = np.frombuffer(data, np.uint8)
    levels = np.bincount(x >> 5, minlength=8) / len(x)
    feature = f"{len(pages)}x{WIDTH}x{len(x) // BLOCK}x{SAMPLES};{x.mean():.4f};{x.std():.4f};" + ",".join(f"{v:.4f}" for v in levels)
    return data, feature


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as TIFF: digests of the payload read back and of the file, and the feature."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["id", *schema.replace(",", "").split()[2::2]]

    def digests(text: str) -> tuple:
        media = to_tiff(payload(text))
        data, feature = from_tiff(media)
        return len(text.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = zip(*map(digests, b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(rows, kinds, strict=True))], names=names)

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
