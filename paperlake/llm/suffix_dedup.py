"""Operator 9, suffix-array dedup of repeated byte strings.

A byte goes if a string of ``length`` (200) bytes that covers it also starts
anywhere else, in its own document or another.

1. *Anchors.* Every 64-byte gram is hashed; the smallest of each 200-byte window
   (the last, if several are equal) is its anchor. Equal windows hold the same anchor at
   the same offset, so a window whose anchor is unique in the corpus is
   unique: nothing is lost, and most text is left out of what follows. An
   anchor carries the digest of its context, the bytes that its windows cover.
2. *Counts.* Equal (anchor, context) pairs are combined in the scan first.
   A context that occurs twice is repeated as a whole. An anchor with several
   contexts goes on, one occurrence of each context.
3. *Shards.* Contexts are dealt to shards by anchor; an anchor with more than
   ``HOT`` contexts is spread over several. Each shard sorts its suffixes by
   Larsson-Sadakane refinement in numpy (ranks double or triple their depth, only groups
   that aren't settled are sorted again), takes common prefixes by Kasai's rule,
   and marks windows that start at the same offset of two contexts.
4. *Merge.* Spread anchors are merged across shards: their windows as sorted
   digests, cut into ranges by binary search, and looked up in the ranges of all
   shards by binary search.
5. Marks return to the documents, and the union of marked windows is removed.

Defined results: null and empty texts have no bytes; texts below 200 bytes stay;
two rows with equal id and text are two documents (so both lose what they
share); rows with null ids take part; extra columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import materialize, row_key

LENGTH = 200
GRAM = 64
#: Contexts of one anchor that one shard holds, and of one shard on average.
HOT = 16_384
SHARD = 4_096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OCC = np.dtype([("key", "<i8"), ("pos", "<i4"), ("lo", "<i2"), ("hi", "<i2")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` bytes, built by doubling: h(2k)[i] from h(k)[i] and h(k)[i + k]."""
    h, have = data.astype(np.uint64) + np.uint64(1), 1
    while have < width:
        step = min(have, width - have)
        n = len(h) - step
        h = h[:n] * _BASE + (h[step : step + n] ^ (h[step : step + n] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        have += step
    return _mix(h)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of grams that are the (last) smallest of a window of ``length`` bytes, and the stretch those windows cover.

    A window belongs to one anchor. The anchors of successive windows never go
    back, so each anchor's windows are successive too.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, np.zeros(0, np.uint64), none, none
    h = gram_hashes(data, gram)
    w = length - gram + 1
    low = _sliding(h, w, np.minimum)
    # the largest of the minima of the windows that hold a gram equals it, if it is one of them
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, w, np.maximum) == h)

    def owner(starts: np.ndarray) -> np.ndarray:
        """Of windows, the place in ``at`` of the last gram that equals their minimum."""
        k = np.searchsorted(at, starts + (w - 1), "right") - 1
        while len(wrong := np.flatnonzero(h[at[k]] != low[starts])):
            k[wrong] -= 1
        return k

    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(low) - 1]])
    k, end = owner(first), owner(last)
    if len(mixed := np.flatnonzero(k != end)):  # one gram several times in a run of equal minima
        more = np.concatenate([np.arange(first[i], last[i] + 1) for i in mixed.tolist()])
        keep = np.setdiff1d(np.arange(len(first)), mixed)
        k = np.concatenate([k[keep], owner(more)])
        first, last = np.concatenate([first[keep], more]), np.concatenate([last[keep], more])
        by = np.argsort(first)
        k, first, last = k[by], first[by], last[by]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    ends = np.concatenate([new[1:] - 1, [len(k) - 1]])
    at = at[k[new]]
    return at, h[at], first[new], last[ends] + length


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Suffixes in order, all of them settled (Kasai's rule needs that).

    First by seven bytes at once; then ranks of suffixes ``h`` (and twice ``h``)
    further on refine the groups that aren't settled, and ``h`` doubles (triples).
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # seven bytes in base 512 fill a word
        key = key << np.uint64(9) | padded[i : i + n]
    order = np.argsort(key)
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    heads = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = heads[np.cumsum(first) - 1]
    h, folds = 7, 3 if n + 2 < 1 << 21 else 2  # three ranks fit a word if the shard is small enough
    while True:
        sizes = np.diff(np.concatenate([heads, [n]]))
        open_heads, open_sizes = heads[sizes > 1], sizes[sizes > 1]
        if not len(open_heads):
            break
        places = np.repeat(open_heads - np.cumsum(np.concatenate([[0], open_sizes[:-1]])), open_sizes) + np.arange(open_sizes.sum())
        suffix = order[places]
        pair = rank[suffix]
        for k in range(1, folds):
            beyond = suffix + k * h
            pair = pair * np.int64(n + 2) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.argsort(pair)
        order[places] = suffix[by]
        pair = pair[by]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        fresh = places[new]
        rank[order[places]] = fresh[np.cumsum(new) - 1]
        first[fresh] = True
        heads = np.flatnonzero(first)
        h *= folds
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int, lanes: int = 64) -> np.ndarray:
    """For each place in ``order`` the prefix shared with the one before, up to ``limit``.

    Kasai's rule: a suffix shares at least one byte less with its predecessor
    than the suffix that begins one byte earlier. Lanes of positions ``lanes``
    apart are walked in step; the first of each is compared from the start.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    # the end differs from every byte and from itself
    pad = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(limit + 16, np.uint64)])
    seven = pad[: n + limit + 8].copy()
    for i in range(1, 7):
        seven = seven << np.uint64(9) | pad[i : i + n + limit + 8]
    for lane in range(lanes):
        at = np.arange(lane, n, lanes)
        at = at[before[at] >= 0]
        got = np.maximum(shared[at - 1] - 1, 0) if lane else np.zeros(len(at), np.int64)
        for width, words in ((7, seven), (1, pad)):  # seven bytes at a time, then what is left
            live = np.flatnonzero(got < limit)
            p, q, g = at[live], before[at[live]], got[live]
            while len(live):
                ok = (words[p + g] == words[q + g]) & (np.maximum(p, q) + g + width <= n) & (g < limit)
                live, p, q, g = live[ok], p[ok], q[ok], g[ok] + width
                got[live] = g
        shared[at] = np.minimum(got, limit)
    return shared[order]


def repeated_starts(texts: list[bytes], offsets: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context the starts of windows that another context holds at the same offset from its anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    local = np.arange(len(data)) - base[owner]
    order = suffix_order(data)
    shared = common_prefixes(data, order, length)
    group = np.cumsum(shared < length)  # suffixes that share ``length`` bytes
    fits = (local + length <= sizes[owner])[order]
    place, group = order[fits], group[fits]
    offset = local[place] - np.asarray(offsets)[owner[place]]
    by = np.lexsort((offset, group))
    g, o = group[by], offset[by]
    same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    hit = np.sort(place[by][twice])
    return np.split(local[hit], np.searchsorted(hit, base[1:-1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of texts; equal (gram, context) of a batch in one row, with their occurrences packed."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1024):
            batch = whole.slice(i, 1024)
            grams, digests, found = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                at, h, start, end = anchors(np.frombuffer(raw, np.uint8))
                if not len(at):
                    continue
                grams.append(h)
                occ = np.empty(len(at), _OCC)
                occ["key"], occ["pos"], occ["lo"], occ["hi"] = key, at, at - start, end - at
                found.append(occ)
                for p, a, b in zip(at.tolist(), start.tolist(), end.tolist(), strict=True):
                    digests.append(hashlib.blake2b(raw[a:b], digest_size=8, salt=(p - a).to_bytes(2, "little")).digest())
            if not grams:
                continue
            g = np.concatenate(grams).astype(np.int64)
            c = np.frombuffer(b"".join(digests), np.int64)
            occ = np.concatenate(found)
            by = np.lexsort((c, g))
            g, c, packed = g[by], c[by], occ[by].tobytes()
            head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
            ends = np.concatenate([head, [len(g)]]).astype(np.int32) * _OCC.itemsize
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[head]), pa.array(c[head]), pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(packed)])],
                names=["g", "c", "occ"],
            )


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row an occurrence; ``lead`` on the first of a context that must be compared."""
    for b in batches:
        size = b.occ.map(len).to_numpy() // _OCC.itemsize
        occ = np.frombuffer(b"".join(b.occ), _OCC)
        rows = np.repeat(np.arange(len(b)), size)
        lead = np.zeros(len(occ), bool)
        lead[np.concatenate([[0], np.cumsum(size)[:-1]]).astype(int)] = b.lead.to_numpy()
        yield pd.DataFrame({"key": occ["key"], "pos": occ["pos"], "lo": occ["lo"].astype(np.int32), "hi": occ["hi"].astype(np.int32), "g": b.g.to_numpy()[rows], "c": b.c.to_numpy()[rows], "whole": b.whole.to_numpy()[rows], "several": b.several.to_numpy()[rows], "lead": lead, "parts": b.parts.to_numpy()[rows]})


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes around leading occurrences."""
    for b in batches:
        rows = []
        for text, places in zip(b.text, b.places, strict=True):
            raw = text.encode()
            for x in places:
                rows.append((x["g"], x["c"], x["parts"], x["lo"], raw[x["pos"] - x["lo"] : x["pos"] + x["hi"]]))
        yield pd.DataFrame(rows, columns=["g", "c", "parts", "at", "bytes"])


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Suffix array of a shard; repeated windows of each context as offsets from the anchor, and all windows of spread anchors."""
    texts, anchor = list(pdf.bytes), pdf["at"].to_numpy()
    found = repeated_starts(texts, anchor)
    rows = []
    for g, c, parts, at, data, hit in zip(pdf.g, pdf.c, pdf.parts, anchor, texts, found, strict=True):
        left = b""
        if parts > 1:
            raw = np.frombuffer(data, np.uint8)
            starts = np.arange(len(raw) - LENGTH + 1)  # settled ones too: another shard may hold them once
            rec = np.empty(len(starts), _OPEN)
            rec["a"] = gram_hashes(raw, LENGTH)[starts]
            rec["b"] = gram_hashes(raw[::-1], LENGTH)[::-1][starts]
            rec["offset"] = starts - at
            left = rec.tobytes()
        rows.append((g, c, (hit - at).astype(np.int16).tobytes(), left))
    return pd.DataFrame(rows, columns=["g", "c", "hits", "open"])


#: A window by two 64-bit hashes (read forwards and backwards), and its offset from the anchor.
_OPEN = np.dtype([("a", "<u8"), ("b", "<u8"), ("offset", "<i2")])


def _cut(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Windows of a shard's spread contexts, sorted by digest and cut into 2 ** bits ranges by binary search; one row a range."""
    for b in batches:
        size = b.open.map(len).to_numpy() // _OPEN.itemsize
        rec = np.frombuffer(b"".join(b.open), _OPEN)
        top = rec["a"]
        by = np.argsort(top)
        owner = np.repeat(np.arange(len(b)), size)[by]
        edges = np.searchsorted(top[by], (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)))
        cuts = np.concatenate([[0], edges, [len(rec)]])
        g, c = b.g.to_numpy(), b.c.to_numpy()
        for r in range(1 << bits):
            s = slice(cuts[r], cuts[r + 1])
            if s.stop > s.start:
                yield pd.DataFrame({"range": [r], "g": [g[owner[s]].astype(np.int64).tobytes()], "c": [c[owner[s]].astype(np.int64).tobytes()], "open": [rec[by][s].tobytes()]})


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of one range that two or more shards hold: each shard's are looked up in the sorted ones of all."""
    rec = np.frombuffer(b"".join(pdf.open), _OPEN)
    key = _mix(rec["a"] + _mix(rec["b"] + rec["offset"].astype(np.uint64)))
    ordered = np.sort(key)
    hit = np.searchsorted(ordered, key, "right") - np.searchsorted(ordered, key, "left") > 1
    g, c = (np.frombuffer(b"".join(pdf[x]), np.int64)[hit] for x in ("g", "c"))
    by = np.lexsort((c, g))
    g, c, offset = g[by], c[by], rec["offset"][hit][by]
    head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])) if len(g) else np.zeros(0, int)
    return pd.DataFrame({"g": g[head], "c": c[head], "hits": [x.tobytes() for x in np.split(offset, head[1:])] if len(g) else []})


def _covered(size: int, places: list) -> np.ndarray:
    """Removed stretches [start, end) of a document of ``size`` bytes, joined where they overlap or touch."""
    if size < LENGTH or not len(places):
        return np.zeros((0, 2), np.int64)
    starts, ends = [], []
    for x in places:
        p = x["pos"]
        if x["whole"]:
            starts.append(np.array([p - x["lo"]]))
            ends.append(np.array([p + x["hi"]]))
        for hits in () if x["hits"] is None else x["hits"]:
            s = p + np.frombuffer(hits, np.int16).astype(np.int64)
            starts.append(s)
            ends.append(s + LENGTH)
    if not starts:
        return np.zeros((0, 2), np.int64)
    s, e = np.concatenate(starts), np.concatenate(ends)
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])
    return np.stack([s[new], e[last]], axis=1)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text, places in zip(b.text, b.places, strict=True):
            raw = text.encode()
            spans = _covered(len(raw), [] if places is None else places)
            edges = [0, *spans.ravel().tolist(), len(raw)]
            kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans.ravel().tolist()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        out.insert(0, "id", b.id.to_numpy())
        yield out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row; spans are flat byte offsets."""
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.select("key", "text").mapInArrow(_scan, "g long, c long, occ binary")
    n = (F.length("occ") / _OCC.itemsize).cast("long")
    gram, pair = Window.partitionBy("g"), Window.partitionBy("g", "c")
    counted = (
        found.withColumn("n", n)
        .withColumn("total", F.sum("n").over(gram))
        .where("total > 1")
        .withColumn("several", F.min("c").over(gram) != F.max("c").over(gram))
        .withColumn("same", F.sum("n").over(pair))
        .withColumn("nth", F.row_number().over(pair.orderBy("occ")))
        .withColumn("contexts", F.sum((F.col("nth") == 1).cast("long")).over(gram))
        .select(
            "g", "c", "occ", (F.col("same") > 1).alias("whole"), "several", (F.col("several") & (F.col("nth") == 1)).alias("lead"),
            F.ceil(F.col("contexts") / HOT).cast("int").alias("parts"),
        )
    )
    marks = materialize(
        counted.mapInPandas(_occurrences, "key long, pos int, lo int, hi int, g long, c long, whole boolean, several boolean, lead boolean, parts int"), "marks"
    )
    leads = marks.where("lead").groupBy("key").agg(F.collect_list(F.struct("g", "c", "parts", "pos", "lo", "hi")).alias("places"))
    n_leads = marks.where("lead").count()
    body = texts.select("key", "text")
    contexts = body.join(leads, "key").dropDuplicates(["key"]).select("text", "places").mapInPandas(_contexts, "g long, c long, parts int, at int, bytes binary")
    shards = max(1, -(-n_leads // SHARD))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("g", F.pmod("c", F.col("parts"))), F.lit(shards))).otherwise(F.pmod(F.xxhash64("g"), F.lit(shards)))
    sorted_shards = materialize(contexts.withColumn("shard", part).groupBy("shard").applyInPandas(lambda pdf: _shard(pdf), "g long, c long, hits binary, open binary"), "shards")
    spread = sorted_shards.where(F.length("open") > 0).select("g", "c", "open")
    bits = max(6, (shards - 1).bit_length())  # as many ranges as shards, so a range doesn't grow with the corpus
    merged = spread.mapInPandas(lambda batches: _cut(batches, bits), "range int, g binary, c binary, open binary").groupBy("range").applyInPandas(_merge, "g long, c long, hits binary")
    hits = sorted_shards.select("g", "c", "hits").where(F.length("hits") > 0).unionByName(merged).groupBy("g", "c").agg(F.collect_list("hits").alias("hits"))
    # a context that occurs twice is covered whole; only single ones need the shards' findings
    rest = marks.where("several and not whole").join(hits, ["g", "c"])
    cols = ["key", "pos", "lo", "hi", "whole"]
    none = F.lit(None).cast("array<binary>").alias("hits")
    places = (
        marks.where("whole").select(*cols, none).unionByName(rest.select(*cols, "hits")).groupBy("key").agg(F.collect_list(F.struct("pos", "lo", "hi", "whole", "hits")).alias("places"))
    )
    kind = docs.schema[id_col].dataType.simpleString()
    out = texts.join(places, "key", "left").select("id", "text", "places").mapInPandas(
        _finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>"
    )
    return out.withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return remove_repeats(docs, id_col, text_col).drop("spans")
