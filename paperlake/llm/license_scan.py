"""Operator 4, license scans by conditional compression.

Every template has words of ``TRIGGER``; they are sought in the whole text, with
white space (line feeds too) as one space, so notices may be wrapped anywhere.
The surroundings of each trigger are compressed alone and with each template as
a zstandard raw dictionary; templates that save too few bytes are out. All others
are laid over the text so that a trigger of theirs meets the one found, and
confirmed by their exact differences in wording: words of the template that are
missing, and words between its first and last matching word that it hasn't.
Placeholders (year, holder) are free; a difference in a number rejects.

Texts without a trigger never leave the JVM's filter; no row is shuffled.

Defined results: null and empty texts, and texts without a match, have an empty
list; rows with null or repeated ids are scanned like others; several licenses
in a text are listed each once, sorted; extra columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIGGER = r"(?i)licen[sc]e|copyright|permission|redistribut|rights\W+reserved|public\W+domain|spdx|without\W+warranty"
#: Share of a template's words that may differ; templates of under ten words must be met exactly.
SLACK = 0.1
#: Share of a template's own compressed size that it must save.
LEAST_GAIN = 0.25

# Wordings of common license notices. A word in angle brackets is a placeholder.
TEMPLATES = {
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX-GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-GPL-2.0-or-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "SPDX-GPL-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "SPDX-GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-LGPL-2.1": "SPDX-License-Identifier: LGPL-2.1",
    "SPDX-LGPL-3.0": "SPDX-License-Identifier: LGPL-3.0",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "SPDX-ISC": "SPDX-License-Identifier: ISC",
    "SPDX-CC-BY-4.0": "SPDX-License-Identifier: CC-BY-4.0",
    "SPDX-CC-BY-SA-4.0": "SPDX-License-Identifier: CC-BY-SA-4.0",
    "SPDX-CC0-1.0": "SPDX-License-Identifier: CC0-1.0",
    "SPDX-Unlicense": "SPDX-License-Identifier: Unlicense",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Licensed under the MIT license.",
    "MIT-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-heading": "GNU Lesser General Public License Version 3",
    "LGPL-2.1-heading": "GNU Lesser General Public License Version 2.1",
    "AGPL-3.0-heading": "GNU Affero General Public License Version 3",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
    "Copyright": "Copyright (c) <year> <holder>. All rights reserved.",
}


WORD = re.compile(r"<\w+>|[\w.+-]*\w")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def differences(template: list[str], block: list[str]) -> tuple[int, bool]:
    """Words that differ between the first and the last matching word, and whether a number is one of them."""
    found = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not found:
        return len(template), True
    # a stray word beside the notice may match: the first and the last place are those that leave the least differences
    each = [_differences(template, block, found[i:j]) for i in range(len(found)) for j in range(i + 1, len(found) + 1)]
    return min(each, key=lambda x: (x[1], x[0]))


def _differences(template: list[str], block: list[str], found: list) -> tuple[int, bool]:
    odd = template[: found[0].a] + template[found[-1].a + found[-1].size :]
    for x, y in zip(found, found[1:], strict=False):
        missing, extra = template[x.a + x.size : y.a], block[x.b + x.size : y.b]
        if missing and all(w.startswith("<") for w in missing):
            continue  # what stands in for placeholders is free
        odd += missing + extra
    odd = [w for w in odd if not w.startswith("<")]
    return len(odd), any(any(c.isdigit() for c in w) for w in odd)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard as zstd

        self.plain = zstd.ZstdCompressor(level=3)
        self.trigger = re.compile(TRIGGER)
        self.templates = []
        for name, text in templates.items():
            raw = zstd.ZstdCompressionDict(text.encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            want, anchors = self.tokens(text)
            self.templates.append((name, want, anchors, len(text.encode()), len(self.plain.compress(text.encode())), zstd.ZstdCompressor(level=3, dict_data=raw)))
        self.reach = max(len(t[1]) for t in self.templates) * 5 // 4 + 20
        self.memo: dict[tuple[str, int], list[tuple[str, int, int]]] = {}

    def tokens(self, text: str) -> tuple[list[str], list[int]]:
        """Words, and which of them the triggers begin in."""
        found = list(WORD.finditer(text))
        starts = [m.start() for m in found]
        return [m.group().lower() for m in found], [bisect_right(starts, m.start()) - 1 for m in self.trigger.finditer(text)]

    def blocks(self, text: str) -> Iterator[tuple[str, int]]:
        """The surroundings of each trigger, and its place in them."""
        text = " ".join(text.split())
        found = list(WORD.finditer(text))
        starts = [m.start() for m in found]
        wide, size = 2 * self.reach, max(t[3] for t in self.templates)
        for m in self.trigger.finditer(text):
            at, i = m.start(), bisect_right(starts, m.start()) - 1
            first, last = starts[max(0, i - wide)], found[min(len(found) - 1, i + wide)].end()
            first, last = min(first, max(0, at - size)), max(last, at + size)
            yield text[first:last], at - first

    def match(self, block: str, at: int) -> list[tuple[str, int, int]]:
        """Confirmed templates of the trigger at ``at``: name, bytes saved, words that differ."""
        if (block, at) in self.memo:
            return self.memo[block, at]
        likely = []
        for name, want, anchors, size, alone, packer in self.templates:
            # as wide as the template: a long block must not hide a short saving
            part = block[max(0, at - size) : at + size].encode()
            gain = len(self.plain.compress(part)) - len(packer.compress(part))
            if gain >= LEAST_GAIN * alone:
                likely.append((gain, name, want, anchors))
        out = []
        if likely:
            found = list(WORD.finditer(block))
            own, i = [m.group().lower() for m in found], bisect_right([m.start() for m in found], at) - 1
        for gain, name, want, anchors in likely:
            most = int(SLACK * len(want)) if len(want) >= 10 else 0
            free = lambda part: self.reach if any(w.startswith("<") for w in part) else most  # noqa: B023, E731
            each = [differences(want, own[max(0, i - k - free(want[:k])) : i + len(want) - k + free(want[k:])]) for k in anchors]
            fits = [n for n, numbers in each if not numbers and n <= most]
            if fits:
                out.append((name, gain, min(fits)))
        if len(self.memo) > 5_000:
            self.memo.clear()
        self.memo[block, at] = out
        return out

    def scan(self, text: str) -> list[dict]:
        best: dict[str, tuple[int, int]] = {}
        for block, at in self.blocks(text):
            for name, gain, n in self.match(block, at):
                best[name] = max(best.get(name, (gain, -n)), (gain, -n))
        return [{"license": k, "saved": g, "differing_words": -n} for k, (g, n) in sorted(best.items())]


@lru_cache(maxsize=2)
def _scanner(items: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(items))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``id_col, licenses array<struct<license, saved, differing_words>>`` of every row."""
    items = tuple((templates or TEMPLATES).items())
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).rlike(TRIGGER), F.col(text_col)).alias("text"))
    found = pa.list_(pa.struct([("license", pa.string()), ("saved", pa.int32()), ("differing_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(items)
        for b in batches:
            got = [[] if t is None else scanner.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, found)], names=["id", "licenses"])

    out = src.mapInArrow(run, f"id {kind}, licenses array<struct<license string, saved int, differing_words int>>")
    return out.withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: how many licenses, their names, and the largest number of differing words."""
    return scan(docs, id_col, text_col).select(
        id_col,
        F.size("licenses").cast("long").alias("n_licenses"),
        F.concat_ws(",", F.col("licenses.license")).alias("licenses"),
        F.coalesce(F.array_max("licenses.differing_words"), F.lit(0)).alias("differing_words"),
    )
