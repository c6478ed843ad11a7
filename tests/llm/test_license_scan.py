"""License scans: exact notices, small differences, numbers, odd rows."""

from __future__ import annotations

import pytest

from paperlake.llm import license_scan as S

FILLER = "Nothing of note is said in this line of prose, which goes on for a while without any legal words at all."


@pytest.mark.parametrize("name", sorted(S.TEMPLATES))
def test_each_template_is_found_in_prose(name):
    text = f"{FILLER}\n{S.TEMPLATES[name].replace('<year>', '2019').replace('<holder>', 'A. Person')}\n{FILLER}"
    found = [x["license"] for x in S.Scanner(S.TEMPLATES).scan(text)]
    assert name in found


def test_wording():
    scan = S.Scanner(S.TEMPLATES).scan
    names = lambda t: [x["license"] for x in scan(t)]
    assert names("Licensed under CC BY-NC 4.0. " + FILLER) == ["CC-BY-NC-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("I have a driving license and permission to park.") == []
    one_word = S.TEMPLATES["MIT-text"].replace("any person obtaining", "any individual obtaining")
    assert [(x["license"], x["differing_words"]) for x in scan(one_word)] == [("MIT-text", 2)]
    assert names("Line\n" * 50 + "Released under the MIT License.\n" + "Line\n" * 500) == ["MIT"]


def test_operator(spark, odd_docs, no_docs):
    rows = S.digest(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.licenses for r in rows} == {""}
    df = spark.createDataFrame([(1, "Released under the MIT License.\nAll rights reserved."), (None, "All rights reserved.")], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in S.digest(df).collect()} == {1: "MIT,Proprietary", None: "Proprietary"}
    assert S.digest(no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(S.TEMPLATES))
def test_notices_may_be_wrapped_anywhere(spark, name):
    notice = S.TEMPLATES[name].replace("<year>", "2019").replace("<holder>", "A. Person").split()
    scan = S.Scanner(S.TEMPLATES).scan
    texts = []
    for i in range(1, len(notice)):
        texts.append(f"{FILLER}\n{' '.join(notice[:i])}\n{' '.join(notice[i:])}\n{FILLER}")
        assert name in [x["license"] for x in scan(texts[-1])], texts[-1]
    texts.append("\n  ".join(notice))
    rows = S.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(name in r.licenses.split(",") for r in rows)


def test_all_notices_of_one_line_are_found():
    names = sorted(S.TEMPLATES)
    text = " ".join(S.TEMPLATES[n].replace("<year>", "2019").replace("<holder>", "A. Person") for n in names)
    assert [x["license"] for x in S.Scanner(S.TEMPLATES).scan(text)] == names
    # long relatives save more bytes around the same trigger
    near = f"{S.TEMPLATES['GPL-3.0']} {S.TEMPLATES['GPL-2.0']} All rights reserved. {S.TEMPLATES['CC-BY-4.0-text']} {S.TEMPLATES['GPL-notice']}"
    assert {"GPL-3.0", "GPL-2.0", "Proprietary", "CC-BY-4.0-text", "GPL-notice"} <= {x["license"] for x in S.Scanner(S.TEMPLATES).scan(near)}
