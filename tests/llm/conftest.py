from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties."""
    rows = [
        (1, "one two three four five six seven", "a", "en"),
        (1, "one two three four five six seven", "a", "en"),
        (2, None, None, None),
        (3, "", "b", None),
        (None, "one two three four five six seven", "a", "en"),
        (4, "word " * 30_000, "b", "en"),
        (5, "x" * 5_000, None, "en"),
        (6, "a\nb\nc\nd\na\nb\nc\nd", "a", "en"),
        (7, "ümlaut ñ 漢字 🙂 <|endoftext|> </s>", "a", "de"),
        (8, "   ", "c", "en"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
