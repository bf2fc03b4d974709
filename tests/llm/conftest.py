"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import pytest

LINE = "the quick brown fox jumps over the lazy dog while nine small birds look on from a tall old tree"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, repeated and null ids, and columns with clashing names."""
    long = " ".join(f"word{i % 700} other{i % 13}" for i in range(30_000))
    rows = [
        (1, LINE, "en", "a", 95),
        (2, LINE, "en", "a", 95),
        (2, LINE, "en", "a", 95),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, long, "en", "b", len(long)),
        (7, "one", "en", None, 3),
        (None, LINE, "en", "b", 95),
        (8, LINE + " and one more", None, "b", 108),
        (9, LINE.replace("dog", "cat").upper(), "en", "b", 95),
        (10, "été ß 你好 <|endoftext|> it's 12a", "fr", "c", 30),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    clashing = "n_tokens string, n_words string, items string, spans string, language string, kind string, target string, node string, salt string, rank string, score string"
    extra = [f"x{i}" for i in range(len(clashing.split(",")))]
    return spark.createDataFrame([(*row, *extra) for row in rows], f"{names}, {clashing}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
