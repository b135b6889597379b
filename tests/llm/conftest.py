from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, fp long, score double, `key` int, copies int"


def doc_rows(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7, 0.5, 1, 3) for i, t, s in rows], DOCS)


LONG = "lorem ipsum dolor sit amet consectetur " * 6000
EDGES = [
    (1, None, "a"), (2, "", "a"), (3, "same text here now ok", "a"), (4, "same text here now ok", None), (5, "same text here now ok", "b"), (5, "same text here now ok", "b"),
    (6, LONG, "b"), (7, LONG + " end", None), (None, "no id", "c"), (None, None, None), (8, " \t\n", "c"), (9, "x", "c"), (10, "Ünïcode 日本語 𝒳 text — “quotes”", "c"), (-3, "negative id", "c"), (11, "same text here now ok", "a"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return doc_rows(spark, EDGES)


@pytest.fixture(scope="session")
def no_docs(spark):
    return doc_rows(spark, EDGES).limit(0)
