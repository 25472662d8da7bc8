from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    """(doc_id, text) of the smallest table; null texts as empty ones."""
    return [(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, and columns whose names clash with results."""
    rows = [(None, "un deux trois", "x", 1), (None, None, "x", 1), (2, None, "y", 2), (3, "", "y", 3), (4, " \t\n", "y", 4), (5, "a b c d e f g h i j k l m n", "z", 5), (5, "a b c d e f g h i j k l m n", "z", 5), (6, "a b c d e f g h i j k l m n", "z", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score int").selectExpr("*", "'en' as lang", "'s' as source", "cast(score as long) as n_chars", "'q' as class_id", "'r' as node", "'b' as bucket", "'k' as kept")
