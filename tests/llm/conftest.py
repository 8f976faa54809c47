"""Tables with the awkward rows that every corpus operator must stand."""

import pytest

LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "The cat sat on the mat and saw the dog.", "en", 1, "x"), (2, None, "en", 2, "x"), (3, "", None, 3, None), (4, LONG, "en", 4, "x"), (5, LONG, "en", 5, "x"), (6, " \t\n", None, 6, "x"),
        (7, "12 34 ,.;", "fr", 7, "x"), (8, "The cat sat on the mat and saw the dog.", None, 8, "x"), (8, "The cat sat on the mat and saw the dog.", None, 8, "x"), (None, "no id here", "de", None, None), (9, "é ñ ü 中文 \U0001f600", "fr", 9, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, keep_id long, score string")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
