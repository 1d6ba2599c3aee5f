from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, and columns whose names clash."""
    long = " ".join(f"wort{i % 997} then" for i in range(60_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n ", "de", None, 3), (4, long, "en", "a", len(long)),
        (5, "the same text here is found twice", "en", "a", 1), (6, "the same text here is found twice", "de", "b", 1),
        (6, "the same text here is found twice", "de", "b", 1), (None, "no id has this text", "en", "a", 1), (7, "123 456 %%% !!", "en", "a", 9),
        (8, "été ça 日本語 🙂 naïve", "fr", "c", 2), (9, "|" * 2000, "en", "c", 2),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("words", "key", "n", "shard", "p", "host", "fp", "_w", "digest")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
