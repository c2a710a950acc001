import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with operators' own."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None, None, None), (None, "alpha beta gamma", "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "b"), (4, long, "de", "a"), (5, long, "de", None), (6, "12 34 ++", "fr", "b"), (6, "12 34 ++", "fr", "b"), (7, "one two\none two\r\nthree", "en", ""), (None, None, None, None)]
    rows = [(*r, 9, "x", 0.5, "k", None) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, score string, n_words double, key string, spans string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
