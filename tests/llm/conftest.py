"""Rows that every operator must survive."""

import pytest

LONG = "alpha beta gamma delta " * 30_000

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, ids string, component_id string, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with clashing names."""
    extra = (0.5, "x", None, "y", "z")
    rows = [
        (1, None, None, None, None, *extra), (2, "", "en", "s", 0, *extra), (3, " \n\t ", "de", "s", 3, *extra),
        (4, LONG, "en", None, len(LONG), *extra), (5, "one two three", "en", "s", 13, *extra), (5, "one two three", "en", "s", 13, *extra),
        (6, "Ünïcödé 日本語 😀 text", "xx", "s", 20, *extra), (None, "a text without an id at all, of some length", "en", "s", 9, *extra),
        (None, None, None, None, None, None, None, None, None, None), (7, "a\u0000b \ud7ff", "en", "s", 4, *extra), (8, "12 34 !!! ???", None, "s", 13, *extra),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, None), (None, 0, 0), (99, None, 1), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
