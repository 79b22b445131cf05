from __future__ import annotations

import pytest

#: Columns beyond those of documents, with names the operators use inside.
EXTRA = "key string, digest string, _row string, size long, bands string, part int, node long, score double"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"

LONG = " ".join(f"word{i % 9973}x{i}" for i in range(60_000))


def document(doc_id, text, source="a"):
    return (doc_id, text, None, source, None, "k", None, "r", 1, None, 3, None, 0.5)


TRICKY = [
    document(1, None),
    document(2, ""),
    document(3, " \t\n "),
    document(4, "one two three four five six seven"),
    document(4, "one two three four five six seven"),
    document(5, "one  two three\tfour five six seven", None),
    document(None, "one two three four five six seven", "b"),
    document(None, None, None),
    document(6, LONG, "b"),
    document(7, LONG + " tail", "c"),
    document(8, "short"),
    document(9, "short text", "é"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    return spark.createDataFrame(TRICKY, DOCUMENTS).repartition(3).checkpoint()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    """The given documents, and their texts by id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
