from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, _norm string, kept string, score double, size int, h string, label string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text) or (doc_id, text, source); further columns have names that operators use."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 1, "x", "y", 2.0, 3, "z", "q") for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty, white, repeated and long rows."""
    return docs((1, None, None), (2, ""), (3, " \n\t "), (None, "Hello world again", None), (5, "Hello world again"), (5, "Hello world again"), (6, "word " * 30_000), (7, "Ωmega ☃ 漢字"), (8, "x" * 5000), (None, None))
