"""Small tables that hold the awkward cases: nulls, empty and long texts, repeats, odd columns."""

import random

import duckdb
import pytest

AWKWARD_SCHEMA = "doc_id long, text string, score double, `_a` long, n_chars long, lang string"


@pytest.fixture(scope="session")
def documents(sf_dir):
    """(doc_id, text) of the test table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="session")
def awkward_rows(documents):
    words = [w for _, t in documents[:40] for w in t.split()]
    long_text = " ".join(random.Random(3).choices(words, k=60_000))
    near = " ".join(words[:120])
    texts = [
        (0, documents[0][1]), (0, documents[0][1]),  # a repeated row
        (0, documents[1][1]),  # a repeated id
        (None, documents[2][1]), (None, None), (5, None), (6, ""), (7, ""), (8, "   \n "),
        (9, "!!! ???"), (10, "!!! ???"), (11, "word"), (12, "Word."), (13, "two words"),
        (14, long_text), (15, near), (16, near + " and one more"), (17, "x" * 5000),
        (18, "日本語 текст ñandú \U0001F600 é"), (19, near.upper()),
    ]
    return [(i, t, 0.5, 1, None if t is None else len(t), None) for i, t in texts]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, AWKWARD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], AWKWARD_SCHEMA)
