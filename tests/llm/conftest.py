from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the real table."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))

# The rows every operator must take: nulls in any column, empty, blank and very long texts, ties and repeats.
EDGES = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (2, None), (None, "a null id"), (None, None), (None, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG + " end"), (2, "again two"),
    (7, "Ünïcode Wörter 日本 \U0001F600 end"), (8, "one"), (9, "one"), (10, "x  y\u00a0z \n q"),
]


@pytest.fixture
def edges(table):
    return table(EDGES)


@pytest.fixture
def edge_rows():
    return EDGES
