"""The distributed row number / NTILE / DENSE_RANK equal Spark's one-partition windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starcart.functions.ranking import dense_rank_desc, global_row_number, ntile


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    # Heavy ties: a third of the rows share one value.
    rows = [(k, 0 if k % 3 == 0 else rnd.randint(0, 400)) for k in range(1, 1501)]
    return spark.createDataFrame(rows, "k long, v long").repartition(6)


def collect(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("parts", [None, 1, 4, 13])
def test_row_number(data, parts):
    order = [F.col("v").desc(), F.col("k").asc()]
    ours = global_row_number(data, order, "rn", "n", num_partitions=parts)
    ref = data.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    assert collect(ours, "k", "rn") == collect(ref, "k", "rn")
    assert {r.n for r in ours.select("n").distinct().collect()} == {1500}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 39, 1500])
def test_ntile(spark, data, size):
    df = data.where(F.col("k") <= size)
    order = [F.col("v").desc(), F.col("k").asc()]
    ours = ntile(df, order, 4, "q", num_partitions=5)
    ref = df.withColumn("q", F.ntile(4).over(Window.orderBy(*order)))
    assert collect(ours, "k", "q") == collect(ref, "k", "q")


def test_dense_rank(data):
    ours = dense_rank_desc(data, "v", "r", num_partitions=7)
    ref = data.withColumn("r", F.dense_rank().over(Window.orderBy(F.col("v").desc())))
    assert collect(ours, "k", "r") == collect(ref, "k", "r")


def test_empty(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert ntile(df, [F.col("v").desc(), F.col("k")], 4, "q").count() == 0
