"""NTILE by cut rows, the split join of hot keys and the pruned top-4, against their plain forms."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starcart.functions.selection import ntile_by_cuts
from starcart.functions.skew import hot_keys, split_join
from starcart.operators import customer, recommend
from starcart.plans.warehouse import warehouse_star
from tests.paths import SF_SMALL


@pytest.fixture(scope="module")
def star(spark):
    return warehouse_star(spark, SF_SMALL)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- cut rows -----------------------------------------------------------------------------


def money(n, seed):
    rng = random.Random(seed)
    # A third of the rows share one value; some have none; some are far out.
    values = [Decimal("7.25"), Decimal("7.25"), None, Decimal("-99999999999.99"), Decimal("88888888888888.01")]
    return [(k, rng.choice(values) if rng.random() < 0.5 else Decimal(rng.randint(-500, 500)) / 100) for k in sorted({rng.randint(-(2**62), 2**62) for _ in range(n)})]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 41, 400])
@pytest.mark.parametrize("k,bins", [(4, 4096), (7, 2)])
def test_cuts_equal_the_window(spark, n, k, bins):
    if bins == 2 and n not in (3, 41):
        pytest.skip("many passes")
    df = spark.createDataFrame(money(n, n), "k long, v decimal(20,2)").repartition(3)
    got = ntile_by_cuts(df, "v", "k", k, "q", bins)
    want = df.withColumn("q", F.ntile(k).over(Window.orderBy(F.col("v").desc_nulls_last(), "k")))
    assert got.columns == want.columns and rows_of(got, "k", "v", "q") == rows_of(want, "k", "v", "q")


def test_quartiles_by_cuts(star):
    got, want = customer.spending_quartiles_by_cuts(star), customer.customer_spending_quartiles(star)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    shape = plan(got)
    assert "Exchange" not in shape and "Window" not in shape and "Sort" not in shape


# --- hot keys -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    rows = [(1 if i % 3 == 0 else None if i % 50 == 1 else rng.randint(2, 4000), i) for i in range(30_000)]
    return spark.createDataFrame(rows, "k long, i long").repartition(8)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_the_join(spark, pairs, how):
    small = spark.createDataFrame([(k, f"p{k}") for k in range(1, 3500)] + [(9, "again"), (None, "none")], "k long, name string")
    hot = hot_keys(pairs, "k", share=1 / 100)
    assert hot == [1]
    want = rows_of(pairs.join(small, "k", how), "k", "i", "name")
    for some in (hot, [], [1, 2, 3, 3999]):
        assert rows_of(split_join(pairs, small, "k", some, how), "k", "i", "name") == want


def test_no_task_holds_the_hot_key(spark, pairs):
    """With the hot key apart, the shuffled rows are dealt evenly."""
    hot = hot_keys(pairs, "k", share=1 / 100)
    dealt = pairs.where(~F.coalesce(F.col("k").isin(hot), F.lit(True))).repartition(8, "k").groupBy(F.spark_partition_id()).count()
    sizes = sorted(r["count"] for r in dealt.collect())
    assert len(sizes) == 8 and sizes[-1] <= 4 * sizes[len(sizes) // 2]
    whole = sorted(r["count"] for r in pairs.repartition(8, "k").groupBy(F.spark_partition_id()).count().collect())
    assert whole[-1] > 4 * whole[len(whole) // 2]


def test_hot_keys_of_nothing(spark):
    empty = spark.createDataFrame([], "k long")
    assert hot_keys(empty, "k") == [] and hot_keys(spark.range(3).select(F.lit(None).cast("long").alias("k")), "k") == []
    assert split_join(empty, spark.range(3).select(F.col("id").alias("k")), "k", []).count() == 0


@pytest.mark.parametrize("share", [1 / 4096, 1 / 50])
def test_candidates_by_split_join(spark, star, share, monkeypatch):
    monkeypatch.setattr(recommend, "hot_keys", lambda df, key: hot_keys(df, key, share=share))
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        got = recommend.directed_candidates(star, broadcast_rows=0)
        want = recommend.directed_candidates(star).select(*got.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.conf.set(conf, before)


# --- score bounds ---------------------------------------------------------------------------


@pytest.mark.parametrize("extra", [{}, {"weights": {"category": -0.3}}, {"collation": "UNICODE_CI_AI"}, {"min_hot_rows": 5, "salt_budget": 100_000}])
def test_pruned_top4(star, extra):
    want = recommend.recommendation_top4(star, **extra)
    got = recommend.recommendation_top4(star, prune=recommend.TOP_K, **extra)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_pairs_are_pruned_before_the_categories(star):
    left, every = (recommend.scored_pairs(star, prune=p).count() for p in (recommend.TOP_K, 0))
    sources = recommend.source_stats(star).count()
    assert sources < left < every / 2, (left, every)
