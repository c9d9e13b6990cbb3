"""What large joins move and write: findings F1 to F17 of round 3."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from starcart import registry
from starcart.operators import basket, customer, product, recommend
from starcart.plans import layout, warehouse
from starcart.plans.pair_refresh import PairMart
from starcart.plans.warehouse import warehouse_star
from tests.paths import SF_SMALL


@pytest.fixture
def fresh(spark, monkeypatch):
    """A star of which nothing is written yet."""
    monkeypatch.setattr(warehouse, "_BUILT", {})
    monkeypatch.setattr(warehouse, "_STARS", {})
    monkeypatch.setattr(layout, "_TABLES", {})
    return warehouse_star(spark, SF_SMALL)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    qe = df._jdf.queryExecution()
    qe.executedPlan().execute().count()
    return qe.executedPlan().toString()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", ["customer_spending_quartiles", "top_n_products", "recommendation_top4", "recommendation_top4_floor",
                                  "rec_missing_sparse", "product_pairs_incremental", "product_pairs_bucketed"])
def test_one_pass_queries_do_not_write_the_fact(spark, fresh, name):
    assert registry.queries()[name](spark, SF_SMALL).take(1)
    assert not [k for k in warehouse._BUILT if k[1].endswith("fact_order_line")]


def test_lines_are_the_fact(fresh):
    lazy = fresh.lines
    assert lazy.exceptAll(fresh.fact).count() == 0 and fresh.fact.exceptAll(lazy).count() == 0
    assert "lineitem" not in str(fresh.lines.inputFiles())  # written by now


def test_the_fact_is_written_without_another_shuffle(spark, fresh, monkeypatch):
    monkeypatch.setattr(warehouse, "write_table", lambda df, path: pytest.fail("rebalanced") if "fact" in path else df.write.parquet(path))
    assert fresh.fact.count() > 0


def test_self_join_has_one_exchange(spark):
    draw = random.Random(3)
    items = spark.createDataFrame(
        [(f"o{draw.randrange(40)}", draw.randrange(30), 1 + draw.randrange(2)) for _ in range(300)], "order_id string, product_key long, n_dates long"
    ).dropDuplicates(["order_id", "product_key"]).withColumn("last_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("product_key").cast("int")))
    items = items.unionByName(items.limit(1).select(F.lit(None).cast("string").alias("order_id"), "product_key", "n_dates", "last_date")).localCheckpoint()
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        pairs = basket.pair_rows_of_orders(items)
        assert "ReusedExchange" in final_plan(pairs).split("Initial Plan")[0]
    finally:
        spark.conf.set(conf, before)
    assert rows_of(pairs, *pairs.columns) == rows_of(basket.pair_rows(items), *pairs.columns)


def test_mart_of_ordinary_orders_joins_once(fresh, monkeypatch):
    monkeypatch.setattr(recommend, "pair_rows", lambda **kw: pytest.fail("blocked join"))
    got = recommend.copurchase_pairs(fresh)
    want = basket.product_pairs(fresh)
    assert rows_of(got, *got.columns) == rows_of(want, *got.columns)


def test_pairs_are_mirrored_after_the_joins(fresh):
    got = recommend.directed_candidates(fresh, broadcast_rows=0)
    assert "Generate inline" in plan(got)
    want = recommend.directed_candidates(fresh).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    scores = recommend.recommendation_scores(fresh, broadcast_rows=0)
    assert scores.exceptAll(recommend.recommendation_scores(fresh)).count() == 0


def test_products_listed_twice_fan_out_alike(spark, fresh):
    twice = fresh.product.unionByName(fresh.product.where("product_key % 3 = 0").withColumn("is_active", ~F.col("is_active")))
    star = type(fresh).__mro__[1](fresh.date, fresh.customer, fresh.category, twice, fresh.payment, fresh.shipping, fresh.lines)
    got = recommend.directed_candidates(star, broadcast_rows=0)
    want = recommend.directed_candidates(star).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_top_products_take_the_lines_of_few(fresh):
    got = product.top_n_products(fresh, 15)
    want = product.top_products_by_revenue(fresh).orderBy(F.desc("product_revenue"), "product_key").limit(15)
    assert rows_of(got, *got.columns) == rows_of(want, *got.columns)
    assert "l_partkey#" in plan(got) and ("In(l_partkey, " in plan(got) or "INSET" in plan(got))


def test_products_lie_in_the_buckets_of_the_lines(spark, fresh):
    got = layout.bucketed_products(fresh)
    want = basket.order_products(fresh)
    assert rows_of(got, *want.columns) == rows_of(want, *want.columns)
    buckets = [spark.sql(f"DESCRIBE EXTENDED {t}").where("col_name = 'Num Buckets'").first()[1] for t in layout._TABLES.values()]
    assert len(buckets) == 2 and len(set(buckets)) == 1


def test_items_of_one_batch_are_read_as_they_are(spark, fresh, tmp_path):
    mart = PairMart(spark, str(tmp_path / "mart"))
    mart.add(fresh, fresh.lines.select("order_id", "product_key", "date_key"))
    assert "Aggregate" not in plan(mart.items())
    want = basket.order_products(fresh)
    assert rows_of(mart.items(), *want.columns) == rows_of(want, *want.columns)


def test_quartiles_from_lazy_lines(fresh):
    lazy = rows_of(customer.customer_spending_quartiles(fresh), "customer_key", "lifetime_revenue", "spending_quartile")
    whole = type(fresh).__mro__[1](fresh.date, fresh.customer, fresh.category, fresh.product, fresh.payment, fresh.shipping, fresh.fact)
    assert lazy == rows_of(customer.customer_spending_quartiles(whole), "customer_key", "lifetime_revenue", "spending_quartile")


def test_ranked_rows_carry_neither_the_shown_score_nor_the_global_maxima(spark, fresh):
    """Both can be had after the rows have moved."""
    ranked = recommend._rank_top_k(recommend.scored_pairs(fresh), 4)
    assert "recommendation_score" not in ranked.columns
    lines = ranked._jdf.queryExecution().optimizedPlan().toString().splitlines()
    with_maxima = next(i for i, line in enumerate(lines) if "Join Inner" in line and "_salt" in line)
    assert not [line for line in lines[with_maxima:] if "_glob" in line]
