"""The reference's named views and dashboard SQL through spark.sql."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from micro import micro_star
from starcart.functions.ranking import assign_keys
from starcart.plans.views import query, register_views


@pytest.fixture(scope="module")
def views(spark):
    star = micro_star(spark)
    register_views(star, prefix="t_")
    return star


def test_parameterised_lookup(spark, views):
    df = query(spark, "SELECT candidate_product_key, recommendation_rank FROM t_v_recommendation_top4 "
                      "WHERE source_product_key = ? ORDER BY recommendation_rank", [1])
    assert [tuple(r) for r in df.collect()] == [(2, 1), (3, 2)]
    named = query(spark, "SELECT count(*) AS n FROM t_v_recommendation_top4 WHERE source_product_key = :k",
                  {"k": 4})
    assert named.first().n == 1


def test_dashboard_sql_runs_unchanged(spark, views):
    segs = query(spark, """
        SELECT customer_segment, COUNT(*) AS count,
               ROUND(AVG(lifetime_revenue), 2) AS avg_revenue,
               ROUND(AVG(total_orders), 1) AS avg_orders
        FROM t_v_customer_lifetime_value GROUP BY customer_segment ORDER BY avg_revenue DESC""").collect()
    assert [(r.customer_segment, r["count"]) for r in segs] == [("VIP", 2), ("New", 1)]
    assert segs[0].avg_revenue == D("510.00")
    top = query(spark, "SELECT product_key FROM t_v_top_products_by_revenue ORDER BY revenue_rank LIMIT 2")
    assert [r.product_key for r in top.collect()] == [4, 1]
    detail = query(spark, "SELECT p.product_key, c.parent_category FROM t_dim_product p "
                          "LEFT JOIN t_dim_category c ON p.subcategory = c.category_name WHERE p.product_key = ?", [2])
    assert detail.first().parent_category == "Mobile"
    growth = query(spark, "SELECT ym_label, mom_growth_pct FROM t_v_monthly_revenue_growth ORDER BY year_num, month_num")
    assert [r.mom_growth_pct for r in growth.collect()] == [None, D("-14.29"), D("150.00")]


def test_defaults_and_surrogate_keys(spark, views):
    star = views
    p = star.product.withColumn("is_active", F.lit(None).cast("boolean"))
    filled = star.__class__(star.date, star.customer, star.category, p, star.payment, star.shipping,
                            star.fact).with_defaults()
    assert {r.is_active for r in filled.product.collect()} == {True}
    keyed = assign_keys(star.product.select("product_id"), [F.col("product_id")], "k", num_partitions=3)
    assert sorted(r.k for r in keyed.collect()) == [1, 2, 3, 4, 5]
