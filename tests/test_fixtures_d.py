"""Corrupted and sparse facts (FIXTURES.md section D): the checks must fire."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.paths import SF_MID
from starcart.operators import quality, rec_checks, recommend
from starcart.plans.warehouse import warehouse_star
from starcart.sources.schema import Star


@pytest.fixture(scope="module")
def star(spark):
    return warehouse_star(spark, SF_MID)


def sparse_fact(fact):
    """Orders whose number is a multiple of 20."""
    return fact.where(F.substring("order_id", 4, 20).cast("long") % 20 == 0)


def checks(df):
    return {r.check_name: r.issue_count for r in df.collect()}


def test_clean_data_has_no_issues(star):
    assert set(checks(quality.dq_orphans(star)).values()) == {0}
    assert set(checks(quality.dq_arithmetic(star)).values()) == {0}
    assert set(checks(quality.dq_constraints(star)).values()) == {0}


def test_corrupted_fact(star):
    bad = star.with_fact(quality.corrupted_fact(star.fact))
    orphans = checks(quality.dq_orphans(bad))
    arith = checks(quality.dq_arithmetic(bad))
    assert orphans["missing_product"] == 689
    assert {k: v for k, v in orphans.items() if k != "missing_product"} == dict.fromkeys(
        ["missing_date", "missing_customer", "missing_category", "missing_payment", "missing_shipping"], 0)
    assert arith == {"invalid_net_formula": 637, "invalid_profit_formula": 637, "invalid_quantity": 618}


def test_sparse_fact_recommendation_checks(star):
    sparse = star.with_fact(sparse_fact(star.fact))
    assert sparse.fact.count() == 3045
    recs = recommend.recommendation_top4(sparse)
    assert rec_checks.rec_missing(sparse.product, recs).count() == 421
    per_source = recs.groupBy("source_product_key").count().groupBy("count").count()
    dist = {r[0]: r[1] for r in per_source.collect()}
    assert dist == {1: 51, 2: 116, 3: 177, 4: 1219}
    cov = rec_checks.rec_coverage(recs).collect()
    assert len(cov) == 20 and all(r.recommendations_per_product == 4 for r in cov)
    assert rec_checks.rec_self_check(recs).first().issue_count == 0


def test_duplicate_key_is_reported(spark, star):
    dup = star.product.unionByName(star.product.where(F.col("product_key") == 7))
    bad = Star(star.date, star.customer, star.category, dup, star.payment, star.shipping, star.fact)
    c = checks(quality.dq_constraints(bad))
    assert c["pk_dim_product_product_key"] == 1 and c["unique_dim_product_product_id"] == 1
