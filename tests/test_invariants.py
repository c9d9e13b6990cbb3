"""Cross-query invariants and metamorphic properties on the driver data (sf0.001)."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.paths import SF_SMALL
from micro import micro_star
from starcart.operators import basket, customer, kpi, product, recommend
from starcart.sources.driver import driver_star


@pytest.fixture(scope="module")
def star(spark):
    return driver_star(spark, SF_SMALL)


def total(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_revenue_totals_agree(star):
    overview = kpi.overview_kpis(star).first().total_revenue
    assert total(kpi.monthly_kpis(star), "revenue") == overview
    assert total(product.category_revenue_share(star), "category_revenue") == overview
    assert total(customer.clv_base(star), "lifetime_revenue") == overview
    g = kpi.monthly_revenue_growth(star).orderBy(F.col("year_num").desc(), F.col("month_num").desc())
    assert g.first().cumulative_revenue == overview


def test_shares_sum_to_100(star):
    s = total(product.category_revenue_share(star), "revenue_share_pct")
    assert abs(s - D("100")) <= D("0.05")


def test_quartile_sizes(star):
    counts = [r.customer_count for r in customer.quartile_breakdown(star).collect()]
    assert max(counts) - min(counts) <= 1


def test_pairs_symmetric_after_mirroring(star):
    d = basket.directed_pairs(star)
    a = d.select("source_product_key", "candidate_product_key", "co_purchase_count")
    b = d.select(F.col("candidate_product_key").alias("source_product_key"),
                 F.col("source_product_key").alias("candidate_product_key"), "co_purchase_count")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_recommendation_invariants(star):
    s = recommend.recommendation_scores(star)
    per_source = s.groupBy("source_product_key").agg(
        F.max("freq_norm").alias("f"), F.max("recency_norm").alias("r"))
    assert per_source.where((F.col("f") != 1) | (F.col("r") != 1)).count() == 0
    assert s.where((F.col("recommendation_score") < 0) | (F.col("recommendation_score") > 100)).count() == 0
    top = recommend.recommendation_top4(star)
    ranks = top.groupBy("source_product_key").agg(
        F.count(F.lit(1)).alias("n"), F.max("recommendation_rank").alias("m"),
        F.countDistinct("recommendation_rank").alias("d"))
    assert ranks.where((F.col("n") != F.col("m")) | (F.col("d") != F.col("n")) | (F.col("n") > 4)).count() == 0
    assert top.where(F.col("source_product_key") == F.col("candidate_product_key")).count() == 0
    inactive = star.product.where(~F.col("is_active")).select(
        F.col("product_key").alias("candidate_product_key"))
    assert top.join(inactive, "candidate_product_key").count() == 0


def test_block_size_does_not_change_pairs(star):
    a = basket.product_pairs(star, block_size=3)
    b = basket.product_pairs(star)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_repartitioning_does_not_change_results(spark):
    base = micro_star(spark)
    ref = sorted(map(tuple, recommend.recommendation_top4(base).collect()))
    for n in (1, 4, 16):
        st = base.with_fact(base.fact.repartition(n))
        assert sorted(map(tuple, recommend.recommendation_top4(st).collect())) == ref
        assert sorted(map(tuple, kpi.monthly_kpis(st).collect())) == sorted(
            map(tuple, kpi.monthly_kpis(base).collect()))


def test_duplicated_fact_doubles_revenue_not_pairs(spark):
    base = micro_star(spark)
    dup = base.with_fact(base.fact.unionByName(base.fact))
    assert kpi.overview_kpis(dup).first().total_revenue == 2 * kpi.overview_kpis(base).first().total_revenue
    p1 = sorted(map(tuple, basket.product_pairs(base).collect()))
    p2 = sorted(map(tuple, basket.product_pairs(dup).collect()))
    assert p1 == p2


def test_clv_histogram_invariants(star):
    bins = customer.clv_histogram(star).orderBy("bin").collect()
    assert [b.bin for b in bins] == list(range(1, 21))
    assert sum(b.customer_count for b in bins) == customer.clv_base(star).count()
    assert all(a.bin_hi == b.bin_lo for a, b in zip(bins, bins[1:]))  # contiguous edges
    top = customer.clv_base(star).agg(F.max("lifetime_revenue")).first()[0]
    assert bins[-1].bin_hi == top and bins[-1].customer_count >= 1  # the maximum lands in bin 20
