"""Hand-checkable answers on the 9-line star (FIXTURES.md section C)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest

from micro import micro_star
from starcart.operators import basket, customer, kpi, product, rec_checks, recommend


@pytest.fixture(scope="module")
def star(spark):
    return micro_star(spark)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_monthly_and_growth(star):
    got = rows(kpi.monthly_revenue_growth(star), "ym_label", "order_lines", "total_orders",
               "unique_customers", "revenue", "gross_profit", "units_sold", "aov",
               "profit_margin_pct", "previous_month_revenue", "mom_growth_pct",
               "cumulative_revenue", "ma_3m")
    assert got == [
        ("2025-01", 2, 1, 1, D("280.00"), D("100.00"), D("3.00"), D("280.00"), D("35.71"),
         None, None, D("280.00"), D("280.00")),
        ("2025-02", 3, 1, 2, D("240.00"), D("70.00"), D("3.00"), D("240.00"), D("29.17"),
         D("280.00"), D("-14.29"), D("520.00"), D("260.00")),
        ("2025-04", 4, 2, 2, D("600.00"), D("-20.00"), D("4.00"), D("300.00"), D("-3.33"),
         D("240.00"), D("150.00"), D("1120.00"), D("373.33")),
    ]


def test_direction_first_month_is_down(star):
    got = rows(kpi.growth_direction(star), "ym_label", "direction")
    assert got == [("2025-01", "down"), ("2025-02", "down"), ("2025-04", "up")]


def test_overview(star):
    r = kpi.overview_kpis(star).first().asDict()
    assert r == {"total_revenue": D("1120.00"), "total_profit": D("150.00"), "total_orders": 4,
                 "total_customers": 3, "aov": D("280.00"), "profit_margin_pct": D("13.39"),
                 "units_sold": D("10")}


def test_products(star):
    got = rows(product.top_products_by_revenue(star), "product_key", "product_revenue",
               "product_profit", "orders_count", "units_sold", "revenue_rank")
    assert got == [
        (1, D("390.00"), D("150.00"), 3, D("4.00"), 2),
        (2, D("280.00"), D("90.00"), 2, D("3.00"), 3),
        (3, D("50.00"), D("10.00"), 1, D("1.00"), 4),
        (4, D("400.00"), D("-100.00"), 1, D("1.00"), 1),
        (5, D("0.00"), D("0.00"), 1, D("1.00"), 5),
    ]
    top2 = rows(product.top_n_products(star, 2), "product_key", "revenue_rank")
    assert top2 == [(1, 2), (4, 1)]


def test_categories(star):
    got = rows(product.category_revenue_share(star), "category_key", "category_revenue",
               "revenue_share_pct", "category_rank")
    assert got == [(1, D("490.00"), D("43.75"), 2), (2, D("580.00"), D("51.79"), 1),
                   (3, D("50.00"), D("4.46"), 3)]


def test_clv_and_quartiles(star):
    got = rows(customer.customer_lifetime_value(star), "customer_key", "total_orders",
               "lifetime_revenue", "lifetime_profit", "customer_aov", "spending_quartile")
    # Orders sum to 5, not 4: order O2 has lines of two customers.
    assert got == [(1, 2, D("420.00"), D("140.00"), D("210.00"), 2),
                   (2, 2, D("100.00"), D("30.00"), D("50.00"), 3),
                   (3, 1, D("600.00"), D("-20.00"), D("600.00"), 1)]


def test_segments_and_repeat(star):
    got = rows(customer.customer_segments(star), "customer_segment", "count", "avg_revenue",
               "avg_profit", "avg_orders")
    assert got == [("New", 1, D("100.00"), D("30.00"), D("2.0")),
                   ("VIP", 2, D("510.00"), D("60.00"), D("1.5"))]
    r = customer.repeat_purchase_rate(star).first()
    assert (r.total_customers, r.repeat_customers, r.repeat_purchase_rate_pct) == (3, 2, D("66.67"))


@pytest.mark.parametrize("block_size", [1, 2, 2048])
def test_pairs(star, block_size):
    got = rows(basket.product_pairs(star, block_size), "source_product_key", "candidate_product_key",
               "co_purchase_count", "last_together_date")
    assert got == [
        (1, 2, 2, dt.date(2025, 2, 5)),
        (1, 3, 1, dt.date(2025, 2, 6)),
        (1, 4, 2, dt.date(2025, 4, 2)),  # one order, two dates of product 1
        (2, 3, 1, dt.date(2025, 2, 6)),
    ]


def test_recommendations(star):
    s = rows(recommend.recommendation_scores(star), "source_product_key", "candidate_product_key",
             "category_match", "freq_norm", "recency_norm", "popularity_norm", "margin_norm",
             "recommendation_score")
    assert s == [
        (1, 2, D("0.5"), D("1.000000"), D("0.988950"), D("0.666667"), D("0.826087"), D("89.65")),
        (1, 3, D("1.0"), D("0.500000"), D("1.000000"), D("0.333333"), D("0.521739"), D("68.55")),
        (2, 1, D("0.5"), D("1.000000"), D("0.988950"), D("1.000000"), D("1.000000"), D("94.72")),
        (2, 3, D("0.5"), D("0.500000"), D("1.000000"), D("0.333333"), D("0.521739"), D("63.55")),
        (3, 1, D("1.0"), D("1.000000"), D("1.000000"), D("1.000000"), D("1.000000"), D("100.00")),
        (3, 2, D("0.5"), D("1.000000"), D("1.000000"), D("0.666667"), D("0.826087"), D("89.93")),
        (4, 1, D("0.0"), D("1.000000"), D("1.000000"), D("1.000000"), D("1.000000"), D("90.00")),
    ]
    top = rows(recommend.recommendation_top4(star), "source_product_key", "candidate_product_key",
               "recommendation_score", "recommendation_rank")
    assert top == [(1, 2, D("89.65"), 1), (1, 3, D("68.55"), 2), (2, 1, D("94.72"), 1),
                   (2, 3, D("63.55"), 2), (3, 1, D("100.00"), 1), (3, 2, D("89.93"), 2),
                   (4, 1, D("90.00"), 1)]


def test_recommendation_checks(star):
    recs = recommend.recommendation_top4(star)
    missing = rows(rec_checks.rec_missing(star.product, recs), "product_id", "rec_count")
    assert missing == [("P5", 0)]  # inactive 4 owns recommendations; 5 has no pair
    assert rec_checks.rec_self_check(recs).first().issue_count == 0
    one = rows(recommend.recommendations_for_product(star, 1), "candidate_product_key",
               "recommendation_rank")
    assert one == [(2, 1), (3, 2)]


def test_floor_mode_needs_clock(star):
    with pytest.raises(ValueError):
        recommend.scored_pairs(star, zero="floor")
    got = rows(recommend.recommendation_top4(star, zero="floor", as_of=dt.date(2025, 4, 10)),
               "source_product_key", "candidate_product_key", "recommendation_rank")
    assert [(s, c) for s, c, r in got if r == 1] == [(1, 2), (2, 1), (3, 1), (4, 1)]
