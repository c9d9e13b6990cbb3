"""Edge rows (FIXTURES.md section E)."""

from __future__ import annotations

from decimal import Decimal as D

from micro import CATEGORIES, LINES, PRODUCTS, micro_star
from starcart.operators import basket, customer, kpi, product, recommend


def line(date, cust, prod, order, net, cost, cat=1):
    return (date, cust, prod, cat, order, 1, net, 0, net, cost, net - cost)


def test_empty_fact(spark):
    star = micro_star(spark, lines=[])
    assert kpi.monthly_kpis(star).count() == 0
    o = kpi.overview_kpis(star).first()
    assert o.total_orders == 0 and o.total_revenue is None and o.aov is None
    assert customer.customer_lifetime_value(star).count() == 0
    assert product.top_products_by_revenue(star).count() == 0
    assert basket.product_pairs(star).count() == 0
    assert recommend.recommendation_top4(star).count() == 0
    assert customer.repeat_purchase_rate(star).first().repeat_purchase_rate_pct is None


def test_zero_revenue_month_gives_null_growth(spark):
    star = micro_star(spark, lines=[line("2025-01-05", 1, 1, "A", 0, 0), line("2025-02-05", 1, 1, "B", 50, 10)])
    g = {r.ym_label: r for r in kpi.monthly_revenue_growth(star).collect()}
    assert g["2025-01"].profit_margin_pct is None  # zero revenue: NULL margin
    assert g["2025-02"].mom_growth_pct is None  # previous month revenue 0: NULL, not an error
    assert g["2025-02"].previous_month_revenue == D("0.00")


def test_single_month(spark):
    star = micro_star(spark, lines=[line("2025-03-01", 1, 1, "A", 10, 5), line("2025-03-09", 2, 2, "B", 30, 5)])
    g = kpi.monthly_revenue_growth(star).collect()
    assert len(g) == 1 and g[0].ma_3m == D("40.00") and g[0].cumulative_revenue == D("40.00")


def test_tied_revenues(spark):
    lines = [line("2025-01-01", c, c, f"O{c}", 100, 50) for c in (1, 2, 3)]
    star = micro_star(spark, lines=lines)
    ranks = {r.product_key: r.revenue_rank for r in product.top_products_by_revenue(star).collect()}
    assert set(ranks.values()) == {1}
    q = {r.customer_key: r.spending_quartile for r in customer.customer_lifetime_value(star).collect()}
    assert q == {1: 1, 2: 2, 3: 3}  # NTILE splits ties by customer key


def test_empty_vs_null_subcategory(spark):
    products = [(1, "", True), (2, None, True), (3, None, True)]
    lines = [line("2025-01-01", 1, 1, "A", 10, 5), line("2025-01-01", 1, 2, "A", 10, 5),
             line("2025-01-01", 1, 3, "A", 10, 5)]
    star = micro_star(spark, lines=lines, products=products)
    m = {(r.source_product_key, r.candidate_product_key): r.category_match
         for r in recommend.category_match(star).collect()}
    assert m[(1, 2)] == D("1.0")  # '' source matches NULL candidate via COALESCE
    assert m[(2, 1)] == D("0.0") and m[(2, 3)] == D("0.0")  # NULL source never matches


def test_duplicate_category_name_fans_out(spark):
    cats = [*CATEGORIES, (4, "Phones", "Gadgets")]
    star = micro_star(spark, categories=cats)
    s = recommend.recommendation_scores(star).where("source_product_key = 1 and candidate_product_key = 3")
    # Source and candidate are both "Phones", which now has two category rows:
    # the two LEFT JOINs fan out 2 x 2, exactly as the SQL joins do.
    assert s.count() == 4
    assert {r.category_match for r in s.collect()} == {D("1.0")}


def test_all_candidates_inactive(spark):
    products = [(1, "Phones", True), (2, "Phones", False), (3, "Phones", False)]
    lines = [line("2025-01-01", 1, 1, "A", 10, 5), line("2025-01-01", 1, 2, "A", 10, 5),
             line("2025-01-02", 1, 3, "A", 10, 5)]
    star = micro_star(spark, lines=lines, products=products)
    top = recommend.recommendation_top4(star)
    assert {r.source_product_key for r in top.collect()} == {2, 3}  # source 1 vanishes


def test_negative_margins(spark):
    lines = [line("2025-01-01", 1, 1, "A", 10, 15), line("2025-01-01", 1, 2, "A", 10, 12),
             line("2025-01-01", 1, 3, "A", 10, 11)]
    star = micro_star(spark, lines=lines, products=[(1, "Phones", True), (2, "Phones", True), (3, "Phones", True)])
    s = {(r.source_product_key, r.candidate_product_key): r.margin_norm
         for r in recommend.recommendation_scores(star).collect()}
    # max margin is -0.1 (product 3): norms are ratios to a negative maximum.
    assert s[(1, 3)] == D("1.000000") and s[(1, 2)] == D("2.000000")


def test_one_line_order_and_same_day_duplicates(spark):
    lines = [line("2025-01-01", 1, 1, "ONE", 10, 5),
             line("2025-01-02", 1, 2, "B", 10, 5), line("2025-01-02", 1, 2, "B", 10, 5),
             line("2025-01-02", 1, 3, "B", 10, 5)]
    star = micro_star(spark, lines=lines, products=PRODUCTS)
    pairs = [tuple(r) for r in basket.product_pairs(star).select(
        "source_product_key", "candidate_product_key", "co_purchase_count").collect()]
    assert pairs == [(2, 3, 1)]  # same product twice on one date collapses; one-line order has no pair


def test_micro_lines_unchanged():
    assert len(LINES) == 9


def test_case_insensitive_collation(spark):
    products = [(1, "phones", True), (2, "PHONES", True), (3, "Tablets", True)]
    lines = [line("2025-01-01", 1, 1, "A", 10, 5), line("2025-01-01", 1, 2, "A", 10, 5),
             line("2025-01-01", 1, 3, "A", 10, 5)]
    star = micro_star(spark, lines=lines, products=products)
    binary = {(r.source_product_key, r.candidate_product_key): r.category_match
              for r in recommend.category_match(star).collect()}
    ci = {(r.source_product_key, r.candidate_product_key): r.category_match
          for r in recommend.category_match(star, collation="UNICODE_CI_AI").collect()}
    assert binary[(1, 2)] == D("0.0") and ci[(1, 2)] == D("1.0")
    assert binary[(1, 3)] == D("0.0") and ci[(1, 3)] == D("0.5")  # phones ~ Phones -> Mobile = Tablets' parent


def test_floor_mode_on_zero_revenue(spark):
    star = micro_star(spark, lines=[line("2025-01-05", 1, 1, "A", 0, 0), line("2025-02-05", 1, 1, "B", 50, 10)])
    m = {r.ym_label: r for r in kpi.monthly_kpis(star, zero="floor").collect()}
    assert m["2025-01"].profit_margin_pct == D("0.00")  # 0 / max(0, 0.01): no NULL, no error
    assert m["2025-01"].aov == D("0.00")


def test_default_recency_ignores_the_clock(spark):
    import datetime as dt

    star = micro_star(spark)
    a = sorted(map(tuple, recommend.recommendation_scores(star, as_of=dt.date(2025, 5, 1)).collect()))
    b = sorted(map(tuple, recommend.recommendation_scores(star, as_of=dt.date(2030, 1, 1)).collect()))
    assert a == b == sorted(map(tuple, recommend.recommendation_scores(star).collect()))
