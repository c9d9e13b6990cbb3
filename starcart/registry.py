"""Name -> callable(spark, sf_dir) for every operator exposed to the driver."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import basket, catalog, customer, kpi, product, quality, rec_checks, recommend
from .session import stage_path
from .sources import generate, loader
from .sources.driver import read_table
from .sources.keys import KeyRegistry
from .plans import build, layout, script
from .plans.pair_refresh import PairMart
from .plans.warehouse import once_per_star, warehouse_star

Query = Callable[[SparkSession, str], DataFrame]


def _on_star(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(warehouse_star(spark, sf_dir), **kw)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _on_recs(fn, with_products: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star = warehouse_star(spark, sf_dir)
        recs = recommend.recommendation_top4(star)
        return fn(star.product, recs) if with_products else fn(recs)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _on_corrupted(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star = warehouse_star(spark, sf_dir)
        return fn(star.with_fact(quality.corrupted_fact(star.fact)))

    run.__name__ = fn.__name__ + "_corrupted"
    run.__doc__ = fn.__doc__
    return run


def _on_scattered(fn, with_products: bool = False) -> Query:
    """A recommendation check on the whole fact with its baskets scattered by rule."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        star = warehouse_star(spark, sf_dir)
        recs = recommend.recommendation_top4(star.with_fact(quality.scattered_fact(star.lines)))
        return fn(star.product, recs) if with_products else fn(recs)

    run.__name__ = fn.__name__ + "_sparse"
    run.__doc__ = fn.__doc__
    return run


def dq_constraints_corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U42 on a star that breaks the declared constraints by rule."""
    return quality.dq_constraints(quality.corrupted_star(warehouse_star(spark, sf_dir)))


FLOOR_CLOCK = datetime.date(2002, 1, 1)  # recency clock of the floor-mode queries


def monthly_kpis_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 with floors instead of NULL for zero denominators, on a fact with given-away lines."""
    star = warehouse_star(spark, sf_dir)
    return kpi.monthly_kpis(star.with_fact(quality.zero_revenue_fact(star.fact)), zero="floor")


def recommendation_top4_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U27 with floors and a fixed recency clock, on a fact with given-away lines."""
    star = warehouse_star(spark, sf_dir)
    given = star.with_fact(quality.zero_revenue_fact(star.lines))
    return recommend.recommendation_top4(given, zero="floor", as_of=FLOOR_CLOCK)


def recommendations_for_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U28 served from the written recommendation table; the key filter prunes its files."""
    star = warehouse_star(spark, sf_dir)
    path = build.served_recommendations(star)
    return build.serve_recommendations(spark, path, product_key=5)


def date_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U43 over the ship-date span of the line items (every day, 13 attributes)."""
    li = read_table(spark, sf_dir, "lineitem")
    bounds = li.agg(F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi"))
    return generate.calendar_between(bounds)


def derive_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U47 on every line item: unit price = extended price / quantity, the line's
    discount, a cost ratio of 62-87 % by part."""
    li = read_table(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity").cast("decimal(10,2)")
    ext = F.col("l_extendedprice").cast("decimal(10,2)")
    unit = F.when(qty == 0, F.lit(None)).otherwise(F.round(ext / qty, 2)).cast("decimal(10,2)")
    ratio = F.expr("cast((62 + l_partkey % 26) * 0.01 as decimal(6,4))")
    m = generate.derive_measures(qty, unit, F.col("l_discount"), ratio)
    return li.select(
        "l_orderkey", "l_linenumber", qty.alias("quantity"), unit.alias("unit_price"),
        *[c.alias(n) for n, c in m.items()],
    )


def _halves(rows: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to the middle of the span of a date column, and those after it (or without a date)."""
    middle = rows.agg(F.date_add(F.min(day), (F.datediff(F.max(day), F.min(day)) / 2).cast("int"))).first()[0]
    early = F.coalesce(F.col(day) <= F.lit(middle), F.lit(False))
    return rows.where(early), rows.where(~early)


def order_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense, append-stable key of every order line, given in two loads: the early half by ship date, then the rest."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    # Line numbers repeat within an order and day; equal lines are told apart by a number.
    natural = ["l_orderkey", "l_linenumber", "day"]
    lines = lines.withColumn("copy", F.row_number().over(Window.partitionBy(*natural).orderBy(F.lit(0))))
    registry = KeyRegistry(spark, stage_path(spark, "order-line-keys"), [*natural, "copy"], "order_line_key")
    for half in _halves(lines, "day"):
        registry.append(half)
    return registry.keys()


def load_with_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U48 and U42 as a strict load: rows by table and reason, on a star that breaks the declared rules."""
    star = quality.corrupted_star(warehouse_star(spark, sf_dir))
    return loader.load_report(star.with_fact(quality.corrupted_fact(star.fact)))


def product_pairs_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U18 kept as lines arrive: the early half by date, then the rest, which meets orders already seen."""
    star = warehouse_star(spark, sf_dir)
    mart = PairMart(spark, stage_path(spark, "pair-mart"))
    # Three columns of the lines, written once: the span and either half are read from them.
    dated = once_per_star(star, "dated-lines", lambda: star.lines.select("order_id", "product_key", "date_key").join(
        F.broadcast(star.date.select("date_key", "full_date")), "date_key"))
    for half in _halves(dated, "full_date"):
        mart.add(star, half.select("order_id", "product_key", "date_key"))
    return mart.pairs()


def queries() -> dict[str, Query]:
    return {
        "monthly_kpis": _on_star(kpi.monthly_kpis),
        "monthly_kpis_floor": monthly_kpis_floor,
        "monthly_revenue_growth": _on_star(kpi.monthly_revenue_growth),
        "cumulative_revenue": _on_star(kpi.cumulative_revenue),
        "moving_average_3m": _on_star(kpi.moving_average_3m),
        "growth_direction": _on_star(kpi.growth_direction),
        "monthly_report": _on_star(kpi.monthly_report),
        "overview_kpis": _on_star(kpi.overview_kpis),
        "dq_sanity_totals": _on_star(kpi.dq_sanity_totals),
        "dq_monthly": _on_star(kpi.dq_monthly),
        "dq_fact_profile": _on_star(kpi.dq_fact_profile),
        "top_products_by_revenue": _on_star(product.top_products_by_revenue),
        "top_n_products": _on_star(product.top_n_products, n=15),
        "category_revenue_share": _on_star(product.category_revenue_share),
        "active_product_list": _on_star(product.active_product_list),
        "product_detail": _on_star(product.product_detail, product_key=5),
        "product_unit_margin": _on_star(product.product_unit_margin),
        "customer_lifetime_value": _on_star(customer.customer_lifetime_value),
        "customer_spending_quartiles": _on_star(customer.customer_spending_quartiles),
        "spending_quartiles_by_cuts": _on_star(customer.spending_quartiles_by_cuts),
        "quartile_breakdown": _on_star(customer.quartile_breakdown),
        "clv_histogram": _on_star(customer.clv_histogram),
        "average_clv": _on_star(customer.average_clv),
        "top_customers_by_clv": _on_star(customer.top_customers_by_clv),
        "repeat_purchase_rate": _on_star(customer.repeat_purchase_rate),
        "customer_segments": _on_star(customer.customer_segments),
        "basket_items": _on_star(basket.basket_items),
        "product_pairs": _on_star(recommend.copurchase_pairs),
        "directed_pairs": _on_star(recommend.copurchase_directed),
        "candidate_popularity": _on_star(recommend.candidate_popularity),
        "candidate_margin": _on_star(recommend.candidate_margin),
        "category_match": _on_star(recommend.category_match),
        "recommendation_scores": _on_star(recommend.recommendation_scores),
        "recommendation_top4": _on_star(recommend.recommendation_top4),
        "category_match_split": _on_star(recommend.category_match, broadcast_rows=0),
        "recommendation_top4_bounded": _on_star(recommend.recommendation_top4, prune=recommend.TOP_K),
        "recommendation_top4_floor": recommendation_top4_floor,
        "recommendations_for_product": recommendations_for_product,
        "rec_coverage": _on_recs(rec_checks.rec_coverage),
        "rec_missing": _on_recs(rec_checks.rec_missing, with_products=True),
        "rec_coverage_sparse": _on_scattered(rec_checks.rec_coverage),
        "rec_missing_sparse": _on_scattered(rec_checks.rec_missing, with_products=True),
        "rec_self_check": _on_recs(rec_checks.rec_self_check),
        "rec_score_stats": _on_recs(rec_checks.rec_score_stats),
        "rec_diversity": _on_recs(rec_checks.rec_diversity),
        "dq_row_counts": _on_star(quality.dq_row_counts),
        "dq_orphans": _on_star(quality.dq_orphans),
        "dq_arithmetic": _on_star(quality.dq_arithmetic),
        "dq_constraints": _on_star(quality.dq_constraints),
        "dq_constraints_corrupted": dq_constraints_corrupted,
        "dq_orphans_corrupted": _on_corrupted(quality.dq_orphans),
        "dq_arithmetic_corrupted": _on_corrupted(quality.dq_arithmetic),
        "date_dimension": date_dimension,
        "derive_measures": derive_measures,
        "star_fact": _on_star(lambda star: star.fact),
        "catalog_report": _on_star(catalog.catalog_tables),
        "order_line_keys": order_line_keys,
        "load_with_rejects": load_with_rejects,
        "product_pairs_bucketed": _on_star(layout.product_pairs_bucketed),
        "order_lookup": _on_star(layout.lookup_first_order),
        "latest_quarter_kpis": _on_star(layout.latest_quarter_kpis),
        "product_pairs_incremental": product_pairs_incremental,
        "distinct_customers_by_period": _on_star(layout.distinct_by_period, column="customer_key", count="customers"),
        "distinct_products_by_period": _on_star(layout.distinct_by_period, column="product_key", count="products"),
        "recent_months": _on_star(script.recent_months),
    }
