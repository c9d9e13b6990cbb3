"""Product and category analytics (calculations 8-11) and the product pages.

The fact is aggregated on the product / category key *before* the dimension is
joined, so the join sees one row per key instead of one per order line, and
the aggregate's hash partitioning on the key is reused by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_SUM, div_round
from ..functions.ranking import dense_rank_desc
from ..plans.warehouse import once_per_star
from ..session import materialize
from ..sources.schema import Star

PRODUCT_ATTRS = ["product_id", "product_name", "brand", "subcategory"]


def product_sales(star: Star, lines: DataFrame | None = None) -> DataFrame:
    """Per product: exact revenue and profit sums, distinct orders, units (of ``lines``, if given)."""
    return (star.lines if lines is None else lines).groupBy("product_key").agg(
        F.sum("net_amount").alias("_net"),
        F.sum("profit_amount").alias("_profit"),
        F.countDistinct("order_id").alias("orders_count"),
        F.sum("quantity").alias("_qty"),
    )


def _product_rows(star: Star) -> DataFrame:
    sales = product_sales(star)
    dim = star.product.select("product_key", *PRODUCT_ATTRS)
    return sales.join(dim, "product_key")


def _shape(df: DataFrame) -> DataFrame:
    return df.select(
        "product_key", *PRODUCT_ATTRS,
        F.col("_net").cast(MONEY_SUM).alias("product_revenue"),
        F.col("_profit").cast(MONEY_SUM).alias("product_profit"),
        "orders_count",
        F.col("_qty").cast(MONEY_SUM).alias("units_sold"),
        "revenue_rank",
    )


def top_products_by_revenue(star: Star) -> DataFrame:
    """Every sold product with its dense revenue rank (1 = highest revenue)."""
    # Ranking reads the rows twice (distinct revenues, join back): one aggregate feeds both.
    rows = once_per_star(star, "product-sales", lambda: _product_rows(star))
    ranked = once_per_star(star, "product-ranks", lambda: dense_rank_desc(rows, "_net", "revenue_rank"))
    return _shape(ranked)


def top_n_products(star: Star, n: int = 20) -> DataFrame:
    """The n best products by revenue (ties broken by product key).

    A sort-limit over the revenues (TakeOrderedAndProject keeps n rows per task) runs
    first; orders, profit and units are then taken from the lines of those products
    alone, so the distinct orders of all others never move. The dense rank is computed
    over the n rows only, which equals the global rank because every larger revenue is
    also among them.
    """
    revenue = star.lines.groupBy("product_key").agg(F.sum("net_amount").alias("_net"))
    rows = revenue.join(star.product.select("product_key", *PRODUCT_ATTRS), "product_key")
    top = materialize(rows.orderBy(F.col("_net").desc(), F.col("product_key").asc()).limit(n), "top-products")
    keys = [r[0] for r in top.select("product_key").distinct().collect()]  # n at most
    sales = product_sales(star, star.lines.where(F.col("product_key").isin(keys))).drop("_net")
    ranked = top.join(sales, "product_key").withColumn(
        "revenue_rank", F.dense_rank().over(Window.orderBy(F.col("_net").desc()))
    )
    return _shape(ranked)


def category_revenue_share(star: Star, zero: str = "null") -> DataFrame:
    """Revenue per fact category, its share of all revenue and its dense rank.

    Categories are a short fixed list, so the share/rank windows run on a handful
    of aggregated rows.
    """
    sales = star.fact.groupBy("category_key").agg(F.sum("net_amount").alias("_net"))
    cats = star.category.select("category_key", "category_name")
    j = sales.join(cats, "category_key")
    everything = Window.partitionBy()
    return j.select(
        "category_key",
        "category_name",
        F.col("_net").cast(MONEY_SUM).alias("category_revenue"),
        div_round(F.col("_net"), F.sum("_net").over(everything), times=100, zero=zero,
                  floor=0.01).alias("revenue_share_pct"),
        F.dense_rank().over(Window.orderBy(F.col("_net").desc())).alias("category_rank"),
    )


def active_product_list(star: Star) -> DataFrame:
    """Active products by name, with the picker label 'name  (id)'."""
    p = star.product.filter(F.col("is_active"))
    return p.select(
        "product_key", "product_id", "product_name", "brand", "subcategory", "unit_price",
        F.concat(F.col("product_name"), F.lit("  ("), F.col("product_id"), F.lit(")"))
        .alias("display_label"),
    ).orderBy("product_name", "product_key")


def product_detail(star: Star, product_key: int) -> DataFrame:
    """One product with its category parent (empty when the key is unknown).

    The key filter is pushed to the product scan; the category side is tiny.
    """
    p = star.product.filter(F.col("product_key") == F.lit(product_key))
    c = star.category.select("category_name", "parent_category")
    return p.join(c, p["subcategory"] == c["category_name"], "left").select(
        "product_key", "product_id", "product_name", "brand", "subcategory",
        "unit_price", "cost_price", "category_name", "parent_category",
    )


def product_unit_margin(star: Star) -> DataFrame:
    """(price - cost) / max(price, 0.01) * 100 for every product."""
    p = star.product
    margin = div_round(F.col("unit_price") - F.col("cost_price"), F.col("unit_price"),
                       times=100, zero="floor", floor=0.01)
    return p.select("product_key", "product_id", "unit_price", "cost_price",
                    margin.alias("margin_pct"))
