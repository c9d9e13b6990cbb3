"""Customer analytics (calculations 12-14, 16): lifetime value, quartiles, repeat rate.

The fact is aggregated per customer first (partial aggregation map-side), then
joined to the customer dimension on the group key. The quartile is a global
NTILE computed by the distributed row-number helper, never a one-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_SUM, div_round, money_mean, round_dec
from ..functions.ranking import ntile, ntile_from_row_number
from ..functions.selection import ntile_by_cuts
from ..plans.warehouse import once_per_star
from ..sources.schema import Star

CUSTOMER_ATTRS = ["customer_id", "customer_name", "customer_segment", "city", "region", "age_group"]
CLV_COLUMNS = ["customer_key", *CUSTOMER_ATTRS, "total_orders", "lifetime_revenue",
               "lifetime_profit", "customer_aov"]
QUARTILE_LABELS = {1: "Q1 (Top)", 2: "Q2", 3: "Q3", 4: "Q4 (Bottom)"}  # fixed values


def clv_base(star: Star, zero: str = "null") -> DataFrame:
    """U8 without the quartile: per buying customer, orders, revenue, profit, AOV."""
    sales = star.lines.groupBy("customer_key").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("net_amount").alias("_net"),
        F.sum("profit_amount").alias("_profit"),
    )
    dim = star.customer.select("customer_key", *CUSTOMER_ATTRS)
    j = sales.join(dim, "customer_key")
    return j.select(
        "customer_key", *CUSTOMER_ATTRS, "total_orders",
        F.col("_net").cast(MONEY_SUM).alias("lifetime_revenue"),
        F.col("_profit").cast(MONEY_SUM).alias("lifetime_profit"),
        div_round(F.col("_net"), F.col("total_orders"), zero=zero, floor=1).alias("customer_aov"),
    )


def _by_revenue():
    return [F.col("lifetime_revenue").desc(), F.col("customer_key").asc()]


def _clv_table(star: Star, zero: str = "null") -> DataFrame:
    """``clv_base``, written once for a materialised star (the ranked queries share it)."""
    return once_per_star(star, f"clv-{zero}", lambda: clv_base(star, zero))


def customer_lifetime_value(star: Star, zero: str = "null") -> DataFrame:
    """U8 + U9: CLV rows with NTILE(4) by revenue (1 = top; ties by customer key).

    Only (key, revenue) go through the global numbering; attributes join back.
    """
    base = _clv_table(star, zero)

    def tiles() -> DataFrame:
        keys = base.select("customer_key", "lifetime_revenue")
        return ntile(keys, _by_revenue(), 4, "spending_quartile").select("customer_key", "spending_quartile")

    return base.join(once_per_star(star, f"clv-quartiles-{zero}", tiles), "customer_key")


def customer_spending_quartiles(star: Star) -> DataFrame:
    """The quartile column with its key and revenue."""
    return customer_lifetime_value(star).select(
        "customer_key", "customer_id", "lifetime_revenue", "spending_quartile"
    )


def spending_quartiles_by_cuts(star: Star, k: int = 4) -> DataFrame:
    """U9 by its three cut rows: histograms of the revenue are refined until each is known; nothing is sorted."""
    rows = _clv_table(star).select("customer_key", "customer_id", "lifetime_revenue")
    return ntile_by_cuts(rows, "lifetime_revenue", "customer_key", k, "spending_quartile")


def quartile_breakdown(star: Star) -> DataFrame:
    """Customers per spending quartile with the dashboard labels.

    The sizes of the tiles follow from the number of customers; nobody is ranked.
    """
    total = _clv_table(star).agg(F.count(F.lit(1)).alias("n"))
    tiles = total.select("n", F.explode(F.array(*[F.lit(k) for k in QUARTILE_LABELS])).alias("spending_quartile"))
    size = F.floor(F.col("n") / 4) + (F.col("spending_quartile") <= F.col("n") % 4).cast("long")
    label = F.lit(None).cast("string")
    for k, text in sorted(QUARTILE_LABELS.items(), reverse=True):
        label = F.when(F.col("spending_quartile") == k, text).otherwise(label)
    return tiles.select("spending_quartile", label.alias("quartile_label"), size.alias("customer_count")).where("customer_count > 0")


def clv_histogram(star: Star, bins: int = 20) -> DataFrame:
    """Exactly ``bins`` equal-width bins between min and max lifetime revenue.

    The maximum falls in the last bin; when min = max every customer is in bin 1.
    Bounds and bin numbers use exact decimal arithmetic; min and max are scalar
    subqueries (one row each), the bin counts a partial aggregate.
    """
    clv = _clv_table(star).select(F.col("lifetime_revenue").alias("v"))
    lo = clv.select(F.min("v")).scalar()
    hi = clv.select(F.max("v")).scalar()
    span = hi - lo
    b = F.when(span == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col("v") - lo) * bins / span).cast("int") + 1, F.lit(bins))
    )
    counts = clv.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("customer_count"))
    grid = clv.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    # ``bins`` rows on either side: the broadcast is bounded by the parameter.
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        round_dec(lo + span * (F.col("bin") - 1) / bins).alias("bin_lo"),
        round_dec(lo + span * F.col("bin") / bins).alias("bin_hi"),
        F.coalesce(F.col("customer_count"), F.lit(0)).alias("customer_count"),
    )


def average_clv(star: Star) -> DataFrame:
    """Mean lifetime revenue over buying customers."""
    return _clv_table(star).agg(
        F.count(F.lit(1)).alias("customers"),
        money_mean("lifetime_revenue").alias("average_clv"),
    )


def top_customers_by_clv(star: Star, n: int = 20) -> DataFrame:
    """The n customers with the highest lifetime revenue (ties by key).

    Sort-limit first; a row's quartile follows from its position among the n and
    the number of customers.
    """
    base = _clv_table(star)
    total = base.select(F.count(F.lit(1))).scalar()
    top = base.orderBy(*_by_revenue()).limit(n)
    numbered = top.withColumn("_rn", F.row_number().over(Window.orderBy(*_by_revenue())).cast("long"))
    tile = ntile_from_row_number(F.col("_rn"), total, 4)
    return numbered.withColumn("spending_quartile", tile).drop("_rn").orderBy(*_by_revenue())


def orders_of_customers(star: Star) -> DataFrame:
    """customer_key, order_count of every customer in the fact, known to the dimension or not."""
    def make() -> DataFrame:
        return star.lines.groupBy("customer_key").agg(F.countDistinct("order_id").alias("order_count"))

    return once_per_star(star, "customer-orders", make)


def repeat_purchase_rate(star: Star, zero: str = "null") -> DataFrame:
    """Share of buying customers with more than one distinct order."""
    per_customer = orders_of_customers(star)
    agg = per_customer.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("order_count") > 1).alias("repeat_customers"),
    )
    return agg.select(
        "total_customers",
        "repeat_customers",
        div_round(F.col("repeat_customers"), F.col("total_customers"), times=100,
                  zero=zero, floor=1).alias("repeat_purchase_rate_pct"),
    )


def customer_segments(star: Star) -> DataFrame:
    """Customers and mean revenue / profit / orders per segment."""
    return _clv_table(star).groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("count"),
        money_mean("lifetime_revenue").alias("avg_revenue"),
        money_mean("lifetime_profit").alias("avg_profit"),
        money_mean("total_orders", 1).alias("avg_orders"),
    ).orderBy(F.col("avg_revenue").desc(), F.col("customer_segment"))
