"""Monthly and whole-dataset KPIs (calculations 1-7, 15) and the checks built on them.

Plan shape: fact scan (pruned to 6 columns) -> broadcast hash join with the
calendar (one row per day, so its size is bounded by the calendar span, not by
the data) -> partial/final aggregate on (year, month). Windows run only on the
aggregated months, a few hundred rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_SUM, div_round, money_sum, round_dec
from ..sources.schema import Star


def _month_label(year: str, month: str):
    return F.concat(F.col(year).cast("string"), F.lit("-"), F.lpad(F.col(month).cast("string"), 2, "0"))


def fact_with_month(star: Star, *cols: str) -> DataFrame:
    cal = star.date.select("date_key", F.col("year").cast("int"), F.col("month").cast("int"))
    return star.fact.select("date_key", *cols).join(F.broadcast(cal), "date_key")


def monthly_kpis(star: Star, zero: str = "null") -> DataFrame:
    """Lines, orders, buyers, revenue, profit, units, AOV and margin per month.

    Months without sales are absent (no gap filling): downstream LAG and rolling
    windows look at the previous *present* month.
    """
    j = fact_with_month(star, "order_id", "customer_key", "net_amount", "profit_amount", "quantity")
    base = j.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("order_lines"),
        F.sum("net_amount").alias("_net"),
        F.sum("profit_amount").alias("_profit"),
        F.sum("quantity").alias("_qty"),
    )
    # The two distinct counts are deduplicated separately (map-side partial
    # distinct on (month, key)), instead of one aggregate that would Expand
    # every line three times; the column-pruned scans read disjoint columns.
    orders = distinct_count(j, "order_id", "total_orders", "year", "month")
    buyers = distinct_count(j, "customer_key", "unique_customers", "year", "month")
    agg = (
        base.join(F.broadcast(orders), ["year", "month"], "left")  # one row per month: bounded
        .join(F.broadcast(buyers), ["year", "month"], "left")
        .fillna(0, ["total_orders", "unique_customers"])
    )
    return agg.select(
        F.col("year").alias("year_num"),
        F.col("month").alias("month_num"),
        _month_label("year", "month").alias("ym_label"),
        "order_lines",
        "total_orders",
        "unique_customers",
        F.col("_net").cast(MONEY_SUM).alias("revenue"),
        F.col("_profit").cast(MONEY_SUM).alias("gross_profit"),
        F.col("_qty").cast(MONEY_SUM).alias("units_sold"),
        div_round(F.col("_net"), F.col("total_orders"), zero=zero, floor=1).alias("aov"),
        div_round(F.col("_profit"), F.col("_net"), times=100, zero=zero, floor=0.01)
        .alias("profit_margin_pct"),
    )


def distinct_count(df: DataFrame, col: str, name: str, *keys: str) -> DataFrame:
    """COUNT(DISTINCT col) per keys, as its own dedup + count (NULLs not counted)."""
    return (df.select(*keys, col).where(F.col(col).isNotNull()).distinct()
            .groupBy(*keys).agg(F.count(F.lit(1)).alias(name)))


def _month_order():
    # Unpartitioned on purpose: it runs on the aggregated months (bounded by the calendar).
    return Window.orderBy("year_num", "month_num")


def monthly_revenue_growth(star: Star, zero: str = "null") -> DataFrame:
    """All monthly KPIs + previous month, MoM %, cumulative revenue and 3-month mean.

    All four read the already-rounded monthly revenue, as the dashboard does.
    """
    m = monthly_kpis(star, zero)
    w = _month_order()
    prev = F.lag("revenue", 1).over(w)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last3 = w.rowsBetween(-2, Window.currentRow)
    return m.select(
        *m.columns,
        prev.alias("previous_month_revenue"),
        div_round(F.col("revenue") - prev, prev, times=100).alias("mom_growth_pct"),
        F.sum("revenue").over(running).cast(MONEY_SUM).alias("cumulative_revenue"),
        div_round(F.sum("revenue").over(last3), F.count("revenue").over(last3)).alias("ma_3m"),
    )


def cumulative_revenue(star: Star) -> DataFrame:
    """Running revenue total over the present months."""
    return monthly_revenue_growth(star).select(
        "year_num", "month_num", "ym_label", "revenue", "cumulative_revenue"
    )


def moving_average_3m(star: Star) -> DataFrame:
    """U4: mean of the current and two previous present months (shorter at the start)."""
    return monthly_revenue_growth(star).select("year_num", "month_num", "ym_label", "revenue", "ma_3m")


def growth_direction(star: Star) -> DataFrame:
    """U49: 'up' when MoM growth > 0; zero growth and the first month count as 'down'."""
    g = monthly_revenue_growth(star)
    return g.select(
        "year_num", "month_num", "ym_label", "revenue", "mom_growth_pct",
        F.when(F.col("mom_growth_pct") > 0, "up").otherwise("down").alias("direction"),
    )


def monthly_report(star: Star) -> DataFrame:
    """The detailed monthly table, nine columns under display names."""
    g = monthly_revenue_growth(star)
    return g.select(
        F.col("ym_label").alias("Month"),
        F.col("revenue").alias("Revenue"),
        F.col("mom_growth_pct").alias("MoM %"),
        F.col("cumulative_revenue").alias("Cumulative"),
        F.col("ma_3m").alias("3M MA"),
        F.col("total_orders").alias("Orders"),
        F.col("unique_customers").alias("Customers"),
        F.col("aov").alias("AOV"),
        F.col("profit_margin_pct").alias("Margin %"),
    )


def overview_kpis(star: Star, zero: str = "null") -> DataFrame:
    """U16: one row of whole-dataset totals (units rounded to a whole number)."""
    f = star.fact
    # Distinct counts as scalar subqueries, each its own dedup (see
    # monthly_kpis); as separate distinct + count plans they are not merged
    # back into one double-distinct aggregate.
    orders = distinct_count(f, "order_id", "n").select("n").scalar()
    buyers = distinct_count(f, "customer_key", "n").select("n").scalar()
    agg = f.agg(
        F.sum("net_amount").alias("_net"),
        F.sum("profit_amount").alias("_profit"),
        F.sum("quantity").alias("_qty"),
    ).select("*", F.coalesce(orders, F.lit(0)).alias("total_orders"),
             F.coalesce(buyers, F.lit(0)).alias("total_customers"))
    return agg.select(
        F.col("_net").cast(MONEY_SUM).alias("total_revenue"),
        F.col("_profit").cast(MONEY_SUM).alias("total_profit"),
        "total_orders",
        "total_customers",
        div_round(F.col("_net"), F.col("total_orders"), zero=zero, floor=1).alias("aov"),
        div_round(F.col("_profit"), F.col("_net"), times=100, zero=zero, floor=0.01)
        .alias("profit_margin_pct"),
        round_dec(F.col("_qty"), 0).alias("units_sold"),
    )


def dq_sanity_totals(star: Star) -> DataFrame:
    """Total revenue (unrounded sum), distinct orders and AOV."""
    agg = star.fact.agg(
        F.sum("net_amount").alias("_net"), F.countDistinct("order_id").alias("total_orders")
    )
    return agg.select(
        F.col("_net").cast(MONEY_SUM).alias("total_revenue"),
        "total_orders",
        div_round(F.col("_net"), F.col("total_orders")).alias("avg_order_value"),
    )


def dq_monthly(star: Star) -> DataFrame:
    """Order lines and revenue per calendar (year, month)."""
    j = fact_with_month(star, "net_amount")
    return j.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("order_lines"),
        money_sum("net_amount").alias("monthly_revenue"),
    )


def dq_fact_profile(star: Star) -> DataFrame:
    """Fact rows, distinct orders, min / max / mean net amount."""
    return star.fact.agg(
        F.count(F.lit(1)).alias("fact_rows"),
        F.countDistinct("order_id").alias("orders"),
        F.min("net_amount").alias("min_net"),
        F.max("net_amount").alias("max_net"),
        div_round(F.sum("net_amount"), F.count("net_amount")).alias("avg_net"),
    )
