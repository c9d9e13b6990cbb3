"""Adapter: the driver's TPC-H-like parquet tables -> the retail ``Star``.

The mapping (FIXTURES.md section B) keeps the traps of the warehouse: the date
key comes from the line's ship date (so one order spans several dates), the
fact's category comes from the supplier and is unrelated to the product's
subcategory, every 20th product is inactive, and amounts are exact decimals.

Everything is lazy; only the columns a query needs reach the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import padded
from .schema import Star

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
)

# The six category rows of the driver mapping (key, name, parent).
DRIVER_CATEGORIES = [
    (1, "ECONOMY", "Class"),
    (2, "LARGE", "Size"),
    (3, "MEDIUM", "Size"),
    (4, "PROMO", "Class"),
    (5, "SMALL", "Size"),
    (6, "STANDARD", "Class"),
]


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One driver table. ``spread``: an input that arrives in fewer splits than
    the session's parallelism (one unsplittable row group, say) is spread
    round-robin first, so the join and the decimal arithmetic after it run on
    all cores. A large input has many splits and is left alone."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread:
        parallelism = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < parallelism:
            df = df.repartition(parallelism)
    return df


def _padded(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), padded(key, width))


def _date_key(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def dim_product(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_key"),
        _padded("PROD", F.col("p_partkey"), 9).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("subcategory"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("unit_price"),
        F.expr(
            "cast(round(cast(p_retailprice as decimal(10,2)) * "
            "cast((62 + p_partkey % 23) * 0.01 as decimal(4,2)), 2) as decimal(10,2))"
        ).alias("cost_price"),
        (F.col("p_partkey") % 20 != 0).alias("is_active"),
    )


def dim_category(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(
        DRIVER_CATEGORIES, "category_key int, category_name string, parent_category string"
    )
    return rows.select(
        "category_key",
        _padded("CAT", F.col("category_key"), 3).alias("category_id"),
        "category_name",
        "parent_category",
    )


def dim_customer(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    age = (F.col("c_custkey") % 4).cast("int")
    return joined.select(
        F.col("c_custkey").alias("customer_key"),
        _padded("CUST", F.col("c_custkey"), 9).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("customer_segment"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("region"),
        F.when(age == 0, "18-25").when(age == 1, "26-35").when(age == 2, "36-50")
        .otherwise("51+").alias("age_group"),
    )


def dim_payment(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_key"),
        F.col("o_orderpriority").alias("payment_method"),
    ).distinct()


def dim_shipping(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("shipping_key"), F.col("s_name").alias("carrier")
    )


def dim_date(lineitem: DataFrame) -> DataFrame:
    # One row per distinct ship day; the partial aggregate collapses the scan
    # map-side, so the shuffle carries at most (#days x #map tasks) rows.
    ts = F.col("l_shipdate")
    return lineitem.select(
        _date_key(ts).alias("date_key"),
        ts.cast("date").alias("full_date"),
        F.year(ts).cast("int").alias("year"),
        F.month(ts).cast("int").alias("month"),
    ).distinct()


def fact_order_line(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines with exact decimal measures.

    lineitem x orders is the one large-large join of the adapter (sort-merge on
    the order key); only o_custkey and o_orderpriority cross it.
    """
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    gross = F.col("l_extendedprice").cast("decimal(10,2)")
    fact = joined.select(
        _date_key(F.col("l_shipdate")).alias("date_key"),
        F.col("o_custkey").alias("customer_key"),
        F.col("l_partkey").alias("product_key"),
        (F.lit(1) + F.col("l_suppkey") % 6).cast("int").alias("category_key"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_key"),
        F.col("l_suppkey").alias("shipping_key"),
        _padded("ORD", F.col("l_orderkey"), 9).alias("order_id"),
        F.col("l_quantity").cast("decimal(10,2)").alias("quantity"),
        gross.alias("gross_amount"),
        F.round(gross * F.col("l_discount").cast("decimal(4,2)"), 2)
        .cast("decimal(10,2)").alias("discount_amount"),
    )
    fact = fact.withColumn(
        "net_amount", (F.col("gross_amount") - F.col("discount_amount")).cast("decimal(10,2)")
    )
    fact = fact.withColumn(
        "cost_amount",
        F.expr(
            "cast(round(net_amount * cast((62 + product_key % 26) * 0.01 as decimal(4,2)), 2) "
            "as decimal(10,2))"
        ),
    )
    return fact.withColumn(
        "profit_amount", (F.col("net_amount") - F.col("cost_amount")).cast("decimal(10,2)")
    )


def driver_star(spark: SparkSession, sf_dir: str, spread: bool = False) -> Star:
    big = {"lineitem"}  # the fact side; orders is joined (broadcast when small)
    t = {name: read_table(spark, sf_dir, name, spread and name in big) for name in DRIVER_TABLES}
    return Star(
        date=dim_date(t["lineitem"]),
        customer=dim_customer(t["customer"], t["nation"], t["region"]),
        category=dim_category(spark),
        product=dim_product(t["part"]),
        payment=dim_payment(t["orders"]),
        shipping=dim_shipping(t["supplier"]),
        fact=fact_order_line(t["lineitem"], t["orders"]),
    )
