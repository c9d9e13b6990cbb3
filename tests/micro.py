"""The 9-line golden star of FIXTURES.md section C, built as Spark DataFrames."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from starcart.sources.schema import Star

D = Decimal

# (date, customer, product, category, order, qty, gross, disc, net, cost, profit)
LINES = [
    ("2025-01-10", 1, 1, 1, "O1", 1, 100, 0, 100, 60, 40),
    ("2025-01-12", 1, 2, 2, "O1", 2, 200, 20, 180, 120, 60),
    ("2025-02-05", 1, 1, 1, "O2", 1, 100, 10, 90, 60, 30),
    ("2025-02-05", 2, 2, 1, "O2", 1, 100, 0, 100, 70, 30),
    ("2025-02-06", 1, 3, 3, "O2", 1, 50, 0, 50, 40, 10),
    ("2025-04-01", 3, 1, 1, "O3", 1, 100, 0, 100, 60, 40),
    ("2025-04-02", 3, 1, 1, "O3", 1, 100, 0, 100, 60, 40),
    ("2025-04-02", 3, 4, 2, "O3", 1, 400, 0, 400, 500, -100),
    ("2025-04-03", 2, 5, 3, "O4", 1, 0, 0, 0, 0, 0),
]
PRODUCTS = [(1, "Phones", True), (2, "Tablets", True), (3, "Phones", True), (4, None, False),
            (5, "Chargers", True)]
CATEGORIES = [(1, "Phones", "Mobile"), (2, "Tablets", "Mobile"), (3, "Chargers", "Accessories")]
CUSTOMERS = [(1, "VIP"), (2, "New"), (3, "VIP")]


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def micro_star(spark: SparkSession, lines=LINES, products=PRODUCTS, categories=CATEGORIES) -> Star:
    dates = sorted({_d(r[0]) for r in lines})
    date = spark.createDataFrame(
        [(int(x.strftime("%Y%m%d")), x, x.year, x.month) for x in dates],
        "date_key int, full_date date, year int, month int",
    )
    fact = spark.createDataFrame(
        [
            (int(_d(r[0]).strftime("%Y%m%d")), r[1], r[2], r[3], 1, 1, r[4],
             D(r[5]), D(r[6]), D(r[7]), D(r[8]), D(r[9]), D(r[10]))
            for r in lines
        ],
        "date_key int, customer_key long, product_key long, category_key int, payment_key int, "
        "shipping_key long, order_id string, quantity decimal(10,2), gross_amount decimal(10,2), "
        "discount_amount decimal(10,2), net_amount decimal(10,2), cost_amount decimal(10,2), "
        "profit_amount decimal(10,2)",
    )
    product = spark.createDataFrame(
        [(k, f"P{k}", f"Product {k}", "Brand", sub, D("10.00"), D("6.00"), act) for k, sub, act in products],
        "product_key long, product_id string, product_name string, brand string, subcategory string, "
        "unit_price decimal(10,2), cost_price decimal(10,2), is_active boolean",
    )
    category = spark.createDataFrame(
        [(k, f"C{k}", n, p) for k, n, p in categories],
        "category_key int, category_id string, category_name string, parent_category string",
    )
    customer = spark.createDataFrame(
        [(k, f"U{k}", f"Customer {k}", seg, "City", "Region", "26-35") for k, seg in CUSTOMERS],
        "customer_key long, customer_id string, customer_name string, customer_segment string, "
        "city string, region string, age_group string",
    )
    payment = spark.createDataFrame([(1, "Card")], "payment_key int, payment_method string")
    shipping = spark.createDataFrame([(1, "Carrier")], "shipping_key long, carrier string")
    return Star(date=date, customer=customer, category=category, product=product,
                payment=payment, shipping=shipping, fact=fact)
