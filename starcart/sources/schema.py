"""Star schema: typed StructTypes, declared constraints and the ``Star`` bundle."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

DIM_DATE = T.StructType([
    T.StructField("date_key", T.IntegerType(), False),
    T.StructField("full_date", T.DateType(), False),
    T.StructField("day_of_week", T.IntegerType(), False),
    T.StructField("day_name", T.StringType(), False),
    T.StructField("day_of_month", T.IntegerType(), False),
    T.StructField("day_of_year", T.IntegerType(), False),
    T.StructField("week_number", T.IntegerType(), False),
    T.StructField("month", T.IntegerType(), False),
    T.StructField("month_name", T.StringType(), False),
    T.StructField("quarter", T.IntegerType(), False),
    T.StructField("year", T.IntegerType(), False),
    T.StructField("is_weekend", T.BooleanType(), False),
    T.StructField("is_holiday", T.BooleanType(), False),
])

DIM_CUSTOMER = T.StructType([
    T.StructField("customer_key", T.LongType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("customer_name", T.StringType(), False),
    T.StructField("email", T.StringType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("age_group", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("registration_date", T.DateType(), True),
    T.StructField("customer_segment", T.StringType(), True),
])

DIM_CATEGORY = T.StructType([
    T.StructField("category_key", T.IntegerType(), False),
    T.StructField("category_id", T.StringType(), False),
    T.StructField("category_name", T.StringType(), False),
    T.StructField("parent_category", T.StringType(), True),
    T.StructField("seasonal_flag", T.BooleanType(), True),
])

DIM_PRODUCT = T.StructType([
    T.StructField("product_key", T.LongType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("product_name", T.StringType(), False),
    T.StructField("brand", T.StringType(), True),
    T.StructField("subcategory", T.StringType(), True),
    T.StructField("unit_price", MONEY, True),
    T.StructField("cost_price", MONEY, True),
    T.StructField("launch_date", T.DateType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])

DIM_PAYMENT = T.StructType([
    T.StructField("payment_key", T.IntegerType(), False),
    T.StructField("payment_id", T.StringType(), False),
    T.StructField("payment_method", T.StringType(), False),
    T.StructField("payment_provider", T.StringType(), True),
])

DIM_SHIPPING = T.StructType([
    T.StructField("shipping_key", T.LongType(), False),
    T.StructField("shipping_id", T.StringType(), False),
    T.StructField("shipping_type", T.StringType(), False),
    T.StructField("carrier", T.StringType(), True),
    T.StructField("delivery_days", T.IntegerType(), True),
    T.StructField("shipping_cost", MONEY, True),
])

FACT_ORDER_LINE = T.StructType([
    T.StructField("date_key", T.IntegerType(), False),
    T.StructField("customer_key", T.LongType(), False),
    T.StructField("product_key", T.LongType(), False),
    T.StructField("category_key", T.IntegerType(), False),
    T.StructField("payment_key", T.IntegerType(), False),
    T.StructField("shipping_key", T.LongType(), False),
    T.StructField("order_id", T.StringType(), False),
    T.StructField("quantity", MONEY, False),
    T.StructField("gross_amount", MONEY, False),
    T.StructField("discount_amount", MONEY, False),
    T.StructField("net_amount", MONEY, False),
    T.StructField("cost_amount", MONEY, False),
    T.StructField("profit_amount", MONEY, False),
])

SCHEMAS = {
    "dim_date": DIM_DATE,
    "dim_customer": DIM_CUSTOMER,
    "dim_category": DIM_CATEGORY,
    "dim_product": DIM_PRODUCT,
    "dim_payment": DIM_PAYMENT,
    "dim_shipping": DIM_SHIPPING,
    "fact_order_line": FACT_ORDER_LINE,
}

# Declared constraints of the warehouse (fixed values: table, key columns).
PRIMARY_KEYS = {
    "dim_date": ["date_key"],
    "dim_customer": ["customer_key"],
    "dim_category": ["category_key"],
    "dim_product": ["product_key"],
    "dim_payment": ["payment_key"],
    "dim_shipping": ["shipping_key"],
}
UNIQUE_KEYS = {
    "dim_date": ["full_date"],
    "dim_customer": ["customer_id"],
    "dim_category": ["category_id"],
    "dim_product": ["product_id"],
    "dim_payment": ["payment_id"],
    "dim_shipping": ["shipping_id"],
}
# (constraint name, fact column, referenced table, referenced column)
FOREIGN_KEYS = [
    ("fk_fact_date", "date_key", "dim_date", "date_key"),
    ("fk_fact_customer", "customer_key", "dim_customer", "customer_key"),
    ("fk_fact_product", "product_key", "dim_product", "product_key"),
    ("fk_fact_category", "category_key", "dim_category", "category_key"),
    ("fk_fact_payment", "payment_key", "dim_payment", "payment_key"),
    ("fk_fact_shipping", "shipping_key", "dim_shipping", "shipping_key"),
]
# Column defaults of the declared DDL (fixed values): (table, column) -> value.
DEFAULTS = {
    ("dim_date", "is_weekend"): False,
    ("dim_date", "is_holiday"): False,
    ("dim_customer", "gender"): "Prefer not to say",
    ("dim_customer", "country"): "Egypt",
    ("dim_category", "seasonal_flag"): False,
    ("dim_product", "is_active"): True,
    ("fact_order_line", "discount_amount"): 0,
}
# Domain and length rules of the declared DDL (fixed values).
ENUM_RULES = {("dim_customer", "gender"): ["Male", "Female", "Other", "Prefer not to say"]}
VARCHAR_LIMITS = {
    ("dim_date", "day_name"): 10,
    ("dim_date", "month_name"): 10,
    ("dim_customer", "customer_id"): 50,
    ("dim_customer", "customer_name"): 100,
    ("dim_customer", "email"): 100,
    ("dim_customer", "age_group"): 20,
    ("dim_customer", "city"): 50,
    ("dim_customer", "region"): 50,
    ("dim_customer", "country"): 50,
    ("dim_customer", "customer_segment"): 20,
    ("dim_category", "category_id"): 50,
    ("dim_category", "category_name"): 100,
    ("dim_category", "parent_category"): 100,
    ("dim_product", "product_id"): 50,
    ("dim_product", "product_name"): 200,
    ("dim_product", "brand"): 100,
    ("dim_product", "subcategory"): 50,
    ("dim_payment", "payment_id"): 50,
    ("dim_payment", "payment_method"): 50,
    ("dim_payment", "payment_provider"): 50,
    ("dim_shipping", "shipping_id"): 50,
    ("dim_shipping", "shipping_type"): 50,
    ("dim_shipping", "carrier"): 50,
    ("fact_order_line", "order_id"): 50,
}


# Table of the warehouse -> field of ``Star``.
TABLE_FIELDS = {
    "dim_date": "date", "dim_customer": "customer", "dim_category": "category",
    "dim_product": "product", "dim_payment": "payment", "dim_shipping": "shipping",
    "fact_order_line": "fact",
}


@dataclass(frozen=True)
class Star:
    """The seven warehouse tables as lazy DataFrames."""

    date: DataFrame
    customer: DataFrame
    category: DataFrame
    product: DataFrame
    payment: DataFrame
    shipping: DataFrame
    fact: DataFrame
    # Where the seven tables were read from (a materialised star), else None.
    # Lets derived marts be built once per application for the same star.
    origin: str | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, field) for name, field in TABLE_FIELDS.items()}

    @property
    def lines(self) -> DataFrame:
        """The fact for a reader that passes over it once."""
        return self.fact

    def with_fact(self, fact: DataFrame) -> "Star":
        return Star(self.date, self.customer, self.category, self.product,
                    self.payment, self.shipping, fact)

    def with_defaults(self) -> "Star":
        """Fill NULLs with the declared column defaults, for the columns present."""
        from pyspark.sql import functions as F

        frames = {}
        for (name, df), field in zip(self.tables().items(), [f for f in fields(self) if f.name != "origin"]):
            fills = {c: v for (t, c), v in DEFAULTS.items() if t == name and c in df.columns}
            for c, v in fills.items():
                df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)))
            frames[field.name] = df
        return Star(**frames)
