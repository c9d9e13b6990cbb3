"""SQL access: the warehouse's named views as Spark temp views.

``register_views`` announces the seven star tables and the warehouse's named
views (v_monthly_kpis ... v_recommendation_top4), so dashboard SQL -- including
parameterised lookups such as ``... WHERE source_product_key = ?`` -- runs unchanged
through ``query``, which puts the views a statement names into the session catalog.
Each view is the DataFrame of the operator; Catalyst plans the SQL on top of it exactly
as for DataFrame code.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import customer, kpi, product, recommend
from ..sources.schema import TABLE_FIELDS, Star

REFERENCE_VIEWS = {
    "v_monthly_kpis": kpi.monthly_kpis,
    "v_monthly_revenue_growth": kpi.monthly_revenue_growth,
    "v_top_products_by_revenue": product.top_products_by_revenue,
    "v_category_revenue_share": product.category_revenue_share,
    "v_customer_lifetime_value": customer.customer_lifetime_value,
    "v_repeat_purchase_rate": customer.repeat_purchase_rate,
    "v_recommendation_top4": recommend.recommendation_top4,
}


# Views announced in a session and not yet made: session -> name -> how to make it.
_ANNOUNCED: dict[SparkSession, dict[str, Callable[[], DataFrame]]] = {}


def register_views(star: Star, prefix: str = "") -> list[str]:
    """Announce the star tables and the named views; returns the view names.

    Nothing is planned, read or written here: ``query`` makes the views that a statement
    names, when it first does.
    """
    announced = _ANNOUNCED.setdefault(star.product.sparkSession, {})
    names = {name: (lambda field=field: getattr(star, field)) for name, field in TABLE_FIELDS.items()}
    names |= {name: (lambda fn=fn: fn(star)) for name, fn in REFERENCE_VIEWS.items()}
    announced.update({prefix + name: make for name, make in names.items()})
    return [prefix + name for name in names]


def make_views(spark: SparkSession, text: str) -> None:
    """Create the announced views that a statement names."""
    announced = _ANNOUNCED.get(spark, {})
    for name in {w.lower() for w in re.findall(r"\w+", text)} & {n.lower() for n in announced}:
        exact = next(n for n in announced if n.lower() == name)
        announced.pop(exact)().createOrReplaceTempView(exact)


def query(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """Run SQL with positional (``?``) or named (``:name``) parameters over the announced views."""
    make_views(spark, text)
    return spark.sql(text, args=args) if args is not None else spark.sql(text)
