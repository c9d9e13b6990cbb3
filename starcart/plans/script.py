"""SQL scripts with session variables over the warehouse's views.

A statement may set a variable that later ones read: ``DECLARE OR REPLACE VARIABLE`` and
``SET VARIABLE x = (SELECT ...)`` are the session's own; the value is computed once, when it
is set, and stands as a constant in the statements that follow. ``run_script`` runs
statements in order over a star's announced views and gives the last one's result. The
variables are dropped by name when the script starts anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.schema import Star
from .views import query, register_views


def run_script(spark: SparkSession, star: Star, statements: list[str], prefix: str = "script_") -> DataFrame:
    """The result of the last statement; ``{p}`` in a statement stands for the views' prefix."""
    register_views(star, prefix)
    out = None
    for statement in statements:
        out = query(spark, statement.replace("{p}", prefix))
    return out


# The months after the newest sale less half a year, against the average order of all time.
RECENT_MONTHS = [
    "DECLARE OR REPLACE VARIABLE newest DATE",
    "DECLARE OR REPLACE VARIABLE lines_of_all BIGINT DEFAULT 0",
    "SET VARIABLE newest = (SELECT max(full_date) FROM {p}fact_order_line JOIN {p}dim_date USING (date_key))",
    "SET VARIABLE lines_of_all = (SELECT count(*) FROM {p}fact_order_line)",
    """SELECT year, month, count(*) AS order_lines, CAST(sum(net_amount) AS decimal(20,2)) AS revenue, newest AS newest_date,
              lines_of_all AS lines_of_all
       FROM {p}fact_order_line JOIN {p}dim_date USING (date_key)
       WHERE full_date > add_months(newest, -6) GROUP BY year, month""",
]


def recent_months(star: Star) -> DataFrame:
    """Lines and revenue of each month of the last half year, its bound set as a session variable first."""
    return run_script(star.product.sparkSession, star, RECENT_MONTHS)
