"""Catalog report: tables of the star with their width and size, and the declared keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schema import FOREIGN_KEYS, Star


def catalog_tables(star: Star) -> DataFrame:
    """(table_name, column_count, row_count) for the seven tables."""
    frames = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("column_count"), "row_count"
        )
        for name, df in star.tables().items()
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


def catalog_foreign_keys(spark: SparkSession) -> DataFrame:
    """The declared foreign keys of the fact (metadata, not data)."""
    return spark.createDataFrame(
        [("fact_order_line", name, col, ref, ref_col) for name, col, ref, ref_col in FOREIGN_KEYS],
        "table_name string, constraint_name string, column_name string, "
        "referenced_table_name string, referenced_column_name string",
    )
