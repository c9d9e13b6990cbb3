"""Checks over the recommendation table (coverage, gaps, self pairs, scores, diversity).

Each takes the top-k table (a DataFrame) so it can run on the persisted table
or on a freshly computed one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import div_round, round_dec


def rec_coverage(recs: DataFrame, n: int = 20) -> DataFrame:
    """U32: recommendations per source product, most first (ties by id), top n."""
    return recs.groupBy("source_product_id").agg(
        F.count(F.lit(1)).alias("recommendations_per_product")
    ).orderBy(F.col("recommendations_per_product").desc(), F.col("source_product_id")).limit(n)


def rec_missing(products: DataFrame, recs: DataFrame) -> DataFrame:
    """Active products that own no recommendation (anti join, not outer + IS NULL)."""
    active = products.filter(F.col("is_active"))
    sources = recs.select(F.col("source_product_key").alias("product_key"))
    return active.join(sources, "product_key", "left_anti").select(
        "product_id", "product_name", F.lit(0).cast("long").alias("rec_count")
    )


def rec_self_check(recs: DataFrame) -> DataFrame:
    """Count of rows recommending a product to itself (expected 0), as one row."""
    return recs.agg(
        F.count_if(F.col("source_product_key") == F.col("candidate_product_key")).alias("issue_count")
    ).select(F.lit("self_recommendation").alias("check_name"), "issue_count")


def rec_score_stats(recs: DataFrame) -> DataFrame:
    """Min / mean / max / population standard deviation of the score."""
    s = F.col("recommendation_score")
    return recs.agg(
        F.min(s).alias("min_score"),
        div_round(F.sum(s), F.count(s), 6).alias("avg_score"),
        F.max(s).alias("max_score"),
        round_dec(F.stddev_pop(s), 6).alias("stddev_score"),
    )


def rec_diversity(recs: DataFrame, n: int = 10) -> DataFrame:
    """How many sources recommend each candidate, top n (ties by id)."""
    return recs.groupBy("candidate_product_id").agg(
        F.countDistinct("source_product_id").alias("appears_in_n_recommendations")
    ).orderBy(F.col("appears_in_n_recommendations").desc(), F.col("candidate_product_id")).limit(n)
