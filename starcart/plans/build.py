"""Batch warehouse build and the serving read of the recommendation table.

build(): data-quality gate -> KPI tables -> recommendation table -> checks,
each written as parquet under one output folder. The recommendation table is
range-partitioned and sorted by source product, so a lookup of one product
(``serve_recommendations``) is a pushed-down filter that skips every file and
row group whose min/max statistics exclude the key, instead of recomputing the
co-purchase pipeline per request.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import customer, kpi, product, quality, rec_checks, recommend
from ..sources.schema import Star
from .warehouse import once_per_star, written_path

KPI_TABLES = {
    "monthly_kpis": kpi.monthly_kpis,
    "monthly_revenue_growth": kpi.monthly_revenue_growth,
    "overview_kpis": kpi.overview_kpis,
    "top_products_by_revenue": product.top_products_by_revenue,
    "category_revenue_share": product.category_revenue_share,
    "customer_lifetime_value": customer.customer_lifetime_value,
    "repeat_purchase_rate": customer.repeat_purchase_rate,
    "customer_segments": customer.customer_segments,
}


class QualityGateError(RuntimeError):
    pass


def quality_report(star: Star) -> DataFrame:
    frames = [quality.dq_orphans(star), quality.dq_arithmetic(star), quality.dq_constraints(star)]
    return reduce(lambda a, b: a.unionByName(b), frames)


def quality_gate(star: Star) -> None:
    """Raise if any check reports an issue (the report has one row per check)."""
    failed = quality_report(star).where(F.col("issue_count") > 0).collect()
    if failed:
        raise QualityGateError(", ".join(f"{r.check_name}={r.issue_count}" for r in failed))


def write_recommendations(recs: DataFrame, path: str, files: int | None = None) -> None:
    """Range-partition by source and sort, so each file holds a narrow key range.

    Without ``files`` AQE sizes the ranges (adjacent ranges are coalesced to
    its advisory size), so a large shuffle-partition setting does not turn
    into thousands of tiny files.
    """
    ranged = (recs.repartitionByRange(files, "source_product_key") if files
              else recs.repartitionByRange("source_product_key"))
    (ranged.sortWithinPartitions("source_product_key", "recommendation_rank")
     .write.mode("overwrite").parquet(path))


def build(star: Star, out: str, gate: bool = True, **rec_kw) -> dict[str, str]:
    """Run the whole warehouse build; returns table name -> path."""
    if gate:
        quality_gate(star)
    paths: dict[str, str] = {}
    for name, fn in KPI_TABLES.items():
        paths[name] = f"{out}/{name}"
        fn(star).write.mode("overwrite").parquet(paths[name])
    paths["recommendation_top4"] = f"{out}/recommendation_top4"
    write_recommendations(recommend.recommendation_top4(star, **rec_kw), paths["recommendation_top4"])
    recs = star.fact.sparkSession.read.parquet(paths["recommendation_top4"])
    checks = {
        "rec_coverage": rec_checks.rec_coverage(recs),
        "rec_missing": rec_checks.rec_missing(star.product, recs),
        "rec_self_check": rec_checks.rec_self_check(recs),
        "rec_score_stats": rec_checks.rec_score_stats(recs),
        "rec_diversity": rec_checks.rec_diversity(recs),
    }
    for name, df in checks.items():
        paths[name] = f"{out}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def served_recommendations(star: Star) -> str:
    """Path of a star's recommendation table, clustered by source and written on first use."""
    def make() -> DataFrame:
        recs = recommend.recommendation_top4(star)
        return recs.repartitionByRange("source_product_key").sortWithinPartitions("source_product_key", "recommendation_rank")

    once_per_star(star, "served-recommendations", make)
    return written_path(star, "served-recommendations")


def serve_recommendations(spark: SparkSession, path: str, product_key: int) -> DataFrame:
    """U28 serving path: <= 4 rows of one source product, in rank order."""
    recs = spark.read.parquet(path)
    return recs.where(F.col("source_product_key") == F.lit(product_key)).orderBy("recommendation_rank")
