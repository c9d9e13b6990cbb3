"""Batch build + serving read, quality gate, and the streaming KPI refresh."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from tests.paths import SF_SMALL
from micro import micro_star
from starcart.operators import kpi, quality, recommend
from starcart.plans import build as B
from starcart.plans.warehouse import warehouse_star
from starcart.streaming.refresh import read_monthly, start_monthly_refresh


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_build_and_serve(spark):
    star = micro_star(spark)
    out = tempfile.mkdtemp(prefix="starcart-build-", dir="/tmp")
    paths = B.build(star, out, gate=False)
    served = B.serve_recommendations(spark, paths["recommendation_top4"], 1)
    assert rows(served) == rows(recommend.recommendations_for_product(star, 1))
    plan = served._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "source_product_key" in plan
    assert rows(spark.read.parquet(paths["monthly_kpis"])) == rows(kpi.monthly_kpis(star))


def test_quality_gate(spark):
    star = warehouse_star(spark, SF_SMALL)
    B.quality_gate(star)  # clean data passes
    with pytest.raises(B.QualityGateError, match="missing_product"):
        B.quality_gate(star.with_fact(quality.corrupted_fact(star.fact)))


def test_streaming_refresh_matches_batch(spark):
    star = warehouse_star(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="starcart-stream-", dir="/tmp")
    fact_dir, out, ckpt = f"{root}/fact", f"{root}/kpis", f"{root}/ckpt"
    # The second batch touches months that already have lines: each touched
    # month must be recomputed from all of its lines, not patched.
    early = star.fact.where(F.col("customer_key") % 2 == 0)
    late = star.fact.where(F.col("customer_key") % 2 == 1)
    early.write.mode("append").parquet(fact_dir)
    start_monthly_refresh(spark, star, fact_dir, out, ckpt).awaitTermination()
    late.write.mode("append").parquet(fact_dir)
    start_monthly_refresh(spark, star, fact_dir, out, ckpt).awaitTermination()
    got = read_monthly(spark, out).select(*kpi.monthly_kpis(star).columns)
    assert rows(got) == rows(kpi.monthly_kpis(star))
