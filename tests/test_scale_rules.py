"""Whole ids beyond nine digits, fresh answers after an input changes, tables built on demand."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from tests.paths import SF_SMALL
from starcart import registry
from starcart.operators import kpi, recommend
from starcart.operators.recommend import product_signals
from starcart.plans import warehouse
from starcart.sources import driver

SHIFT = 1_196_000_000  # keeps every modulus of the adapter


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The small tables with ten-digit order, product and customer keys."""
    folder = tmp_path_factory.mktemp("shifted")
    keys = {"l_orderkey", "o_orderkey", "p_partkey", "l_partkey", "c_custkey", "o_custkey"}
    for name in driver.DRIVER_TABLES:
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        for c in keys & set(df.columns):
            df = df.withColumn(c, (F.col(c) + SHIFT).cast("long"))
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_ten_digit_keys_change_no_answer(spark, shifted):
    a, b = warehouse.warehouse_star(spark, SF_SMALL), warehouse.warehouse_star(spark, shifted)
    assert kpi.overview_kpis(a).collect() == kpi.overview_kpis(b).collect()
    pairs = [sorted(tuple(r) for r in recommend.copurchase_pairs(s).select(
        *[(F.col(c) - shift).alias(c) for c in ("source_product_key", "candidate_product_key")], "co_purchase_count").collect())
        for s, shift in ((a, 0), (b, SHIFT))]
    assert pairs[0] == pairs[1]
    scores = [sorted((r[0] - shift, r[1] - shift, r[2]) for r in recommend.recommendation_top4(s).select(
        "source_product_key", "candidate_product_key", "recommendation_score").collect()) for s, shift in ((a, 0), (b, SHIFT))]
    assert scores[0] == scores[1]


def test_ids_are_padded_and_never_cut(spark):
    from starcart.functions.numeric import padded

    df = spark.createDataFrame([(7,), (123456789,), (1234567890,), (1234567891,)], "k long")
    assert [r[0] for r in df.select(padded(F.col("k"), 9)).collect()] == ["000000007", "123456789", "1234567890", "1234567891"]


def test_a_replaced_file_is_read_anew(spark, tmp_path):
    for name in driver.DRIVER_TABLES:
        shutil.copy(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    queries = registry.queries()

    def lines():
        rows = {r["table_name"]: r["row_count"] for r in queries["dq_row_counts"](spark, str(tmp_path)).collect()}
        return rows["fact_order_line"], queries["product_pairs"](spark, str(tmp_path)).count()

    before = lines()
    few = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").limit(100).toPandas()
    few.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    after = lines()
    assert after[0] == 100 < before[0] and after[1] < before[1]


def test_product_queries_do_not_read_the_lines(spark, monkeypatch, tmp_path):
    written = []
    monkeypatch.setattr(warehouse, "write_table", lambda df, path: written.append(path))
    for name in ("product_detail", "active_product_list", "product_unit_margin"):
        plan = registry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().toString()
        assert "lineitem" not in plan and "l_orderkey" not in plan
    assert written == []


def test_a_persistent_folder_is_used(spark, tmp_path):
    star = warehouse.warehouse_star(spark, SF_SMALL, folder=str(tmp_path))
    assert star.fact.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert list(tmp_path.glob("*/fact_order_line/*.parquet"))


def test_margins_beyond_a_long(spark):
    """Margin sums above 9.2e18 (in 1e-8 units) keep the right mean."""
    facts = spark.createDataFrame(
        [(o, 1, 1, None, 10**11, 25_000_000 * 10**11) for o in range(8)],
        "order_id int, product_key int, n_dates long, last_date date, n_lines long, margin_units long",
    )
    row = product_signals(None, facts).first()
    assert row["margin_avg"] == pytest.approx(0.25) and row["_msum"] == 8 * 25_000_000 * 10**11


def test_stages_of_ranked_queries_are_shared(spark):
    star = warehouse.warehouse_star(spark, SF_SMALL)
    from starcart.operators import customer, product

    customer.customer_lifetime_value(star).count()
    product.top_products_by_revenue(star).count()
    before = dict(warehouse._BUILT)
    for _ in range(2):
        customer.customer_lifetime_value(star).count()
        customer.quartile_breakdown(star).count()
        customer.top_customers_by_clv(star).count()
        product.top_products_by_revenue(star).count()
    assert dict(warehouse._BUILT) == before


def test_the_mart_is_scanned_twice_for_the_ranking(spark):
    star = warehouse.warehouse_star(spark, SF_SMALL)
    plan = recommend.recommendation_top4(star)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("subcategory_s") and plan.count("in_dim_s") <= 8
    assert sum("pairs-" in line or "in_dim_s" in line and "Relation" in line for line in plan.splitlines()) <= 2
