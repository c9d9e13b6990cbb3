"""Key registry, strict load, buckets, month folders, merged distinct counts, incremental pairs, scripts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from starcart.operators import basket, kpi, quality
from starcart.plans import layout, script, views
from starcart.plans.pair_refresh import PairMart
from starcart.plans.warehouse import warehouse_star
from starcart.sources import loader
from starcart.sources.keys import KeyRegistry
from starcart.sources.schema import TABLE_FIELDS, Star
from tests.paths import SF_SMALL


@pytest.fixture(scope="module")
def star(spark):
    return warehouse_star(spark, SF_SMALL)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- keys -----------------------------------------------------------------------------


def test_keys_are_dense_and_stay(spark, tmp_path):
    registry = KeyRegistry(spark, str(tmp_path / "keys"), ["a", "b"], "k")
    assert registry.keys() is None
    rows = [(3, "x"), (1, "y"), (1, None), (3, "x")]
    first = spark.createDataFrame(rows, "a int, b string")
    registry.append(first)
    before = {(r.a, r.b): r.k for r in registry.keys().collect()}
    assert before == {(1, None): 1, (1, "y"): 2, (3, "x"): 3}
    second = spark.createDataFrame([(0, "new"), (1, None), (None, None), (9, "z")], "a int, b string")
    added = registry.append(second)
    assert sorted(r.k for r in added.collect()) == [4, 5, 6]
    after = {(r.a, r.b): r.k for r in registry.keys().collect()}
    assert {k: after[k] for k in before} == before and after[(0, "new")] == 5 and after[(None, None)] == 4
    assert registry.append(second).count() == 0  # nothing new
    keyed = registry.keyed(first.unionByName(spark.createDataFrame([(77, "?")], "a int, b string")))
    assert sorted((r.k or 0) for r in keyed.collect()) == [0, 1, 2, 3, 3]


def test_a_failed_load_is_invisible(spark, tmp_path):
    registry = KeyRegistry(spark, str(tmp_path / "keys"), ["a"], "k")
    registry.append(spark.range(5).select(F.col("id").alias("a")))
    spark.range(50, 60).select(F.col("id").alias("a"), F.col("id").alias("k")).write.parquet(f"{tmp_path}/keys/load=1")
    (tmp_path / "keys" / "load=1" / "_SUCCESS").unlink()
    assert registry.loads() == 1 and registry.keys().count() == 5
    registry.append(spark.range(3, 8).select(F.col("id").alias("a")))
    assert sorted(r.k for r in registry.keys().collect()) == list(range(1, 9))


# --- strict load ------------------------------------------------------------------------


def test_loaded_and_rejected_are_the_input(star):
    faulty = quality.corrupted_star(star)
    faulty = faulty.with_fact(quality.corrupted_fact(faulty.fact))
    for name, done in loader.load_star(faulty).items():
        rows = faulty.tables()[name]
        came = done.select("came.*")
        assert came.exceptAll(rows).count() == 0 and rows.exceptAll(came).count() == 0, name
        assert loader.loaded(done).count() + loader.rejected(done).count() == rows.count()
    done = loader.load_star(faulty)
    sound = Star(**{field: loader.loaded(done[table]) for table, field in TABLE_FIELDS.items()})
    assert quality.dq_constraints(sound).where("issue_count > 0").count() == 0


def test_types_defaults_and_reasons(spark):
    rules = loader.TableRules(
        types={f.name: f.dataType for f in spark.createDataFrame([], "id int, day date, flag boolean, name string, kind string, ref long").schema},
        required=["id", "day"], defaults={"flag": True}, enums={"kind": ["a", "b"]}, lengths={"name": 3}, unique=["id"], references={"ref": ("dim", "key")},
    )
    rows = spark.createDataFrame(
        [("1", "2024-01-02", None, "abc", "a", "7"), ("x", "2024-01-02", "false", "abcd", "c", "8"), ("2", None, "maybe", None, None, None),
         ("1", "2024-01-02", None, "abc", "a", "7")],
        "id string, day string, flag string, name string, kind string, ref string",
    )
    dim = spark.createDataFrame([(7,), (7,)], "key long")
    done = loader.split(rows, rules, {"dim": dim})
    assert sorted(tuple(r.reasons) for r in done.collect()) == [
        (), ("duplicate:id",), ("type:flag", "not_null:day"), ("type:id", "enum:kind", "length:name", "key:ref"),
    ]
    kept = loader.loaded(done).first()
    assert (kept.id, str(kept.day), kept.flag, kept.ref) == (1, "2024-01-02", True, 7)
    assert loader.rejected(done).columns == [*rows.columns, "reject_reasons"]


# --- buckets and months -----------------------------------------------------------------


def test_bucketed_aggregate_and_join_have_no_exchange(spark, star):
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        lines = layout.bucketed_lines(star)
        aggregate = plan(lines.groupBy("order_id", "product_key").agg(F.max("date_key")))
        assert "Exchange" not in aggregate and "Bucketed: true" in aggregate
        pairs = plan(layout.pairs_in_place(layout.bucketed_products(star)))
        assert "SortMergeJoin" in pairs and "Exchange" not in pairs
    finally:
        spark.conf.set(conf, before)


def test_lookup_opens_one_bucket(spark, star):
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not name the buckets
    try:
        df = layout.lookup_first_order(star)
        assert "SelectedBucketsCount: 1 out of" in plan(df)
        assert df.count() == 1 or df.select(F.input_file_name()).distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


@pytest.mark.parametrize("block_size", [2048, 2])
def test_bucketed_pairs(star, block_size):
    items = layout.bucketed_products(star)
    got = basket.aggregate_pairs(layout.pairs_in_place(items, block_size))
    want = basket.product_pairs(star).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_months_are_pruned_by_the_calendar(star):
    df = layout.latest_quarter_kpis(star)
    assert "dynamicpruning" in plan(df) and df.count() == 3
    months = layout.month_lines(star)
    assert months.count() == star.fact.count()
    whole = kpi.monthly_kpis(star)
    part = df.select(*whole.columns)
    assert part.exceptAll(whole).count() == 0


def test_distinct_states_merge(star):
    got = layout.distinct_by_period(star, "customer_key", "n")
    years = {r.year: r.n for r in got.where("period = 'year'").collect()}
    want = star.fact.join(star.date, "date_key").groupBy("year").agg(F.countDistinct("customer_key").alias("n"))
    assert years == {r.year: r.n for r in want.collect()}


# --- incremental pairs --------------------------------------------------------------------


@pytest.mark.parametrize("block_size", [2048, 3])
def test_pairs_in_many_batches(spark, star, tmp_path, block_size):
    """Lines arrive in any order, twice, on new days of known orders; the mart equals the full build."""
    lines = star.fact.select("order_id", "product_key", "date_key").where("product_key < 120")
    mart, rng = PairMart(spark, str(tmp_path / "mart"), block_size), random.Random(1)
    cuts = sorted(rng.sample(range(1, 100), 3))
    part = F.pmod(F.xxhash64("order_id", "product_key", "date_key"), F.lit(100))
    for lo, hi in zip([0, *cuts], [*cuts, 100]):
        mart.add(star, lines.where((part >= max(0, lo - 5)) & (part < hi)))  # some lines come again
    want = basket.product_pairs(star.with_fact(star.fact.where("product_key < 120")))
    for got in (mart.pairs(), mart.compact(str(tmp_path / "compact")).pairs()):
        got = got.select(*want.columns)
        assert want.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_an_empty_batch_and_touched_sources(spark, star, tmp_path):
    mart = PairMart(spark, str(tmp_path / "mart"))
    lines = star.fact.select("order_id", "product_key", "date_key")
    mart.add(star, lines.limit(0))
    assert mart.pairs().count() == 0
    order = lines.groupBy("order_id").agg(F.countDistinct("product_key").alias("n")).orderBy(F.desc("n"), "order_id").first()
    mart.add(star, lines.where(F.col("order_id") == order.order_id))
    assert mart.touched_sources(1).count() == order.n
    mart.add(star, lines.where(F.col("order_id") == order.order_id))
    assert mart.touched_sources(2).count() == 0


# --- views and scripts ----------------------------------------------------------------------


def test_registering_views_runs_no_job(spark, star):
    fresh = star.with_fact(star.fact)
    spark.sparkContext.setJobGroup("views", "")
    views.register_views(fresh, "quiet_")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("views")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert views.query(spark, "SELECT count(*) AS n FROM quiet_v_monthly_kpis").first().n > 0


def test_variables_are_set_by_statements(spark, star):
    out = script.run_script(spark, star, [
        "DECLARE OR REPLACE VARIABLE most BIGINT", "SET VARIABLE most = (SELECT max(product_key) FROM {p}dim_product)",
        "SELECT product_key FROM {p}dim_product WHERE product_key = most",
    ])
    assert out.count() == 1


def test_second_call_plans_nothing(spark):
    again = warehouse_star(spark, SF_SMALL)
    assert again is warehouse_star(spark, SF_SMALL)


def test_a_kept_folder_is_read_not_rebuilt(spark, tmp_path, monkeypatch):
    from starcart.plans import warehouse

    first = warehouse_star(spark, SF_SMALL, str(tmp_path))
    assert first.payment.count() == 5
    monkeypatch.setattr(warehouse, "_BUILT", {})
    monkeypatch.setattr(warehouse, "_STARS", {})
    monkeypatch.setattr(warehouse, "write_table", lambda *a: pytest.fail("written again"))
    assert warehouse_star(spark, SF_SMALL, str(tmp_path)).payment.count() == 5
