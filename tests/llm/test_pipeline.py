from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from starcart.llm import queries
from tests.llm.test_decontaminate import brute_force as windows
from tests.llm.test_jaccard import brute_force as classes
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage over the smallest tables, with edge rows and a clashing column added."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("score", F.lit(1))
    again = docs.limit(3).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    none = docs.limit(2).withColumn("text", F.lit(None).cast("string"))
    docs, out = docs.unionByName(again).unionByName(none), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF)
        result.write.parquet(f"{folder}/{name}")
        result = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, result)
        docs = result
    return out


def ids(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_filters_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert 0 < after.count() <= before.count()


def test_toxicity_stage(spark, stages):
    from starcart.llm import toxicity

    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(queries.training_fold())
    scored = toxicity.score(before.drop("score"), toxicity.train(before, labels))
    assert ids(scored.where("score < 0.7")) == ids(after)


def test_quality_stage(spark, stages):
    from starcart.llm import quality
    from tests.llm.test_quality import counts

    before, after = stages["quality"]
    judged = quality.judge(before.drop("kept"), quality.train(before, spark.read.parquet(f"{SF}/labels.parquet")))
    assert ids(judged.where("kept")) == ids(after)
    for r in after.collect():
        n, *_, repeated = counts(r["text"])
        assert n >= 50 and 2 * repeated <= n


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]
    rows = [(i, r["text"]) for i, r in enumerate(before.select("text").collect())]
    kept = classes(rows)
    groups = len({c for _, _, c in kept})
    assert after.count() == groups
    left = classes([(i, r["text"]) for i, r in enumerate(after.select("text").collect())])
    assert len({c for _, _, c in left}) == groups


def test_near_duplicates_when_files_are_cut_otherwise_meanwhile(spark, table, tmp_path, monkeypatch):
    """Between the join and the removal of copies the scan is packed into other tasks (as when executors come or go)."""
    rows = [(i, " ".join(f"w{i // 2 if i % 4 < 2 else i}x{k}" for k in range(20))) for i in range(80)]
    table(rows).repartition(16, "doc_id").write.parquet(f"{tmp_path}/docs")
    write, conf = corpus_pipeline.materialize, "spark.sql.files.openCostInBytes"
    before = spark.conf.get(conf)

    def meanwhile(df, name):
        written = write(df, name)
        if name == "other-copies":
            spark.conf.set(conf, str(1 << 30))
        return written

    monkeypatch.setattr(corpus_pipeline, "materialize", meanwhile)
    spark.conf.set(conf, "1")
    try:
        left = corpus_pipeline.one_of_each_class(spark, spark.read.parquet(f"{tmp_path}/docs"), SF).collect()
    finally:
        spark.conf.set(conf, before)
    assert sorted(r["text"] for r in left) == sorted({text for _, text in rows})


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(i, r["text"]) for i, r in enumerate(before.select("text").collect())]
    clean = {d for d, _, hit, *_ in windows(rows, items) if not hit}
    assert sorted(rows[d][1] for d in clean) == sorted(r["text"] for r in after.select("text").collect())


def test_packing_stage(stages):
    before, after = stages["packing"]
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    made, tokens = check_packing(rows, after.collect(), 2048)
    assert made <= -(-tokens // 2048) + 1


def test_run_and_registration(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    got = names["pipeline"](spark, SF)
    assert got.columns[:3] == ["doc_id", "piece", "start"] and got.count() > 0
    assert set(queries.sql()) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.sql()[name]})").fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())
