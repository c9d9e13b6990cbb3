"""The corpus pipeline: toxicity, quality, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and judges all of ``docs``, what its predecessor
kept; ``run`` writes each result as Parquet and reads it back for the next stage. The
filtering stages return the columns of their input: a document travels whole in a struct,
so columns of any name pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcart.llm import decontaminate, jaccard, packing, quality, toxicity
from starcart.llm.common import read
from starcart.llm.queries import TOXIC_FROM, training_fold
from starcart.session import materialize

# Up to so many row numbers (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _boxed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("document"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score as toxic go."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(training_fold()))
    scored = toxicity.score(_boxed(docs), model, "score", text="document.text")
    return scored.where(F.col("score") < TOXIC_FROM).select("document.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that fail the rules or the learned verdict go."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.judge(_boxed(docs), model, text="document.text").where("kept").select("document.*")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near duplicates stays.

    Rows are told apart by a number that is written with them (another scan might cut the
    files otherwise and number them anew), so repeated and null doc_ids need no care; the row
    that stands first stays. Empty documents are no group.
    """
    numbered = materialize(_boxed(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    classes = jaccard.jaccard_classes(numbered.select(F.col("row").alias("doc_id"), F.col("document.text").alias("text")))
    others = materialize(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("row")), "other-copies")
    others = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    return numbered.join(others, "row", "left_anti").select("document.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with words of a benchmark window go."""
    judged = decontaminate.contaminated_words(_boxed(docs), read(spark, sf_dir, "benchmark"), text="document.text")
    return judged.where("not contaminated").select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of all documents in sequences of at most 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, "spaced", end_id=0, length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", one_of_each_class),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The learned stages have no SQL form; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
