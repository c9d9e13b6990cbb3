"""Input columns named like the operators' own and helper columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from starcart.llm import decontaminate, jaccard, licenses, packing, quality, sharding, token_counts, token_files, toxicity

NAMES = ["_hit", "_items", "_sha", "_text_key", "_counted", "_judged", "n_words", "kept", "score", "key", "text_key", "w", "h", "sid", "n", "length",
         "piece", "start", "shard", "slot", "size", "part", "block", "row", "ordinal", "family", "paragraph", "document", "_group", "_block"]


@pytest.fixture
def clashing(edges):
    for name in NAMES:
        edges = edges.withColumn(name, F.lit("clash"))
    return edges


WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.mark.parametrize("name,run,key", [
    ("op1", lambda d: token_counts.count_tokens(d, PIECES), ["doc_id", "n_words", "n_tokens"]),
    ("op2", lambda d: token_files.token_table(d, WORDS, "words", 2, 49_408), ["doc_id", "start", "n_tokens", "ids_crc32"]),
    ("op3", lambda d: toxicity.score(d, None), ["doc_id", "score"]),
    ("op4", lambda d: decontaminate.contaminated_words(d, d.sparkSession.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")),
     ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]),
    ("op5", lambda d: quality.judge(d, None), ["doc_id", "n_words", "word_chars", "kept"]),
    ("op6", lambda d: sharding.shard_documents(d, shards=4), ["doc_id", "size", "shard"]),
    ("op7", lambda d: jaccard.jaccard_classes(d), ["doc_id", "n_shingles", "component_id"]),
    ("op8", lambda d: packing.pack_documents(d, BYTES, "spaced"), ["doc_id", "piece", "start", "length", "ids_crc32"]),
    ("op9", lambda d: licenses.scan(d), ["doc_id", "paragraph", "family"]),
])
def test_clashing_columns_change_nothing(edges, clashing, name, run, key):
    rows = lambda df: sorted(map(repr, (tuple(r) for r in run(df).select(*key).collect())))
    assert rows(clashing) == rows(edges)


def test_other_columns_pass_unchanged(clashing):
    for out in (token_counts.count_tokens(clashing, PIECES), quality.judge(clashing, None)):
        assert {r["_counted"] for r in out.collect()} == {"clash"} and {r["_judged"] for r in out.collect()} == {"clash"}
