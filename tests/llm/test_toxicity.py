from __future__ import annotations

import random

import numpy as np
import pytest

from starcart.llm import toxicity
from starcart.llm.common import BoundedCache

WORDS = [f"{a}{b}{c}" for a in "bdfklm" for b in "aeiou" for c in ("nt", "rs", "lo", "ti", "x")]
BAD = ["vrek", "vrekum", "vrekis", "smurg", "smurgan"]


def corpus(n, seed):
    """(doc_id, text, toxic): one in eight texts holds bad words."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 200))
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(1600, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 3 and i % 5 < 3], "doc_id long, toxic int")
    return toxicity.train(docs, labels)


def test_finds_unseen_toxic_texts_and_spares_others(spark, trained):
    rows = corpus(800, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, trained).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    toxic = [scores[i] for i, _, x in rows if x]
    clean = [scores[i] for i, _, x in rows if not x]
    assert np.mean(np.array(toxic) >= 0.7) > 0.9 and np.mean(np.array(clean) >= 0.7) < 0.01


def test_edges(edges, edge_rows, trained):
    got = toxicity.score(edges, trained).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert {"lang", "source"} <= set(got[0].asDict())


def test_no_positive_and_no_rows(spark, table):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(table([(1, "a")]), none) is None
    clean = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.train(table([(1, "a")]), clean) is None
    assert toxicity.score(table([(1, "a")]), None).first()["score"] == 0.0
    assert toxicity.score(table([]), toxicity.Model(np.zeros(1 << toxicity.BITS), 0.0)).collect() == []


def test_score_is_bias_plus_weights():
    model = toxicity.Model(np.zeros(1 << toxicity.BITS), -1.0)
    model.weights[toxicity.word_ids(b"abcd")[0]] = 2.0
    model.weights[toxicity.word_ids(b"abcd")[1]] = 0.5  # its first three bytes
    got = model.score(["ABCD, abcd abcx", "zz", ""], BoundedCache(2))
    assert np.allclose(got, 1 / (1 + np.exp(-np.array([1.5, -1.0, -1.0]))))


def test_non_negative_risk_does_not_collapse():
    """With a prior far too high the corrected negative risk stays at zero instead of going below."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 300, 40)) for _ in range(400)]
    positive = [np.append(r, 999) for r in rows[:100]]
    model = toxicity.fit_nnpu(positive, rows + positive[:50], prior=0.8, steps=200)
    assert np.isfinite(model.weights).all() and abs(model.bias) < 50


@pytest.mark.parametrize("count", [5, 20, 100])
def test_few_positives_still_rank(count):
    """Held-out toxic texts score above clean ones, on average, with few confirmed ones."""
    rows, fresh = corpus(2400, 5), corpus(800, 6)
    positive = [toxicity.text_ids(t) for _, t, x in rows if x][:count]
    model = toxicity.fit_nnpu(positive, [toxicity.text_ids(t) for _, t, _ in rows], prior=1 / 8)
    scores = model.score([t for _, t, _ in fresh], BoundedCache(10_000))
    toxic, clean = (scores[[x == k for _, _, x in fresh]] for k in (1, 0))
    assert len(set(scores.tolist())) > 1
    assert np.mean([(s > clean).mean() + 0.5 * (s == clean).mean() for s in toxic]) > 0.7


def test_small_tables_are_not_scored_alike(spark):
    """On the smallest tables the few confirmed texts score above the labelled clean ones, on average."""
    from starcart.llm import queries

    sf = "/root/testdata/sf0.001"
    scores = {r["doc_id"]: r["score"] for r in queries.op3_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()
    toxic, clean = ([scores[r["doc_id"]] for r in labels if r["toxic"] == k and r["doc_id"] in scores] for k in (1, 0))
    assert len(set(scores.values())) > 2
    clean = np.array(clean)
    assert np.mean([(s > clean).mean() + 0.5 * (s == clean).mean() for s in toxic]) > 0.6


def test_a_repeated_id_brings_its_texts_once(table):
    docs = table([(1, "a b")] * 50 + [(1, f"text {i}") for i in range(9)] + [(2, "c")])
    ids = docs.select("doc_id").distinct()
    assert len(toxicity.sample_features(docs, ids, 100)) == 11
    assert len(toxicity.sample_features(docs, ids, 4)) == 4
