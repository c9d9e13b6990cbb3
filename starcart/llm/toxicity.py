"""Toxicity by non-negative positive-unlabelled learning (operator 3).

Confirmed toxic texts are the positives; every other text, whatever its label, is only
unlabelled. With the class prior p (the toxic share of the training labels) the risk of a
classifier f is

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])

with the logistic loss l: unlabelled texts count as negatives, corrected by the toxic part
that hides among them, and the correction never drives the negative risk below zero (then
only the excess is walked back). The classifier is linear over the words that occur in a
text and their beginnings (3 to 6 bytes, for inflected forms), hashed to 18 bits, trained
with numpy by proximal Adam with an L1 penalty, so that words without a say weigh nothing
however long the text.

Training reads a bounded sample: ``positives`` confirmed texts and ``unlabelled`` texts,
those with the smallest hash of their doc_id. Sampled texts are hashed on the executors;
the driver receives at most ``positives + unlabelled`` short arrays. Scoring reads every
whole text in Arrow batches with the model as a broadcast variable.

Edge cases: null and empty texts score as texts without words, null doc_ids are scored
but never trained on, repeated rows score alike, without a confirmed positive every score
is 0, columns of the input other than doc_id and text pass through unseen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, texts

BITS = 18
# Bytes that are not part of a word become spaces, A-Z is lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_in(text: str) -> set[bytes]:
    return set(text.encode().translate(_TABLE).split())


def word_ids(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    forms = [word, *(b"^" + word[:k] for k in range(3, 7) if len(word) >= k)]
    return [zlib.crc32(f) & ((1 << BITS) - 1) for f in forms]


def text_ids(text: str) -> np.ndarray:
    return np.unique(np.fromiter((i for w in words_in(text) for i in word_ids(w)), dtype=np.int64))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """score = sigmoid(bias + sum of the weights of the text's features)."""

    weights: np.ndarray
    bias: float

    def score(self, batch: Iterable[str], cache: BoundedCache) -> np.ndarray:
        """Scores of texts; ``cache`` keeps the weighted features of words already seen."""
        weighted = dict(zip(np.flatnonzero(self.weights).tolist(), self.weights[self.weights != 0].tolist(), strict=True))

        def of(words):
            return [tuple(i for i in word_ids(w) if i in weighted) for w in words]

        logits = []
        for text in batch:
            words = words_in(text)
            cache.fill(words, of)
            found = set().union(*map(cache.__getitem__, words))
            logits.append(self.bias + sum(weighted[f] for f in sorted(found)))
        return _sigmoid(np.array(logits, dtype=np.float64))


def one_of_each(rows: list[np.ndarray]) -> list[np.ndarray]:
    """One text of each group of copies (texts that agree in three min-hashes of their features)."""
    seen: dict[tuple, np.ndarray] = {}
    for row in rows:
        mixed = [(row.astype(np.uint64) + np.uint64(1)) * np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
        seen.setdefault(tuple(int((m ^ (m >> np.uint64(31))).min()) if len(m) else -1 for m in mixed), row)
    return list(seen.values())


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float,
    features: int = 2000, excess: float = 5.0, steps: int = 400, rate: float = 0.1, l1: float = 0.03,
) -> Model:
    """Train on lists of word-id arrays.

    Of the hashed words, the ``features`` that most exceed the count expected among the
    positives from their share of the unlabelled texts take part, if by more than two
    standard errors; the threshold rises with the number of positives, to ``excess``, as
    chance lifts more words over it. Few positives thus still have features. The penalty is
    ``l1`` times the prior, the weight that the risk gives the positives, so that it does not
    outweigh them when toxic texts are rare.
    """
    size = 1 << BITS
    positive, unlabelled = one_of_each(positive), one_of_each(unlabelled)
    count = lambda rows: np.bincount(np.concatenate(rows), minlength=size)
    expected = (count(unlabelled) + 0.5) * len(positive) / len(unlabelled)
    lift = (count(positive) - expected) / np.sqrt(expected + 1)
    chosen = np.argsort(-lift, kind="stable")[:features]
    chosen = chosen[lift[chosen] > min(excess, 2 + len(positive) / 30)]
    column = np.full(size, -1, dtype=np.int64)
    column[chosen] = np.arange(len(chosen))

    def matrix(rows):
        cols = [c[c >= 0] for c in (column[r] for r in rows)]
        return np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate(cols), len(rows)

    xp, xu = matrix(positive), matrix(unlabelled)
    theta = np.zeros(len(chosen) + 1)  # the bias last
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def logits(x):
        return theta[-1] + np.bincount(x[0], theta[x[1]], minlength=x[2])

    def gradient(x, residual):  # mean over texts of residual * features
        return np.append(np.bincount(x[1], residual[x[0]], minlength=len(chosen)), residual.sum()) / x[2]

    for step in range(1, steps + 1):
        sp, su = _sigmoid(logits(xp)), _sigmoid(logits(xu))
        as_negative = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-12)))
        negative = gradient(xu, su) - prior * gradient(xp, sp)
        g = prior * gradient(xp, sp - 1) + negative if as_negative >= 0 else -negative
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - rate * l1 * prior, 0)
    weights = np.zeros(size, dtype=np.float64)
    weights[chosen] = theta[:-1]
    return Model(weights, float(theta[-1]))


def sample_features(docs: DataFrame, ids: DataFrame, most: int) -> list[np.ndarray]:
    """Word ids of the texts of the sampled doc_ids (``ids`` is a bounded sample)."""

    def hashed(batches):
        for batch in batches:
            rows = [text_ids(t).astype("<u4").tobytes() for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    # A repeated doc_id brings each of its texts, not each of its rows, and no more texts than asked for.
    hashes = rows.mapInArrow(hashed, "ids binary").distinct().limit(most)
    return [np.frombuffer(r["ids"], "<u4").astype(np.int64) for r in hashes.collect()]


def train(
    docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 10_000, **fit
) -> Model | None:
    """Fit on ``labels`` (doc_id, toxic) and ``docs``; None without a confirmed positive."""
    share = labels.where("toxic is not null and doc_id is not null").agg(F.avg("toxic").alias("p")).first()["p"]
    if not share:
        return None
    known = labels.where("toxic = 1").select("doc_id").distinct()
    confirmed = known.orderBy(F.xxhash64("doc_id", F.lit("p")), "doc_id").limit(positives)
    anything = docs.where("doc_id is not null").select("doc_id").distinct()
    drawn = anything.orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(unlabelled)
    p_rows, u_rows = sample_features(docs, confirmed, positives), sample_features(docs, drawn, unlabelled)
    if not p_rows or not u_rows:
        return None
    return fit_nnpu(p_rows, u_rows, min(max(float(share), 1e-4), 0.9), **fit)


def score(docs: DataFrame, model: Model | None, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a score in 0..1 for every row; ``text`` names the column (or field) scored."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    caches: list[BoundedCache] = []  # one for each task

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        if not caches:
            caches.append(BoundedCache(400_000))
        return pa.array(Model(*shared.value).score(texts(column), caches[0]))

    return docs.withColumn(column, scored(F.col(text)))
