"""Quality rules: counts over words and lines, and a learned verdict (operator 5).

The counts are exact and computed over whole texts. The verdict comes from a logistic
regression over hashed word 1- and 2-grams and character 3-grams (shares of a text's
grams, in 18 bits each), trained on labelled rows, calibrated by Platt scaling on labelled
rows kept from training, and compared with a fixed threshold. Everything is done in one
pass over Arrow batches.

Training takes a bounded sample: the ``rows`` labelled texts with the smallest hash of
their doc_id; every fifth of them (by another hash) is kept for the calibration. Their
gram counts are made on the executors; the driver receives sparse counts only.

Edge cases: null texts have no words, texts without words fail the base rules and have the
probability of a text without grams, repeated rows are judged alike, null labels are
ignored, without both kinds of labels the learned verdict keeps everything.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, fresh, texts

BITS = 18
_MASK = (1 << BITS) - 1
KINDS = 3  # blocks of the feature space: word 1-grams, word 2-grams, character 3-grams
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50


# --- counts ------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more in the text."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    n = len(numbers)
    if n < 2_000_000:  # three numbers fit one integer
        windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * n + ids[2:]
    _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= again
    return int(inside.sum())


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    spaces = len(data) - len(data.translate(None, _SPACE))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


# --- features ----------------------------------------------------------------------------


class Grams:
    """Hashed grams of texts; keeps the hashes of words already seen."""

    def __init__(self):
        self.words = BoundedCache(400_000)

    def of(self, data: bytes, words: list[bytes]) -> list[np.ndarray]:
        """Feature numbers of the three kinds of grams, one for each gram."""
        self.words.fill(dict.fromkeys(words), lambda new: [zlib.crc32(w) for w in new])
        h = np.array([self.words[w] for w in words], dtype=np.uint32)
        pairs = (h[:-1] * np.uint32(0x9E3779B1)) ^ h[1:]
        pairs = (pairs * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        chars = (b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
        kinds = (h & np.uint32(_MASK), pairs, chars)
        return [k.astype(np.int64) + (i << BITS) for i, k in enumerate(kinds)]


def mean_weight(weights: np.ndarray, grams: list[np.ndarray]) -> float:
    return float(sum(weights[g].mean() for g in grams if len(g)))


@dataclass
class Model:
    """P(good) = sigmoid(slope * (bias + sum over kinds of the mean weight of their grams) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, grams: list[np.ndarray]) -> float:
        z = self.slope * (self.bias + mean_weight(self.weights, grams)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.5, l2: float = 1e-6) -> Model:
    """Logistic regression on (label, feature numbers, shares), classes weighted evenly, by Adam."""
    y = np.array([r[0] for r in rows], dtype=np.float64)
    used, cols = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    shares = np.concatenate([r[2] for r in rows]).astype(np.float64)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    theta = np.zeros(len(used) + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(at, theta[cols] * shares, minlength=len(rows))
        residual = (_sigmoid(z) - y) * weight
        g = np.append(np.bincount(cols, residual[at] * shares, minlength=len(used)), residual.sum())
        g[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(KINDS << BITS, dtype=np.float32)
    weights[used] = theta[:-1]
    return Model(weights, float(theta[-1]))


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 500) -> Model:
    """Platt scaling on rows kept from training, with smoothed targets."""
    y = np.array([r[0] for r in rows], dtype=np.float64)
    good, bad = y.sum(), len(y) - y.sum()
    if not good or not bad:
        return model
    z = np.array([model.bias + float(model.weights[f] @ s) for _, f, s in rows])
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    center, scale = z.mean(), z.std() or 1.0
    x = (z - center) / scale
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(a * x + b)
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[np.sum(w * x * x), np.sum(w * x)], [np.sum(w * x), np.sum(w)]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, [np.sum((p - target) * x), np.sum(p - target)])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.weights, model.bias, a / scale, b - a * center / scale)


def labelled_grams(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(label, fold, features, shares) of the sampled labelled texts."""
    chosen = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit("q")), "doc_id").limit(rows)
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int"))
    )
    schema = "label int, fold int, features binary, shares binary"

    def count(batches):
        grams = Grams()
        for batch in batches:
            found = []
            for label, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                data = text.encode()
                features, shares = [np.array([], np.int64)], [np.array([])]
                for kind in grams.of(data, data.split()):
                    if len(kind):
                        f, n = np.unique(kind, return_counts=True)
                        features.append(f)
                        shares.append(n / len(kind))
                found.append((label, fold, np.concatenate(features).astype("<i4").tobytes(), np.concatenate(shares).astype("<f4").tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["label", "fold", "features", "shares"])

    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "fold", "text")
    return picked.mapInArrow(count, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> Model | None:
    """Fit and calibrate on at most ``rows`` labelled texts; None without both labels."""
    data = [
        (r["fold"], (r["label"], np.frombuffer(r["features"], "<i4").astype(np.int64), np.frombuffer(r["shares"], "<f4")))
        for r in labelled_grams(docs, labels, rows).toLocalIterator()
    ]
    learn, kept = [x for fold, x in data if fold], [x for fold, x in data if not fold]
    if len({x[0] for x in learn}) < 2:
        return None
    return calibrate(fit(learn), kept)


# --- verdicts ----------------------------------------------------------------------------

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, model: Model | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with the counts, base_failed, p_good and kept for every row; ``text`` names the column (or field) judged."""
    parts = (model.weights, model.bias, model.slope, model.shift) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    workers: list[Grams] = []  # one for each task

    @F.arrow_udf(", ".join(f"{c} long" for c in _COUNTS) + ", p_good double")
    def judged(column: pa.Array) -> pa.Array:
        if not workers:
            workers.append(Grams())
        grams, model = workers[0], Model(*shared.value) if shared.value else None
        rows = []
        for text in texts(column):
            data = text.encode()
            words = data.split()
            p = model.probability(grams.of(data, words)) if model else 1.0
            rows.append((*base_counts(text, data, words), p))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 5 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*_COUNTS, "p_good"])

    added = [*_COUNTS, "p_good", "base_failed", "kept"]
    plain = [c for c in docs.columns if c.lower() not in added]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    (verdict,) = fresh(docs, "_judged")
    return (
        docs.withColumn(verdict, judged(F.col(text)))
        .select(*plain, *[F.col(f"{verdict}.{c}").alias(c) for c in [*_COUNTS, "p_good"]])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )

