from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from starcart.llm import quality


def counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


TEXTS = [
    "a b c a b c", "a a a a", "a b c d", "x\ny\nx\n \n\nx", "# * $ % & | < > é　日\x1c\x85z", "\x0b\x0c\t \r\n", "a b c " * 30,
    "same line here\nsame line here\nsame  line here", "aa aa aa bb aa aa aa",
]


def test_counts_by_brute_force(edges, edge_rows, table):
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = quality.judge(table(rows), None).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter(
        (i, *counts(t)) for i, t in rows
    )
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert (r["base_failed"], r["kept"]) == (failed, not failed)


def test_random_texts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", "c", " ", " ", "\n", "#"], k=rng.randint(0, 60)))
        data = text.encode()
        assert quality.base_counts(text, data, data.split()) == counts(text), repr(text)


WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "sta", "tre") for b in ("n", "r", "st", "le", "ndo", "m")]


def labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(60, 200))
        good = i % 4 != 0
        if not good:
            words = [w + "%%%" for w in words] if i % 8 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(good)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = labelled(400, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    return quality.train(docs, labels)


def test_held_out_accuracy_and_calibration(spark, model):
    rows = labelled(400, 2)
    docs = spark.createDataFrame([(*r[:2], True) for r in rows], "doc_id long, text string, kept boolean")
    got = {r["doc_id"]: r for r in quality.judge(docs, model).collect()}
    assert sum(got[i]["kept"] == bool(q) for i, _, q in rows) >= 0.99 * len(rows)
    assert abs(sum(r["p_good"] for r in got.values()) / len(rows) - 0.75) < 0.1


def test_edges_with_a_model(edges, edge_rows, model):
    got = quality.judge(edges, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["p_good"] <= 1 for r in got)


def test_no_rows_and_one_class(spark, table, model):
    assert quality.judge(table([]), model).collect() == []
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.train(table([(1, "a b")]), labels) is None
