from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starcart.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.001"


def counted(rows, every):
    words = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return words


def deletions(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def brute_force(rows, every, shortest=5, least=3, ratio=2):
    words = {w: n for w, n in counted(rows, every).items() if len(w) >= shortest and n >= least}
    alphabet = {c for w in words for c in w}
    out = {}
    for w, n in words.items():
        around = deletions(w) | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        around |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        near = sorted((-words[x], x) for x in around if x in words and x != w)
        best = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = (best, n, len(near), words[best] if best else None)
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def random_rows(seed, docs=60):
    rng = random.Random(seed)
    stems = ["color", "colour", "colours", "banana", "bananas", "bannana", "straße", "naïveté", "aaaaa", "aaaaaa", "aaaaaaa", "zebra", "zebras",
             "abcdefghij", "abcdefghi", "listen", "silent", "éclair", "eclair"]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 80)):
            w = rng.choices(stems, weights=range(1, len(stems) + 1))[0]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeßy") + w[k:], w[:k] + rng.choice("aeßy") + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((i, rng.choice([" ", ", ", "\n", "3"]).join(words)))
    return rows


@pytest.mark.parametrize("tile", [1024, 3])
def test_random_words(spark, tile):
    rows = random_rows(1) + [(None, "colour " * 9), (None, None), (3, ""), (3, "colour")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(spelling.variant_groups(docs, every=7, tile=tile))
    assert got == brute_force(rows, 7)
    assert any(r[1] and r[1] != r[2] for r in got)  # a chain of forms


def test_long_words_ties_and_clashing_columns(spark):
    long = "ab" * 3000
    text = " ".join([*["tiedx"] * 3, *["tiedy"] * 6, *["tieda"] * 6, *[long] * 8, *[long + "c"] * 3, *["q" * 70] * 4])
    rows = [(1, text), (1, text), (2, " \t\n"), (3, "é" * 5 + " " + "é" * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("word", "n", "block", "form", "root"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = result(spelling.variant_groups(docs))
    assert got == brute_force(rows, None)
    assert ("tiedx", "tieda", "tieda", 6, 2, 12) in got
    assert spelling.variant_groups(docs.limit(0)).collect() == []


def test_long_chains(spark):
    """Forms of forms: every step changes one letter and doubles the count."""
    words = ["a" * i + "b" * (12 - i) for i in range(13)]
    rows = [(1, " ".join(w for i, w in enumerate(words) for _ in range(3 * 2**i)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(spelling.variant_groups(docs))
    assert got == brute_force(rows, None)
    assert {r[2] for r in got} == {"a" * 12}


def test_joined_checksums():
    rng = random.Random(4)
    prefixes = [f"{rng.randrange(10**9)}:".encode() for _ in range(50)]
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 32))).encode() for _ in range(50)]
    owners = np.array([rng.randrange(50) for _ in words])
    got = spelling.joined_checksums(
        np.array([zlib.crc32(p) for p in prefixes], np.uint32), owners, np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words])
    )
    assert got.tolist() == [zlib.crc32(prefixes[o] + w) for o, w in zip(owners, words, strict=True)]


def test_letter_counts_bound_the_edits():
    rng = random.Random(6)
    for _ in range(2000):
        a = "".join(rng.choices("abcéÿ×", k=rng.randint(2, 8)))
        k, c = rng.randrange(len(a)), rng.choice("abcéÿ×")
        b = rng.choice([a[:k] + a[k + 1 :], a[:k] + c + a[k:], a[:k] + c + a[k + 1 :]])
        x, y = spelling.letter_counts([a, b])
        assert ((x - y) ** 2).sum() <= 2
        assert spelling.one_edit(a, b) == (a != b)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op12_spelling(spark, SF)) == brute_force(docs, 97)
