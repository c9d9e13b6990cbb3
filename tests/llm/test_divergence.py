from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from starcart.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, least=10, ranks=10):
    docs = [(lang or "", source or "", Counter(t.translate(LOWER) for t in TERM.findall(text or ""))) for lang, source, text in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(terms.keys())
        counts[lang, source].update(terms)
    out = []
    for lang in seen.keys() | {d[0] for d in docs}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang} | {s: counts[lang, s] for g, s, _ in docs if g == lang}
        whole = sum(groups.values(), Counter())

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["the", "The,", "the-the", "naïve", "Ünder", "x1y", "42", "don't", "a b", "日本", *[f"w{chr(97 + i)}" for i in range(20)]]
    langs, sources = ["en", "en", "en", "de", None, ""], ["s1", "s1", "s2", "s3", None, ""]
    return [
        (rng.choice(langs), rng.choice(sources), None if rng.random() < 0.05 else " \n".join(rng.choices(words, k=rng.randint(0, 30))))
        for _ in range(n)
    ]


def test_random_rows(spark):
    rows = random_rows(150, 1)
    assert result(divergence.audit(frame(spark, rows))) == brute_force(rows)


def test_small_blocks(spark, monkeypatch):
    rows = random_rows(120, 2)
    whole = divergence.chunk_blocks
    monkeypatch.setattr(divergence, "chunk_blocks", lambda docs: whole(docs, block_chunks=40, block_docs=3, block_bytes=500))
    assert result(divergence.audit(frame(spark, rows))) == brute_force(rows)


def test_groups_and_languages_without_terms(spark):
    rows = [("en", "a", "one two"), ("en", "b", None), ("en", "c", "12 34"), ("fr", "a", ""), ("fr", "b", "rare"), (None, None, None)]
    rows += [("de", "x", "wort wort anders") for _ in range(10)] + [("de", "y", None)]
    got = result(divergence.audit(frame(spark, rows)))
    assert got == brute_force(rows)
    assert ("fr", "a", "pair", "b", 0, 1) in got


def test_edges_repeats_and_clashing_columns(spark):
    long = " ".join(f"term{chr(97 + i % 26)} x{'y' * (i % 300)}" for i in range(40_000))
    rows = [("en", "s", long)] * 12 + [("en", "t", long + " more" * 11), ("en", "t", "\0 \x1c")]
    docs = frame(spark, rows)
    for name in ("doc_id", "chunk", "term", "n", "docs", "p", "block", "value", "rank"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert result(divergence.audit(docs)) == brute_force(rows)
    assert divergence.audit(frame(spark, [])).collect() == []


def test_terms_of_every_character(spark):
    texts = [f"Ab{chr(c)}Cd" for c in range(0x250)]
    rows = [("en", "s" if i % 2 else "t", t) for i, t in enumerate(texts)]
    assert result(divergence.audit(frame(spark, rows), least=1)) == brute_force(rows, 1)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    rows = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.sql()['op11_divergence']})").fetchall()
    got = result(queries.op11_divergence(spark, f"/root/testdata/{sf}"))
    assert sorted(rows) == got and got
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("lang", "source", "text").collect()
    assert got == brute_force([tuple(r) for r in docs])
