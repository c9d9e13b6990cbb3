from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from starcart.llm import decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_force(rows, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[i : i + m]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in wins}:
            for i in range(len(w) - m + 1):
                who = wins.get(tuple(w[i : i + m]))
                if who:
                    hit.update(range(i, i + m))
                    found |= who
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return Counter(out)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["ü", "日本", "A1"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)]
    items += [(3, items[5][1]), (None, items[0][1]), (40, None), (41, " .,"), (42, items[6][1]), (10, "THE the The"), (5, "x " * 15)]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 60))
        if i % 2:
            w = rng.choice(items)[1] or ""
            t = t + " " + (w.upper().replace(" ", "-- ") if i % 3 else w) + " " + text(rng.randint(0, 5))
        docs.append((i, t))
    return docs + [(7, docs[7][1]), (None, docs[9][1]), (8, "x " * 40)], items


@pytest.mark.parametrize("seed,broadcast", [(1, 200_000), (2, 0)])
def test_against_brute_force(spark, table, edge_rows, seed, broadcast):
    docs, items = planted(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated_words(table(docs + edge_rows), bench, broadcast_rows=broadcast)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == brute_force(docs + edge_rows, items)


def test_empty_tables_and_clashing_columns(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contaminated_words(table([(1, "a b")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(2, 0, False)]
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contaminated_words(table([]), bench).collect() == []
    odd = spark.createDataFrame([(1, "x a b c", 5, 6, "w")], "doc_id long, text string, n_hit int, key int, w string")
    row = decontaminate.contaminated_words(odd, bench).first()
    assert (row["n_hit"], row["key"], row["w"]) == (3, 6, "w")


def test_native_plan(spark, table):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate.contaminated_words(table([(1, "x a b c")]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
