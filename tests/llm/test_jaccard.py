from __future__ import annotations

import random
from collections import Counter

import pytest

from starcart.llm import jaccard


def shingles(text, size=5):
    low = (text or "").encode().translate(jaccard._LOWER)
    w = low.split()
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def brute_force(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed, groups, copies, edits):
    """Groups of texts around a base, at every distance up to ``edits`` words, and a shared passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(30, 90))]
        if g % 3 == 0:
            base = base[:12] + passage
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 2)] = [word()]
            rows.append((len(rows), " ".join(text) if rng.random() < 0.7 else " ".join(text).upper()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,chunk,part", [(1, 2_000_000, 24 << 20), (2, 300, 3000)])
def test_classes_by_brute_force(table, edge_rows, seed, chunk, part):
    rows = near_copies(seed, groups=12, copies=14, edits=5) + [(i + 1000, t) for i, (d, t) in enumerate(edge_rows) if t is None or len(t) < 1000] + edge_rows[:4]
    got = jaccard.jaccard_classes(table(rows), chunk_tokens=chunk, part_bytes=part)
    assert Counter(tuple(r) for r in got.collect()) == brute_force(rows)


def test_chains_near_the_threshold(table):
    """Texts that slide over one long text link with their neighbours only: the component is a long chain."""
    long = [f"v{i}" for i in range(400)]
    rows = [(500 - i, " ".join(long[4 * i : 4 * i + 60])) for i in range(80)]
    expected = brute_force(rows)
    assert len({c for _, _, c in expected}) < 20
    assert Counter(tuple(r) for r in jaccard.jaccard_classes(table(rows)).collect()) == expected


def test_exact_threshold(table):
    """100 * 8 = 80 * 10 links; one shingle less does not."""
    w = [f"q{i}" for i in range(60)]
    a, b = " ".join(w[:13]), " ".join([*w[:12], "other"])  # 9 shingles, 8 shared: 8 of 10
    c, d = " ".join(w[20:32]), " ".join([*w[20:31], "other"])  # 8 shingles, 7 shared: 7 of 9
    rows = [(1, a), (2, b), (3, c), (4, d)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(table(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = jaccard.components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in linked} and len(got) == len(linked)


def test_pack_round_trip():
    import numpy as np

    for values in ([0], [5], [1, 2, 3], [0, 255, 256, (1 << 56) - 1], sorted(random.Random(1).sample(range(1 << 50), 500))):
        tokens = np.array(values, dtype=np.uint64)
        assert (jaccard._unpack(jaccard._pack(tokens)) == tokens).all()


def test_empty(table):
    assert jaccard.jaccard_classes(table([])).collect() == []
    got = jaccard.jaccard_classes(table([(4, None), (5, ""), (6, " ")])).collect()
    assert sorted(tuple(r) for r in got) == [(4, 0, 4), (5, 0, 5), (6, 0, 6)]
