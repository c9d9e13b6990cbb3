"""Hot keys against brute force on a small fixture.

One giant basket (120 distinct products, some on two dates), a hot source
product bought with everything, and ordinary small baskets. Pairs, scores and
the top-4 are recomputed in plain Python from the definitions and compared
with the Spark operators run with tiny blocks / many salts, so the split paths
(block pairs, salted ranking) are exercised.
"""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from micro import micro_star
from starcart.operators import basket, recommend

N_PRODUCTS = 150


def fixture_lines():
    rnd = random.Random(11)
    lines = []
    day = dt.date(2025, 1, 1)
    # Giant order G: 120 distinct products, every 7th one on a second date too.
    for p in range(1, 121):
        lines.append(((day + dt.timedelta(days=p % 5)).isoformat(), 1, p, 1, "G", 1, 10, 0, 10, 6, 4))
        if p % 7 == 0:
            lines.append(((day + dt.timedelta(days=30)).isoformat(), 1, p, 1, "G", 1, 10, 0, 10, 7, 3))
    # Hot source 150 appears with every other product in small orders.
    for p in range(1, 150):
        o = f"H{p}"
        d = (day + dt.timedelta(days=rnd.randint(0, 200))).isoformat()
        lines.append((d, 2, 150, 2, o, 1, 20, 0, 20, 12, 8))
        lines.append((d, 2, p, 2, o, 1, 30, 0, 30, rnd.randint(10, 29), 0))
    # Ordinary small baskets.
    for k in range(60):
        o = f"S{k}"
        d = (day + dt.timedelta(days=rnd.randint(0, 200))).isoformat()
        for p in rnd.sample(range(121, 150), 3):
            lines.append((d, 3, p, 3, o, 1, 15, 0, 15, 9, 6))
    # Profit column must equal net - cost.
    return [(*r[:10], r[8] - r[9]) for r in lines]


PRODUCTS = [(k, ["Phones", "Tablets", "Chargers", None][k % 4], k % 20 != 0) for k in range(1, N_PRODUCTS + 1)]


@pytest.fixture(scope="module")
def star(spark):
    return micro_star(spark, lines=fixture_lines(), products=PRODUCTS)


def brute_pairs(lines):
    triples = {(r[4], r[2], dt.date.fromisoformat(r[0])) for r in lines}
    by_order = defaultdict(list)
    for o, p, d in triples:
        by_order[o].append((p, d))
    out = defaultdict(lambda: [0, None])
    for items in by_order.values():
        for (a, da), (b, db) in itertools.product(items, items):
            if a < b:
                e = out[(a, b)]
                e[0] += 1
                e[1] = max(da, db) if e[1] is None else max(e[1], da, db)
    return {k: (v[0], v[1]) for k, v in out.items()}


@pytest.mark.parametrize("block_size", [7, 50, 2048])
def test_pairs_match_brute_force(star, block_size):
    got = {(r.source_product_key, r.candidate_product_key): (r.co_purchase_count, r.last_together_date)
           for r in basket.product_pairs(star, block_size).collect()}
    assert got == brute_pairs(fixture_lines())


def brute_top4(lines, products, categories):
    pairs = brute_pairs(lines)
    sub = {k: s for k, s, _ in products}
    active = {k for k, _, a in products if a}
    parent = {n: p for _, n, p in categories}
    orders = defaultdict(set)
    margins = defaultdict(list)
    for r in lines:
        orders[r[2]].add(r[4])
        net, profit = r[8], r[10]
        margins[r[2]].append(0 if net == 0 else math.floor(profit / net * 1e8 + 0.5))
    pop = {p: len(o) for p, o in orders.items()}
    marg = {p: sum(v) / len(v) / 1e8 for p, v in margins.items()}
    directed = [(a, b, c, d) for (a, b), (c, d) in pairs.items()] + [(b, a, c, d) for (a, b), (c, d) in pairs.items()]
    scored = [(s, c, n, last) for s, c, n, last in directed if c in active and s in sub]
    max_pop = max(pop[c] for _, c, _, _ in scored)
    max_m = max(marg[c] for _, c, _, _ in scored)
    by_src = defaultdict(list)
    for row in scored:
        by_src[row[0]].append(row)
    out = {}
    for s, rows in by_src.items():
        mc = max(r[2] for r in rows)
        ml = max(r[3] for r in rows)
        ranked = []
        for _, c, n, last in rows:
            ss, cs = sub[s], sub[c]
            if (ss or "") == (cs or "") and ss is not None:
                cat = 1.0
            elif parent.get(ss) is not None and parent.get(ss) == parent.get(cs):
                cat = 0.5
            else:
                cat = 0.0
            score = (0.40 * (n / mc) + 0.25 * math.exp(-(ml - last).days / 90.0) + 0.10 * cat
                     + 0.10 * (pop[c] / max_pop) + 0.10 * (marg[c] / max_m) + 0.05 * 1.0)
            ranked.append((-score, c))
        ranked.sort()
        out[s] = [c for _, c in ranked[:4]]
    return out


@pytest.mark.parametrize("min_hot_rows", [1, 10, 100_000])
def test_top4_matches_brute_force(star, min_hot_rows):
    from micro import CATEGORIES

    expected = brute_top4(fixture_lines(), PRODUCTS, CATEGORIES)
    # A large budget makes the unit min_hot_rows: with 1 or 10 the hot source 150
    # (149 candidates) and the giant-basket products are split over many salts.
    rows = recommend.recommendation_top4(star, block_size=7, salt_budget=100_000,
                                         min_hot_rows=min_hot_rows).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.source_product_key, r.recommendation_rank)):
        got[r.source_product_key].append(r.candidate_product_key)
    assert dict(got) == expected
    # The hot source owns 4 recommendations like everyone else.
    assert len(got[150]) == 4


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_big_order_join_paths(spark, star, limit, monkeypatch):
    """Big orders found: broadcast (limit large) or shuffle join (limit 0)."""
    from starcart.sources.schema import Star

    monkeypatch.setattr(basket, "BIG_ORDER_BROADCAST_LIMIT", limit)
    plain = Star(star.date, star.customer, star.category, star.product, star.payment,
                 star.shipping, star.fact)
    got = {(r.source_product_key, r.candidate_product_key): (r.co_purchase_count, r.last_together_date)
           for r in recommend.copurchase_pairs(plain, block_size=7).collect()}
    assert got == brute_pairs(fixture_lines())


def test_no_big_orders_skips_the_join(spark, star):
    items = basket.order_products(star)
    tagged = basket.tag_blocks(items, block_size=10_000, sizes_from=items)
    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(tagged) == joins(items)  # tagging added no join
    assert {r._blk for r in tagged.select("_blk").distinct().collect()} == {0}


def test_hot_source_is_split_and_others_are_not(star):
    s = recommend.scored_pairs(star, block_size=7, salt_budget=100_000, min_hot_rows=50)
    salts = {r.source_product_key: r.n for r in
             s.groupBy("source_product_key").agg(F.countDistinct("_salt").alias("n")).collect()}
    assert salts[150] == 3  # 149 candidates over units of 50 rows
    assert {v for k, v in salts.items() if 120 < k < 150} == {1}  # small sources keep one salt
    # With the default budget nothing in this small fixture is hot.
    d = recommend.scored_pairs(star, block_size=7)
    assert d.agg(F.max("_salt")).first()[0] == 0
