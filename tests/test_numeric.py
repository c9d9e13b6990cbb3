"""Exact money ratios: div_round against Python's Decimal on random cases."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from starcart.functions.numeric import div_round, money_mean


def exact(num: Decimal, den: Decimal, digits: int, times: int) -> Decimal | None:
    if den == 0:
        return None
    with localcontext() as ctx:
        ctx.prec = 60
        q = num * times / den
    return q.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)


def cases(n: int = 2000):
    rnd = random.Random(5)
    out = []
    for _ in range(n):
        num = Decimal(rnd.randint(-10**12, 10**12)) / 100
        den = Decimal(rnd.choice([0, rnd.randint(1, 10**6), rnd.randint(-10**9, 10**9)])) / 100
        out.append((num, den))
    # Exact half-cent ties must round away from zero.
    out += [(Decimal("2330250.15"), Decimal("10")), (Decimal("-0.05"), Decimal("10")),
            (Decimal("0.01"), Decimal("2")), (Decimal("-0.01"), Decimal("2"))]
    return out


def test_div_round_matches_decimal(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "num decimal(20,2), den decimal(20,2)")
    got = df.select(
        "num", "den",
        div_round(F.col("num"), F.col("den")).alias("r2"),
        div_round(F.col("num"), F.col("den"), times=100).alias("pct"),
        div_round(F.col("num"), F.col("den"), digits=1).alias("r1"),
    ).collect()
    for r in got:
        assert r.r2 == exact(r.num, r.den, 2, 1), r
        assert r.pct == exact(r.num, r.den, 2, 100), r
        assert r.r1 == exact(r.num, r.den, 1, 1), r


def test_money_mean_is_exact(spark):
    vals = [Decimal("0.01"), Decimal("0.02"), Decimal("0.02")]  # mean 0.01666.. -> 0.02
    df = spark.createDataFrame([(v,) for v in vals], "v decimal(10,2)")
    assert df.agg(money_mean("v").alias("m")).first().m == Decimal("0.02")
    halves = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "v decimal(10,2)")
    assert halves.agg(money_mean("v").alias("m")).first().m == Decimal("0.02")  # 0.015 -> 0.02
