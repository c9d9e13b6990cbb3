from __future__ import annotations

import math
import random

from starcart.llm import licenses

WORDS = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu") for b in ("n", "r", "st", "le", "ndo")] + ["the", "of", "in", "to", "is", "this", "work"]
LINES = {
    "All rights reserved.": "reserved", "Released under the MIT License.": "mit", "LICENSED under the Apache License, Version 2.0.": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "creative-commons",
}


def corpus(n):
    rng = random.Random(1)
    rows, expected = [], set()
    for i in range(n):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(3, 40))) for _ in range(rng.randint(1, 5))]
        if i % 4 == 0:
            line = rng.choice(list(LINES))
            at = rng.randint(0, len(lines))
            lines.insert(at, line)
            expected.add((i, at, LINES[line]))
        rows.append((i, "\n".join(lines)))
    return rows, expected


def test_planted_licences(table, edge_rows):
    rows, expected = corpus(300)
    got = licenses.scan(table(rows + edge_rows)).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in got if r["confirmed"]} == expected
    assert all(0.5 <= r["probability"] <= 1 and 0 <= r["containment"] <= 1 for r in got)


def test_repeated_rows_and_empty(table):
    got = licenses.scan(table([(1, "x y z\nAll rights reserved."), (1, "x y z\nAll rights reserved."), (None, "All rights reserved.")])).collect()
    assert sorted((r["doc_id"] or 0, r["paragraph"], r["family"]) for r in got) == [(0, 0, "reserved"), (1, 1, "reserved"), (1, 1, "reserved")]
    assert licenses.scan(table([])).collect() == []


def test_native_plan(table):
    plan = licenses.scan(table([(1, "All rights reserved.")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_softmax_stays_short_and_right(spark):
    scores = {f"f{i}": 0.3 * i - 1 for i in range(12)}
    rows = spark.createDataFrame([tuple(scores.values())], [f"s_{f}" for f in scores])
    length = lambda n: len(licenses._softmax(list(scores)[:n], 0.7)._jc.toString())
    assert length(12) < 3 * length(6)  # in proportion to the families, not to their square or cube
    got = rows.select(licenses._softmax(list(scores), 0.7).alias("p")).first()["p"]
    powers = {f: math.exp((s - max(scores.values())) / 0.7) for f, s in scores.items()}
    assert all(abs(got[f] - p / sum(powers.values())) < 1e-12 for f, p in powers.items())
