"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR  parquet folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
    BENCH_QUERIES comma-separated subset of query names (optional)
    BENCH_SHUFFLE_PARTITIONS  spark.sql.shuffle.partitions (default: one per core; AQE coalesces)

Every query is executed in full with the ``noop`` sink (no collect to the
driver), four times: ``cold`` is the first run in the process (includes code
generation and JIT warm-up of that plan shape), ``queries`` the median of the
other three (steady state). ``value`` is the steady-state sum plus the one-off
builds of everything the queries share (star tables, co-purchase pairs and
source statistics, customer and product rank tables); ``cold_total`` is the sum
of first runs plus those builds.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = [
    "monthly_kpis",
    "monthly_revenue_growth",
    "overview_kpis",
    "top_products_by_revenue",
    "category_revenue_share",
    "customer_lifetime_value",
    "repeat_purchase_rate",
    "customer_segments",
    "product_pairs",
    "recommendation_scores",
    "recommendation_top4",
    "dq_orphans",
    "dq_arithmetic",
    "dq_constraints",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from starcart.registry import queries
    from starcart.session import local_session

    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    spark = local_session(cores=cpus, shuffle_partitions=partitions, app="starcart-bench")
    qs = queries()

    # Warm the JVM and the parquet footer cache once so the first query is not
    # charged for start-up.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").write.format("noop").mode(
        "overwrite").save()

    times: dict[str, float] = {}
    # One-off builds of written tables, charged to the total so the queries are
    # not credited for work done elsewhere.
    from starcart.operators.customer import customer_lifetime_value
    from starcart.operators.product import top_products_by_revenue
    from starcart.operators.recommend import pair_mart, source_stats
    from starcart.plans.warehouse import warehouse_star

    star = warehouse_star(spark, sf_dir)
    builds = {
        "warehouse_build": lambda: (star.fact, star.date, star.payment),
        "pair_mart_build": lambda: (pair_mart(star), source_stats(star)),
        "rank_tables_build": lambda: (customer_lifetime_value(star), top_products_by_revenue(star)),
    }
    for name, make in builds.items():
        t0 = time.perf_counter()
        make()
        times[name] = round(time.perf_counter() - t0, 3)
    cold: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            runs = []
            for _ in range(4):
                t0 = time.perf_counter()
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(round(time.perf_counter() - t0, 3))
            cold[name], times[name] = runs[0], statistics.median(runs[1:])
        except Exception as exc:  # keep the one-line report even if a query fails
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"

    m = re.search(r"sf([0-9.]+)", sf_dir)
    build = sum(times[name] for name in builds)
    print(json.dumps({
        "metric": "headline_queries_total_wall",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold": cold,
        "cold_total": round(build + sum(cold.values()), 3),
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
