"""Summarise the final (post-AQE) physical plan of each registered query.

    python tools/plan_report.py [sf_dir] [query ...] > PLANS.md

For every query: shuffle exchanges by kind, broadcasts, join strategies,
windows, and every SinglePartition exchange with the operator it feeds, so a
reviewer can check that nothing unbounded funnels into one task. Queries that
materialise a stage first (ranking helper, pair mart) show the plan that runs
on the materialised data.
"""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

PATTERNS = {
    "hash shuffles": r"Exchange hashpartitioning",
    "range shuffles": r"Exchange rangepartitioning",
    "single-partition": r"Exchange SinglePartition",
    "round-robin": r"Exchange RoundRobinPartitioning|RebalancePartitions",
    "reused": r"ReusedExchange",
    "broadcasts": r"BroadcastExchange",
    "BHJ": r"BroadcastHashJoin",
    "SMJ": r"SortMergeJoin",
    "SHJ": r"ShuffledHashJoin",
    "BNLJ": r"BroadcastNestedLoopJoin",
    "windows": r"\bWindow \[",
    "group limits": r"WindowGroupLimit",
    "expand": r"\bExpand \[",
    "sort aggs": r"SortAggregate",
}


def final_plan(df) -> str:
    qe = df._jdf.queryExecution()
    qe.executedPlan().execute().count()
    return final_part(qe.executedPlan().toString())


def final_part(text: str) -> str:
    """The final plans in an AQE plan string, those of subqueries included.

    Every AdaptiveSparkPlan (a subquery has its own) prints its final and then its initial
    plan; each initial part runs to the next line that is not indented deeper than its title.
    """
    kept, skip = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if "== Initial Plan ==" in line:
            skip = line.index("== Initial Plan ==")
            continue
        if skip is not None and depth < skip:
            skip = None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


_WRAPPERS = ("ShuffleQueryStage", "AQEShuffleRead", "Sort", "Project", "Filter", "InputAdapter",
             "WholeStageCodegen", "ReusedExchange")


def _node(line: str) -> tuple[int, str]:
    m = re.search(r"[+:]- (\*\(\d+\) )?(\w+)", line)
    return (m.start(), m.group(2)) if m else (len(line) - len(line.lstrip()), line.strip().split(" ")[0])


def single_partition_consumers(plan: str) -> list[str]:
    """The first real operator above each SinglePartition exchange."""
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        depth, _ = _node(line)
        for j in range(i - 1, -1, -1):
            d, name = _node(lines[j])
            if d < depth:
                depth = d
                if name not in _WRAPPERS:
                    out.append(name)
                    break
    return out


def main(argv: list[str]) -> None:
    from starcart.registry import queries
    from starcart.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    names = argv[2:]
    spark = local_session(shuffle_partitions=16, app="starcart-plans")
    qs = queries()
    print(f"# Final physical plans at {sf_dir} (local[*], AQE on)\n")
    print("| query | sec | " + " | ".join(PATTERNS) + " | single-partition feeds |")
    print("|---|---|" + "---|" * len(PATTERNS) + "---|")
    for name in names or list(qs):
        t0 = time.perf_counter()
        plan = final_plan(qs[name](spark, sf_dir))
        sec = time.perf_counter() - t0
        counts = [str(len(re.findall(p, plan))) for p in PATTERNS.values()]
        feeds = ", ".join(sorted(set(single_partition_consumers(plan)))) or "-"
        print(f"| {name} | {sec:.1f} | " + " | ".join(counts) + f" | {feeds} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
