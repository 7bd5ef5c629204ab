"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver).  Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Set BENCH_REPEATS to time each query more than once (the minimum is kept).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from structura.plans.registry import all_queries  # noqa: E402
from structura.session import local_session  # noqa: E402

HEADLINE = [
    "page_stats", "page_stats_catalog", "tree_lines", "tree_text", "graph_edges_top",
    "sitemap_write", "sitemap_parse", "csv_parse", "csv_parse_docs", "qa_pairs",
    "prompt_context", "questionnaire_profile", "generate_rule_based",
    "rule_hierarchy", "sitemap_validate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="structura-bench")
    qs = all_queries()
    times: dict[str, float] = {}
    for k in keys:
        best = None
        for _ in range(repeats):
            t0 = time.time()
            qs[k].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
            best = dt if best is None else min(best, dt)
        times[k] = round(best, 3)
        print(f"# {k}: {times[k]} s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(cpus), "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
