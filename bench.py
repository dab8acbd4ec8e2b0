"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder of the parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS     cores of the local session (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from driver_queries import REGISTRY
from folioscan.session import local_session

HEADLINE = (
    "tokenize",
    "bm25_terms",
    "bm25_topk",
    "dense_topk",
    "dense_filtered",
    "rrf_hybrid",
    "rerank_topn",
    "retrieval_stats",
    "html_pages",
    "sections",
    "chunks",
    "document_metadata",
    "topic_detect",
    "step_signals",
    "intent_plan",
    "coverage_select",
    "anchor_reservation",
    "ownership_aggregation",
    "comparison_status",
    "topic_shift_windows",
    "alias_resolve",
    "page_count_answers",
    "verification",
    "eval_join",
    "metric_summary",
    "retention_plan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "folioscan-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
