"""Time the headline queries: one warm-up, then the median of BENCH_RUNS runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = (
    "hybrid_retrieve", "bm25_topk", "bm25_per_tenant", "vector_topk_per_tenant", "rrf_hybrid", "token_budget_prefix", "scd2_slot_history", "reconcile_full", "as_of_snapshot", "invalidation_pairs",
    "category_retract", "profile_list", "profile_upsert_merge", "alias_fuzzy", "gate_routing", "batch_dedupe", "engagement_collapse", "sentence_split", "clause_overlap", "resolve_fold",
)


def main() -> None:
    from recollect import catalog
    from recollect.session import session

    spark = session(f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    took = {}
    for name in chosen:
        run = lambda: catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()
        each = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run()
            each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each), 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
