"""Wall seconds of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Every query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.  All result rows
and columns are computed (written to a no-op sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "cardinality_profile_orders",
    "cardinality_profile_lineitem",
    "prefix_selectivity",
    "prefix_recommendation",
    "storage_projection",
    "column_key_info",
    "session_counts",
    "session_delta_count",
    "transaction_view",
    "slow_query_view",
    "lock_wait_view",
    "proxy_connections",
    "query_digest_top",
    "pages_by_index",
    "doc_summary",
    "lock_episodes",
    "counter_rate",
    "progress_eta",
    "batch_numbers",
    "general_log_accepted",
    "engine_status_full",
    "incident_summary",
    "operations_overview",
    "binlog_statements",
    "binlog_transactions",
    "documents_templates",
    "physical_relations",
    "upsert",
    "snapshot_diff",
    "grants_summary",
)


def main() -> None:
    from bindings.all import QUERIES
    from opslens.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} first {times[0]:.2f}s then {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_wall", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
