"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from permaway.plans import QUERIES
from permaway.session import build_session

HEADLINE = [
    "assets_in_violation", "validate_events", "fanout_dead_letter", "point_projection", "latest_state", "failure_runs",
    "sustained_alerts", "gap_fill", "sliding_windows", "window_features", "rolling_stats", "psi_by_type", "interval_quantile",
    "latency_buckets", "trace_latency", "range_to_segment", "slot_conflicts", "retention_due", "undecided", "dual_control",
    "correlated_anomalies", "fed_average", "message_round", "stopping_distance", "adaptive_anomalies", "suppress_alerts", "spectrum",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spent = {}
    for name in sys.argv[1:] or HEADLINE:
        # The first run loads classes and compiles; the second is the time that counts.
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
