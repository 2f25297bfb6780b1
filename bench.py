"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from driftgauge.plans import load_all
from driftgauge.session import local_session

HEADLINE = ["row_steps", "batch_stats_events", "drift_surface_events", "drift_surface_lineitem", "ranking_metrics",
            "recall_at_precision", "governed_decisions", "strategy_summary", "pending_summary", "median_fill",
            "similarity_edges", "clustering", "term_weights", "stream_window_stats"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "driftgauge-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
