"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the local
cores. Each query runs once to warm up and ``BENCH_RUNS`` times for the median;
every run computes all rows and columns (noop sink).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from signalbed.plans import QUERIES
from signalbed.session import build_session

HEADLINE = {
    "filter_and_newest_page": "g01_newest_page",
    "structured_filter": "b01_structured_filter",
    "text_search": "b02_text_search_long",
    "parse_five_formats": "a05_raw_ingest",
    "metric_statistics": "e01_metric_statistics",
    "metric_buckets": "e04_bucket_averages",
    "anomaly_report": "e21_anomaly_report",
    "trace_summaries": "e12_trace_summaries",
    "waterfall": "f08_waterfall",
    "error_chains": "f11_error_chains",
    "pattern_traps": "b14_c03_pattern_traps",
    "frequency_trap": "f01_window_counts",
    "throttled_alerts": "f04_throttled_alerts",
    "retention": "b19_expired_logs",
    "storage_usage": "e08_storage_usage",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("signalbed-bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for label, name in HEADLINE.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[label] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
