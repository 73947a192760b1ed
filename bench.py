"""Times the headline queries and prints one JSON line.

Each query runs once to warm the JVM on the small tables, then once on the bench
tables into the `noop` sink, which computes every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from waylark.plans import catalog  # noqa: E402
from waylark.session import build_session  # noqa: E402

HEADLINE = [
    "itineraries_to_match",
    "assemble_journeys",
    "flatten_segments",
    "dedupe_segments",
    "upsert_fact",
    "match_calendar",
    "search_plan",
    "cache_report",
    "weather_hour_noon_fallback",
    "weather_cascade",
    "delay_rate_by_carrier",
    "exact_medians",
    "training_features",
    "serving_features",
    "auc_exact",
    "psi_numeric",
    "ks_statistic",
    "error_ratio_sliding",
    "latency_p95_histogram",
    "threshold_hold",
    "alert_grouping",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-", dir="/tmp"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for name in wanted:
            run(spark, name, warm)
    times = {name: round(run(spark, name, sf_dir), 3) for name in wanted}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
