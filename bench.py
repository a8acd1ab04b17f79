"""Headline timings: one JSON line.  BENCH_SF_DIR, BENCH_CPUS, BENCH_REPS set the run."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ironquill.session import build_session  # noqa: E402
from ironquill.workload.queries import QUERIES  # noqa: E402

HEADLINE = ("analyze_report", "scan_report", "dependency_report", "secret_match", "security_trend", "rate_limit_batch",
            "quota_check", "subscription_state", "cve_report", "usage_daily")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "6g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    timings = {}
    for name in names:
        runs = []
        for _ in range(reps + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs[1:]), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "median seconds, summed over headline queries", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
