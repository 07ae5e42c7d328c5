"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from pyspark.sql import SparkSession

from checks.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINE = (
    "session_snapshot",
    "base_dataset",
    "base_kpis",
    "attempt_facts",
    "attempt_features",
    "user_day_metrics",
    "cumulative_metrics",
    "m3_dataset",
    "m3_kpis",
    "streak_kpis",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        # Capturing the call site of every column expression costs more than small queries do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # The generated code of all queries together exceeds the default cache of 100 entries.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    runs = {name: [] for name in names}
    # The first round warms up code generation and is not counted.
    for _ in range(REPEATS + 1):
        for name in names:
            started = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - started)
    seconds = {name: round(statistics.median(times[1:]), 3) for name, times in runs.items()}
    spark.stop()
    report = {
        "metric": "headline queries, sum of medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
