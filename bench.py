"""Headline timings: one JSON line with the median wall seconds per query.

Each query runs into a sink that discards rows, once to warm up and then
``BENCH_RUNS`` times.  ``stored_tables`` is the one exception: it writes the tables that
forensic reports read, once.  ``event_inspection`` reads them; all others start from the
source files.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tallyguard.plans.queries import QUERIES
from tallyguard.plans.tables import Tables

HEADLINE = [
    "normalize_all",
    "content_dedup",
    "events",
    "corpus",
    "known_shapes",
    "structural_alerts",
    "field_stats",
    "silent_null_first_fire",
    "replay_matrix",
    "weekly_cost",
    "field_vitals",
    "order_weekly",
    "stored_tables",
    "event_inspection",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyguard-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def stored_tables() -> None:
        """Everything forensic reports read: events, corpus, alerts, provider facts."""
        load = Tables.stored_load(spark, sf_dir)
        _ = load.stored_events, load.stored_corpus, load.stored_alerts, load.stored_facts

    def once(name: str) -> float:
        start = time.perf_counter()
        if name == "stored_tables":
            stored_tables()
        else:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        if name == "stored_tables":  # built once per session
            seconds[name] = round(once(name), 3)
            continue
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
