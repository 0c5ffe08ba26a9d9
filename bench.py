"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3),
BENCH_QUERIES (names; default the headlines).
Each query runs once to warm up; the median of the following runs counts.
Every row of every result is produced and dropped.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from registry.queries import QUERIES  # noqa: E402

HEADLINES = (
    "dup_groups", "dup_groups_all", "dup_candidates", "dup_members", "dup_members_all",
    "same_size_groups", "funnel_report", "funnel_survivors", "index_stats", "hash_backlog",
    "export_rows", "inventory_scan", "fingerprints", "upsert_index", "upsert_counted",
    "hash_writeback", "run_log_latest", "tags_upsert", "check_results", "feed_apply", "stream_apply",
    "walk_scan", "scan_and_hash", "funnel_hash",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus)
    took = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINES)).split():
        timed(spark, name, sf_dir)
        took[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
