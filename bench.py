"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query runs once to
warm up and then ``BENCH_RUNS`` times (once by default); the median counts. Results are computed
in full and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quire.plans.catalog import QUERIES

HEADLINE = (
    "file_decisions", "skip_summary", "language_of_file", "secret_findings", "ignore_decisions",
    "tracked_union", "selected_files", "snapshot_delta", "exact_renames", "line_hunks",
    "merged_ranges", "sliced_blocks", "project_tree", "file_blocks", "numbered_blocks",
    "repo_metrics", "artifact_by_repo", "unpack_roundtrip", "delta_export", "own_ignore_files",
    "change_log_export", "token_budget", "change_context",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quire-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", os.environ.get("QUIRE_CHECKPOINT_DIR", "/tmp/checkpoints/quire"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds[1:]), 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files, size = documents.selectExpr("count(*)", "sum(octet_length(text))").head()
    spark.stop()
    flagship = timings.get("repo_metrics")
    report = {
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "files": files,
        "bytes": size,
    }
    if flagship:
        report["flagship_files_per_sec"] = round(files / flagship, 1)
        report["flagship_mb_per_sec"] = round(size / flagship / 1e6, 2)
    print(json.dumps(report))


if __name__ == "__main__":
    main()
