"""Times headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: local cores.
"""

import json
import os
import re
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

# One query per kind of work: ingest, wide aggregates, earned value, draws,
# ordered series, joins, nested data, stores, streams and composite reports.
HEADLINE = (
    "items_from_issues", "first_transitions", "status_counts", "size_distribution", "refclass_summary",
    "eva_metrics", "earned_schedule", "completion_quantiles", "burndown", "recent_items", "history_trend",
    "task_reconcile", "dependency_edges_new", "instance_route", "missing_times", "field_profile", "issues_scan",
    "stream_project_status", "dashboard", "portfolio_run", "project_compare", "report_full",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up is paid once per application: executors, classes, Python workers.
    for name in ("status_counts", "completion_quantiles_compat"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
