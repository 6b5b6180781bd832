"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local
cores. Every query is run to a ``noop`` sink, so all of its rows are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from shelfmark.queries import registered

HEADLINE = [
    "grep_capped", "grep_context", "grep_literal", "grep_files", "grep_summary", "lines", "read_range",
    "outline", "read_section", "tables", "tree_rollup", "tree", "glob", "find", "stat", "duplicate_groups",
    "diff_lines", "diff_unified", "parse_keys", "reconcile_actions", "reconcile_report", "sync_plan",
    "latest_version", "retention", "record_paths", "folder_paths", "event_keys", "select_rung",
    "quality_report", "text_checksum", "ocr_assemble", "ingest_documents", "scratch_state",
    "quota_replay", "alarm_windows", "alarm_changes", "alarm_stream", "quota_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfmark-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registered()
    # One small run first, so that the first query does not pay for starting up.
    known["lines"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        started = time.perf_counter()
        known[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
