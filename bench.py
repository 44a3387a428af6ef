"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clean_events",
    "redact_documents",
    "clean_output",
    "base_tool",
    "content_classify",
    "extract_nmap",
    "extract_linpeas",
    "truncate_documents",
    "process_events",
    "preprocess_events",
    "event_cap",
    "consecutive_dedup",
    "consecutive_dedup_sliced",
    "merge_small_chunks",
    "merge_small_chunks_sliced",
    "session_signals",
    "session_type",
    "command_list",
    "chunk_prompts",
    "assemble_responses",
    "strict_json_scan",
    "cache_staleness",
    "transcript_events",
    "stream_transcript",
    "stream_preprocess",
    "report_prompts",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from shelltrace.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelltrace-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Load the JVM's SQL classes and start Python workers before timing.
    for name in ("clean_events", "merge_small_chunks"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
