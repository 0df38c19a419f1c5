"""Times the headline queries and prints one JSON line.

All queries are built and written to the no-op sink, three rounds; of each the best
counts.
Rates at the end are for `scan_documents`, the job the published figures of
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from catalogue import frames  # noqa: E402

HEADLINE = (
    "scan_documents",
    "scan_generated",
    "scan_pages",
    "scan_by_policy",
    "multilingual_scan",
    "contains_pii",
    "detected_entities",
    "explain_entities",
    "name_entities",
    "entities_from",
    "detect_language_documents",
    "coverage",
    "type_breakdown",
    "top_risk",
    "view_flagged",
    "scan_units",
    "scanned_per_day",
    "replace_by_id",
    "update_by_id",
    "export_lines",
    "scan_unscanned",
    "run_batch",
    "stream_scan_documents",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    seconds: dict[str, float] = {}
    # Round by round, so that what one query warms up serves the others as well.
    for _ in range(RUNS):
        for name in HEADLINE:
            start = time.perf_counter()
            frames.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            seconds[name] = min(seconds.get(name, spent), spent)

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, size = documents.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    scan = seconds["scan_documents"]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(s, 3) for name, s in seconds.items()},
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "scan_docs_per_sec": round(rows / scan, 1),
                "scan_mb_per_sec": round(size / scan / 1e6, 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
