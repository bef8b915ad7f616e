"""Headline queries, timed on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from datumgate.plans.queries import all_queries  # noqa: E402
from datumgate.session import build_session  # noqa: E402

HEADLINE = (
    "scan_row_counts",
    "profile_lineitem",
    "profile_documents",
    "profile_from_footers",
    "profile_partial_merge",
    "profile_exact_distinct",
    "quality_all_rules",
    "csv_split_cells",
    "csv_infer_lineitem",
    "csv_load_orders",
    "csv_scan_files",
    "file_fingerprints",
    "directory_fingerprint",
    "content_fingerprint_lineitem",
    "content_fingerprint_documents",
    "registry_current",
    "registry_versions",
    "ingest_summary",
    "ipc_round_trip",
    "ipc_file_scan",
)
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "datumgate-bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            # Every row and column of the result is computed and dropped.
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "sum of best run per headline query",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
