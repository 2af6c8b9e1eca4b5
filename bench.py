"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from bookwright.plans.queries import all_queries
from bookwright.session import build_session

HEADLINE = (
    "parent_candidates",
    "source_children",
    "existing_jobs",
    "existing_jobs_kgram",
    "parent_results",
    "child_results",
    "run_summary",
    "child_outcomes",
    "latest_attachment",
    "read_reports_tsv",
    "due_on_daily",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # starts the session before the clock
    known = all_queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # Every row and column is produced, nothing comes to the driver.
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
