"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` (comma list) narrows the set.
"""

from __future__ import annotations

import json
import os
import sys
import time

from docketlake.plans.catalog import QUERIES
from docketlake.session import local_session

HEADLINE = (
    "summary", "group_rollup_share", "search_page", "search_total", "record_hash", "count_parse", "date_parse",
    "clean_text", "batch_dedupe", "upsert", "soft_delete", "alert_match", "alert_unsent", "alert_digest",
    "header_scores", "header_assign", "records_from_pages", "records_from_csv", "records_from_json",
    "data_links", "link_filings", "row_dedupe", "carry_forward", "coverage", "run_rollup", "stream_history",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
