"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pagesieve.plans.catalog import QUERIES
from pagesieve.session import local_session

HEADLINE = [
    "site_report", "x1_extract_markdown", "x2_extract_stripped", "x3_extract_main", "x5_extract_article",
    "x8_dedup_segments", "x9_extract_precision", "x9_extract_full", "u10_validate_urls_once", "rd1_resolve_redirects",
    "a1_pick_winner", "a3_scrape_result", "a5_tier_benchmark", "w1_truncate_after_winner", "w2_completion_order",
    "j4_latest_snapshot", "t1_search_top_k", "x12_assemble_ocr", "st2_stream_race",
]
PAGE_QUERIES = ["site_report", "x1_extract_markdown", "x2_extract_stripped", "x5_extract_article", "x9_extract_precision"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", **{"spark.pagesieve.tasks": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times: dict[str, float] = {}
    for name in names:
        samples = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        times[name] = round(statistics.median(samples), 3)
    rates = {q: round(pages / times[q]) for q in PAGE_QUERIES if q in times}
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"), "runs": runs, "pages_per_sec": rates,
    }))


if __name__ == "__main__":
    main()
