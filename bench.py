"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from dealtide.plans import QUERIES
from dealtide.session import build_session

HEADLINE = [
    "post_funnel", "engagement_by_retailer", "utm_content_metrics", "daily_metrics", "campaign_go_no_go", "all_events",
    "dedupe_view_hits", "infer_promo_type", "product_history", "search_products", "deduplicate_deals", "text_lines",
    "leaflet_deals", "jsonld_deals", "page_text_deals", "bucket_responses", "pick_folder_link", "validate_docs",
    "health_summary", "coverage_counts", "detect_changes", "change_history", "nearest_store_distance", "nearest_stores",
    "extraction_fallback", "card_deals", "upsert_products", "health_entries", "run_log", "stream_upsert_products",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
