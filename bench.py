"""Measures the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
Every query is run to its last row; building its plan counts too.
"""

from __future__ import annotations

import json
import os
import sys
import time

from postingworks.catalog import QUERIES
from postingworks.session import local_session

HEADLINE = (
    "strip_html", "pages_by_link", "document_term_rules", "document_facts", "title_and_location_rules", "title_rules_top",
    "hidden_totals", "salary_extraction", "experience_extraction", "sponsorship_class", "pay_sentence", "identity_match",
    "unanimous_card_dates", "fresh_postings", "repost_pairs", "liveness", "evergreen_roles", "id_date_correlation",
    "board_signatures", "listing_completeness", "health_listing_counts", "backfill_changes", "json_listings",
    "open_queue", "search_expression", "pruned_entries",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), name="bench")
    spark.read.parquet(f"{folder}/orders.parquet").count()
    only = sys.argv[1:]
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        df = QUERIES[name](spark, folder)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
