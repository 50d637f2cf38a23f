"""Times the headline queries on the tables of $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import logging
import os
import sys
import time

from stockline import plans, session

HEADLINES = [
    "stores_per_day",
    "stock_metrics",
    "returned_after_absence",
    "maker_match",
    "change_events",
    "transitions",
    "sales_trailing12",
    "price_percentile",
    # The index written anew and brought up to date, then searched.
    "index_refresh",
    "search_ranked",
    "local_answer",
    "digest_match",
    "intent_reconcile",
    "sessionize",
    "source_engagement",
    "top_breakdowns",
    "drawing_odds",
    # The rating of all codes with its writing; the profiles' writing; their index and the lists.
    "classify_rarity",
    "attribute_extract",
    "recommend",
]


def main() -> None:
    logging.disable(logging.CRITICAL)
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.load().queries()
    names = sys.argv[1:] or HEADLINES
    queries["observed_days"](spark, folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": folder.rstrip("/").split("sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
