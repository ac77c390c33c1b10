"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Each query is run once to warm up and then BENCH_RUNS times (default 3); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricetrace.catalog import QUERIES  # noqa: E402
from pricetrace.session import local_session  # noqa: E402

HEADLINE = [
    "monthly_price_change",
    "keyword_counts_weighted",
    "article_ranking",
    "monthly_policy_analysis",
    "best_articles_tfidf",
    "monthly_policy_tfidf",
    "term_discovery",
    "page_fields",
    "trace_articles",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus)
    times, rows = {}, {}
    for name in chosen:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            rows[name] = len(QUERIES[name](spark, sf).collect())
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds[1:]), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline queries, median seconds, summed",
        "value": total,
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": os.path.basename(sf.rstrip("/")),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
