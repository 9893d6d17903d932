"""Headline-query benchmark.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed fully with the ``noop`` sink (no driver collect).  The
warehouse ingest is timed on its own ("ingest"); the other queries read the
stored warehouse, as they would in production.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "normalize_postings",
    "top_tags",
    "salary_dist",
    "quality_report",
    "market_snapshot",
    "market_snapshot_range",
    "parse_queries",
    "text_match",
    "ngram_search",
    "text_match_selective",
    "ngram_search_selective",
    "search_baseline",
    "search_adaptive",
    "match_expanded",
    "alert_digest",
    "alert_log",
    "rerank",
    "stream_ingest",
    "events_daily_new",
    "ingest_csv",
    "ndcg",
    "eval_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from hirelake.plans import catalog as C
    from hirelake.session import local_session, ship_package

    spark = local_session(cores=cpus, shuffle_partitions=cpus * 2, app="hirelake-bench")
    ship_package(spark)
    times: dict[str, float] = {}
    t0 = time.time()
    C._wh(C._tables(spark, sf_dir))
    times["ingest"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        if name not in C.QUERIES:
            continue
        t0 = time.time()
        C.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
