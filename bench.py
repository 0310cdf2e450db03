"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. Each query runs once to warm up and three times more; the
median counts. Results go to the noop sink, so every row and column is computed."""

from __future__ import annotations

import json
import os
import statistics
import time

from tallyforge.session import build_session

HEADLINE = [
    *(f"tpch_q{k:02d}" for k in range(1, 23)),
    "agg_group_one", "agg_count_distinct", "agg_many_distinct", "grouping_sets", "cube", "pivot", "join_full", "join_asof", "join_triangles", "window_sum_running", "window_rank", "window_top_per_group", "top_k", "intersect", "cte_recursive",
    "string_functions", "date_part_year", "json_value", "hll_estimate", "count_min", "quantile_sketch", "hamming_filter", "cosine_top_k", "web_group_type", "web_users_per_type", "stream_sessions",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    from tallyforge.queries import QUERIES

    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "total seconds of headline queries, warm, median of 3", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
