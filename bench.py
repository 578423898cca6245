"""Times the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the tables, the threads and the warm runs.

``llm_queries``, if those operators are there: one warm run of the lighter ones each, not in the total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["group_sum", "group_multi_key", "filter_sql", "select_expr", "join_inner", "join_shuffle_hash", "join_broadcast", "join_asof", "map_row", "map_batches", "pipeline_workload", "star_join", "top_k", "top_k_per_group", "window_rank", "window_running_sum", "agg_count_distinct", "stream_group_batch"]

LLM = ["op2_warc_segments", "op4_url_association_rules", "op8_best_fit_packing", "op9_quality_classifier", "op10_source_mixing"]


def main() -> None:
    from pyspark.sql import SparkSession

    from lakepipe import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):  # the first compiles code
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times[1:]), 3)
    extra = {}
    try:
        from lakepipe.llm import queries as llm
    except ImportError:
        llm = None
    for name in LLM if llm is not None else ():
        for _ in range(2):
            began = time.perf_counter()
            llm.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            extra[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "llm_queries": extra, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
