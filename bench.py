"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
QUERIES = ["chunk_windows", "tokenize_tf", "bm25_topk", "vector_topk_batch", "rrf_fusion", "hybrid_retrieve", "edges_dedup_last", "graph_walk_2hop", "context_pack", "corpus_stats", "eval_tier_rollup"]


def main() -> None:
    os.chdir(os.path.dirname(os.path.abspath(__file__)))
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillspark.plans import binding, catalog

    queries, times = catalog.queries(), {}
    # The index build is a figure of its own: chunks, the lexical index, sections, parents, edges, adjacency, and the hits that walks start from.
    start = time.time()
    for build in (binding.chunks, binding.lexical_index, binding.sections, binding.parents, binding.edges_raw, binding.edges, binding.adjacency, binding.wide_hits):
        build(spark, SF_DIR)
    times["index_build"] = round(time.time() - start, 3)
    for name in QUERIES:
        took = []
        for _ in range(RUNS):
            start = time.time()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "median seconds of the headline queries, summed", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
