"""Times the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from threadloom.plans import QUERIES
from threadloom.session import get_spark

HEADLINE = [
    "severity_score", "contradiction_pairs", "priority_screen", "pii_rules", "multipass_consensus",
    "language_guess", "entity_rollup", "keywords_topk", "sentence_split", "fixed_chunks",
    "passage_chunks", "line_search_context", "tool_stats", "hourly_stats", "rolling_rate",
    "event_segments", "cluster_ids", "cross_platform_links", "exact_dups", "line_bag_diff",
    "vector_topk", "near_dup_vectors", "bm25_topk", "textrank_sentences", "custody_verify",
    "graph_neighbors", "case_hierarchy", "html_messages", "stream_hourly",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="20g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start-up and the first text query's code generation are not part of the figures
    QUERIES["entity_matches"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall-clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
