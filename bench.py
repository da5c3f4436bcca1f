"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from planloom.plans import load_all  # noqa: E402
from planloom.session import local_session  # noqa: E402

HEADLINE = [
    "relationship_stats", "within_distance", "intersecting_pairs", "on_layer_pairs", "line_symbol_edges", "nearest_symbol",
    "contains_polygon", "associate_text", "vector_topk", "vector_join", "components", "system_paths", "nms_distance",
    "fuse_lines", "merge_collinear", "clean", "classify_documents", "parse_annotations", "upsert_elements", "validate",
    "file_context", "summarize_conversation", "token_budget", "debounced_changes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    queries = load_all().QUERIES
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
