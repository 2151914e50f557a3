"""Time the headline queries; prints one JSON line.

Each query runs to a sink that discards rows, so the time covers the whole result.
``BENCH_ONLY`` takes a comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "hotspots_topk", "edge_degree", "deps_downstream", "edges_of_kind", "valid_edges", "edge_upsert_last_wins",
    "rust_items", "ts_specifiers", "resolve_mod", "resolve_ts_normalized", "index_edges", "commit_log_roundtrip",
    "newest_commits", "cochange_pairs", "cochange_confidence", "cochange_edges", "ownership_share", "ownership_edges",
    "blame_dumps", "blame_by_commit", "blame_carry_forward", "blast_out", "blast_undirected_depth_kind",
    "blast_all_sources_size", "report_nodes", "node_cochange_top6", "batch_requests", "stream_requests",
    "ownership_ranked", "co_changes_symmetric", "report_stats", "graph_json", "blast_deep",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_ONLY")
    names = chosen.split(",") if chosen else HEADLINE
    QUERIES["hotspots_topk"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up, not timed
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
