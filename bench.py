"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``.  Every query runs in
full into a sink that throws the rows away.  Interactive queries are the mean of three runs in a warm
session, as the published numbers are means of ten; jobs run once.
"""

from __future__ import annotations

import json
import os
import time

from sherdline.plans import load_all
from sherdline.plans.registry import REGISTRY, runner
from sherdline.session import local_session

INTERACTIVE = ["scan_fragments", "page_fragments", "filter_flags", "filter_fragments", "count_fragments", "keyword_search", "get_by_id", "suggest_fragments"]
JOBS = [
    "sort_by_relevance", "update_metadata", "bulk_delete_matches", "best_matches", "integrity_findings", "slo_report", "line_count_accuracy",
    "tune_thresholds", "best_checkpoint", "stratified_split", "balanced_order", "rank_matches", "rerank", "lines_from_detections",
    "merge_updates", "quadrant_edges", "candidate_edges", "find_matches_indexed", "embedding_candidates", "placement", "overlap_check",
    "hull_segments", "oriented_runs", "ticks_adaptive",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES")
    load_all()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "sherdline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/part.parquet").count()  # start the JVM's workers before the first timing
    seconds = {}

    def timed(name: str) -> float:
        start = time.time()
        runner(REGISTRY[name])(spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    if not wanted:
        for name in INTERACTIVE:
            timed(name)  # warm the session
    for name in wanted.split(",") if wanted else INTERACTIVE + JOBS:
        runs = [timed(name) for _ in range(3 if name in INTERACTIVE else 1)]
        seconds[name] = round(sum(runs) / len(runs), 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
