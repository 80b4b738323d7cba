"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trackplate import catalog  # noqa: E402
from trackplate.session import local_session  # noqa: E402

HEADLINE = [
    "fragment_summary", "fragment_adjacency", "fragment_components", "successor_links",
    "kinematics", "path_geometry", "shape_metrics", "diameter", "clean_segments", "detrend_peaks", "bridged_runs", "reversals", "turn_events",
    "merge_detections", "box_overlaps", "duplicate_pairs", "condition_rollup", "qc", "composition",
    "size_percentiles", "log_histogram", "kde", "otsu", "contrast", "reuse_plan", "pending_sync", "retention_list", "content_dedupe",
    "ingest_stream", "streaming_counts", "motility_summary", "crawling_tracks",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    queries["gaps"](spark, sf).write.mode("overwrite").format("noop").save()      # start-up cost
    times = {}
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf).write.mode("overwrite").format("noop").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
