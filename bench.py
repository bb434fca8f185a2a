"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from skyledger.session import build_session
from skyledger.workloads import WORKLOADS

HEADLINE = (
    "latest_reviews", "filtered_targets", "review_overview", "review_positions", "export_targets", "target_index",
    "overlap_groups_by_threshold", "merged_targets", "suppressed_detections", "agreed_detections", "teacher_agreement_per_image",
    "line_evidence", "prompt_quantiles", "label_audit_by_split", "sanitized_objects", "hash_split", "aoi_manifest", "coverage_sample",
    "nearest_position", "trajectory_features", "candidate_window", "many_windows", "topology_issues", "candidate_gate", "vehicle_gate",
    "threshold_scores", "mask_components", "layer_overlaps", "functional_map", "reply_labels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    # Warm the session so that the first query does not pay for starting it.
    WORKLOADS["class_histogram"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        WORKLOADS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else sf_dir,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
