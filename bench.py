"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores (default 8). Every query
is run to completion into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "nms_plain",
    "nms_containment",
    "dedup_containment",
    "match_greedy",
    "match_class_aware",
    "pair_boxes",
    "seed_density",
    "adaptive_decision",
    "accept_topk",
    "accept_adaptive_k",
    "accept_global_tau",
    "accept_otsu",
    "accept_rate",
    "automate_all",
    "operating_curve",
    "defect_escape",
    "correct_count_fidelity",
    "batch_accuracy",
    "average_precision",
    "label_status",
    "score_histogram",
    "draw_seed",
    "coco_annotations",
    "label_studio_regions",
    "fabricate_deviated_refined",
    "session_activity",
    "box_outcome",
)


def main() -> None:
    from annospark import fixtures as fx, registry
    from annospark.session import local_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="annospark-bench")
    queries, seconds = registry.queries(), {}

    start = time.perf_counter()
    fx.candidates(spark, sf_dir)
    seconds["derive_candidates"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
