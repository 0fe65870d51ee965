"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads. Each query
runs once to warm up and once timed; results go to a no-op sink, so every row
is produced and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans import catalog  # noqa: E402
from plumbline.session import local_session  # noqa: E402

HEADLINE = [
    "calibration_report",
    "risk_sweep_metrics",
    "scaling_summary",
    "score_brier",
    "grade_predictions",
    "adv_grpo",
    "adv_gae",
    "is_weights_sequence",
    "offpolicy_metrics",
    "ppo_loss",
    "validation_metrics",
    "balanced_partitions",
    "multiturn_pack",
    "dense_topk",
    "bm25_topk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("plumbline-bench", cpus)
    spark.conf.set("spark.sql.shuffle.partitions", cpus)
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
