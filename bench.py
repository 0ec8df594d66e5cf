"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sessionlens.plans.queries import QUERIES  # noqa: E402
from sessionlens.session import build_session  # noqa: E402

# One warm-up and the faster of two runs ...
QUICK = ("signals_long", "signals_from_tables", "signals_nested", "rule_results", "diagnosed_sessions", "cause_counts",
         "similar_sessions", "confidence_scores", "feature_drift", "label_drift", "model_metrics", "scaled_features",
         "flat_features", "validation_counts")
# ... and one run of the long ones.
LONG = ("similar_sessions_tiled", "anomaly_report", "dbscan_sessions", "importance_permutation", "evaluate_models")


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    only = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else None
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in QUICK + LONG:
        if only and name not in only:
            continue
        if name in QUICK:
            run(spark, folder, name)
            times[name] = min(run(spark, folder, name) for _ in range(2))
        else:
            times[name] = run(spark, folder, name)
        print(f"{name}: {times[name]:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()},
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
