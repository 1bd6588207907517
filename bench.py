"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {name: sec}, "sf": ...}

Each query is executed in full with the ``noop`` sink (every row computed, none
collected).  One warm-up query on the smallest scale factor runs first so JVM
start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txrisk.plans import catalog  # noqa: E402,F401
from txrisk.plans.registry import HEADLINE, QUERIES  # noqa: E402
from txrisk.session import get_spark, release_shared  # noqa: E402

# one forest of 20 trees, depth 10, all features; a search over two forests of 20 trees under 5-fold CV.
MODEL_QUERIES = ["train_logistic", "train_forest", "tune_forest"]
PROBES = {"train_forest": {"num_trees": 20, "max_depth": 10, "featureSubsetStrategy": "all"},
          "tune_forest": {"space": {"numTrees": [20], "maxDepth": [6, 10], "minInstancesPerNode": [1],
                                    "featureSubsetStrategy": ["sqrt"]}, "n_iter": 2}}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or (HEADLINE + MODEL_QUERIES)
    extra = {}
    log_dir = os.environ.get("BENCH_EVENT_LOG_DIR")   # optional: stage / task times via the event log
    if log_dir:
        os.makedirs(log_dir, exist_ok=True)
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir}
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8), app_name="txrisk-bench",
                      extra=extra, driver_memory="16g")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        QUERIES["engineer_features"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        release_shared()                 # nothing that an earlier query kept may serve this one
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir, **PROBES.get(name, {})).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
