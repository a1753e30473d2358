"""Time the headline queries after one untimed run; prints one JSON line.

BENCH_SF_DIR  table folder   (default /root/testdata/sf0.1)
BENCH_CPUS    local threads  (default 4)
BENCH_ALL=1   every query of the catalog instead of the headline ones
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulsegrid.plans.catalog import QUERIES  # noqa: E402
from pulsegrid.session import local_session  # noqa: E402
from pulsegrid.workspace import clear, scope  # noqa: E402

HEADLINE = [
    "assign_slot", "grid_assign", "demand_cluster", "zoning_grid", "nearest_centroid",
    "zoning_centroids", "densify_calendar", "features_cluster", "lookup_demand",
    "mean_profile_global", "mean_profile_zone", "mean_profile_cell", "ols_zone_scored",
    "ols_zone_multi", "tree_zone_scored", "eval_rollup", "compare_all", "demand_hist",
    "profile_month", "index_slice",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "4")))
    seconds = {}
    # the first round compiles the plans, the second is what a long job sees
    for _ in range(2):
        for name in names:
            start = time.perf_counter()
            with scope(spark):
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                seconds[name] = round(time.perf_counter() - start, 3)
    clear(spark)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
