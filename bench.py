"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
data and the local cores; BENCH_QUERIES may name other queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cadencia.plans import QUERIES
from cadencia.session import build_session

HEADLINE = [
    "cycle_summary",
    "cycles_same_label",
    "nearest_event_flag",
    "interpolate_at_events",
    "patch_by_time",
    "scheme_detect",
    "overlay_merge",
    "best_variant",
    "match_cores",
    "inventory",
    "unique_labels",
    "qc_flags",
    "side_mode_counts",
    "descriptives",
    "compare_groups",
    "subphase_metrics",
    "envelope_series",
    "spline",
    "median_wave",
    "pca_wave",
    "xcorr_best",
    "curve_f",
    "silhouette",
    "dtw_cluster_stats",
    "soft_dtw_cluster_stats",
    "score_clustering",
    "kmedoids",
    "remap",
    "online_cycles",
    "cycles_many_definitions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark = build_session(
        "cadencia-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one query on the smallest plan starts the JVM and the Python workers
    QUERIES["demean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["spline"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    # the same work in every round: ratios to it tell a slow machine from a slow query
    t = time.perf_counter()
    spark.range(60_000_000).selectExpr("sum(pmod(xxhash64(id), 1000) * sqrt(id))", "count(distinct id % 100003)").collect()
    control = round(time.perf_counter() - t, 3)
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
        print(n, took[n], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "control": control,
                "ratios": {n: round(x / control, 3) for n, x in took.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )


if __name__ == "__main__":
    main()
