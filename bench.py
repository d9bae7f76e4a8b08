"""Time the headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input and the cores.
Each query runs in full into a sink that discards the rows; the first run of each warms up the JVM and
is not counted.
"""

from __future__ import annotations

import json
import os
import time

from gridpulse.plans import catalog
from gridpulse.session import local_session

HEADLINE = [
    "s1_read_feed", "s6_append_idempotent", "p8_coerce_numeric", "e2_imbalance_pct",
    "j1_align_outer", "j1_align_outer_by_join", "j2_align_inner", "j4_nest_children",
    "w123_fill_gaps", "w123_fill_gaps_single_series", "w4_dedupe_keep_first", "w5_row_index",
    "t2_latest_by_device", "t3_history", "a7_classification_report", "a9_regression_metrics",
    "b1_insert_unique", "b2_insert_children", "m2_random_split", "m4_logistic", "m5_rf_classifier",
    "m6_gbt_classifier", "m7_ridge", "m8a_rf_regressor", "m8b_gbt_regressor", "m9_fit_candidates", "m10_iforest_fit", "m11_iforest_flag", "m13_score_batch", "risk_levels_by_hour",
    "telemetry_frame", "st1_monitor_stream", "st2_ingest_stream",
]


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores)
    seconds = {}
    for name in HEADLINE:
        run(spark, name, folder)
        seconds[name] = round(run(spark, name, folder), 3)
    scale = os.path.basename(folder).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
