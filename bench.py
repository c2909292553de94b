"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loghelm.plans import catalog  # noqa: F401
from loghelm.plans.registry import QUERIES
from loghelm.session import build_session

HEADLINE = [
    "parse_syslog_table",
    "clean_messages",
    "mask_messages_v2",
    "normalize_upload",
    "dedup_records",
    "block_label_lookup",
    "correlate_events",
    "live_detection",
    "anomaly_list",
    "anomaly_stats",
    "hourly_activity",
    "case_status",
    "dataset_summary",
    "features_structured_20",
    "features_described",
    "tf_idf_corpus",
    "threshold_sweep",
    "curve_areas",
    "score_percentiles",
    "compare_models",
    "stratified_folds",
    "detection_factors",
    "shown_factors",
    "recommendations",
    "logistic_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").split("/sf")[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
