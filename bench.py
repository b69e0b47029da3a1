"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from photospark.checks import load_checks  # noqa: E402
from photospark.session import build_session  # noqa: E402

HEADLINE = [
    "strata_report", "p2_resolve_fields", "a1_exactly_one", "a4_expert_targets", "a5_label_stats", "g3_group_split", "j6_near_dup_pairs",
    "j7_burst_pairs", "g2_connected_components", "a11_features_132", "a20_stratified_metrics", "a33_paired_bootstrap", "x4_apply_wb",
    "x6_natural_adjust", "j20_apply_lut3d", "j19_score_labels", "x9_scene_limits", "a42_fingerprint", "w4_rank_errors", "l1_incremental",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{path}/region.parquet").count()
    checks = load_checks()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        checks[name].run(spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
