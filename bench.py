"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rotorline.plans.catalog import QUERIES  # noqa: E402
from rotorline.session import build_session  # noqa: E402

HEADLINE = (
    "src_05_pivot_measurements", "src_06_running_filter", "cln_01_first_per_timestamp", "cln_03_quality_codes", "cln_15_resample",
    "per_01_operation_periods", "det_24_annotation_run", "joi_01_nearest_join", "fea_02_smoothing", "sco_07_level1_days",
    "sco_12_smoothed_error", "fus_08_rate_limit", "cal_10_conformal_quantile", "eva_01_auc", "eva_14_multiplier_search",
    "mon_08_seasonal_stats", "out_02_local_outlier_factor", "str_09_stream_resample",
    "sco_17_step_table", "eva_15_holdout_check", "eva_16_seasonal_evaluation", "mon_14_error_examples", "det_20_outlier_vote",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "rotorline-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
