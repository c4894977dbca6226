"""Headline queries, timed twice warm: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyforge.plans import QUERIES  # noqa: E402
from tallyforge.session import local_session  # noqa: E402

HEADLINE = [
    "al14_rca_truth_test", "al13_rca_lift_recent", "al3_max_error_capability", "al2_spc_fleet", "al1_spc_ranking", "al29_telemetry_1m", "al29_telemetry_1h",
    "ag4_stddev", "al38_fleet_kpis", "al49_state_grid", "al10_zscore_anomaly", "al11_alarm_context", "al15_machine_snapshot", "al52_board_trace", "al5_yield_pct",
    "al36_action_queue_top", "al42_ingest_latency", "jn9_latest_per_key", "al8_nelson_rules", "al8_nelson_rules_split", "al7_cusum", "al6_ewma", "al20_disk_forecast",
    "al28_infra_weekly", "al30_direct_hourly", "al17_event_timeline", "al43_burst_report", "al56_alarm_pareto", "wn8_counter_rate", "sm6_debounce", "sm7_lifecycle_fold",
    "sm11_inhibit", "prj5_unpivot_samples", "jn5_asof_nearest", "jn6_asof_backward", "ag8_percentile",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tallyforge-bench")

    def run(name: str) -> float:
        start = time.perf_counter()
        # every row and column is produced, nothing is collected
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took = {}
    for name in HEADLINE:
        run(name)
        took[name] = round(statistics.median(run(name) for _ in range(2)), 4)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
