"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Arguments: name prefixes to run instead.
Every query runs to completion (count of all result columns through the noop sink).
"""
import json
import os
import sys
import time

from pulsegrid.catalog import all_queries
from pulsegrid.session import build_session

HEADLINE = [
    "beat_clean_live", "beat_window_features", "beat_training_features", "beat_resting_hr", "scored_windows", "calibration_stats",
    "join_asof_nearest", "join_interpolate", "window_by_count", "window_moving_average",
    "evaluation_owner_metrics", "evaluation_validate_pairs", "evaluation_quantiles",
    "activity_typing", "activity_tracking", "activity_taps", "activity_tremor", "activity_vs_calm",
    "session_summary_numbers", "history_week_summary", "history_suggestion",
    "record_changes_since", "record_writes_accepted", "record_reconcile", "record_admission",
    "reading_scores", "signal_skin_conductance", "legacy_typing_mouse_windows", "legacy_hysteresis",
    "source_minute_hr_covered", "source_packet_beats", "stream_hourly_counts", "model_nested_loo_scores", "model_personal_fit",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    names = [n for n in known if any(n.startswith(p) for p in sys.argv[1:])] if len(sys.argv) > 1 else HEADLINE
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()  # start the engine before timing
    times = {}
    for name in names:
        t0 = time.time()
        known[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
