"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialspark.plans import load_all  # noqa: E402
from trialspark.session import build_session  # noqa: E402

HEADLINE = (
    "a01_trial_jsonl_source", "a04_log_text_source", "a06_result_upsert", "b01_score_log_extraction",
    "b08_param_expansion", "b14_trial_scoring", "b15_rescore_job", "b20_pair_validation", "c01_score_filter",
    "d01_trials_with_labels", "d03_todo_grid", "d05_packet_range_sum", "d06_zone_asof_join",
    "d10_segments_features_best", "d11_frames_in_segment", "d13_predict_unseen_crf", "e01_uid_summary",
    "e03_clip_summary", "e04_metric_distribution", "e07_calibration_percentiles", "e09_sweep_summary",
    "e11_surface_pivot", "e14_pass_interval", "f01_streak_index", "f03_best_trial", "f04_last_wins_dedupe",
    "f09_incumbent_trace", "f14_next_probes", "f24_budgeted_windows", "g07_grid_order", "i06_full_param_set",
    "i09_segment_plan", "j04_windowed_scores_sliding", "k02_contiguous_folds",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
                                                       "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # JVM warm-up
    took = {}
    for name in names:
        t0 = time.time()
        queries[name].frame(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
