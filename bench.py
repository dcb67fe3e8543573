"""Time the headline queries: one warm-up run, then the timed run, both into the noop sink."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from saccadia.session import build_session  # noqa: E402
from workload import registry  # noqa: E402

HEADLINES = [
    "clean_reaction", "removed_trials", "ffill", "bffill", "std_time", "stimulus_active", "trial_windows",
    "drop_blink_saccades", "drop_blink_overlap", "prep_anti_saccade", "prep_shapes", "prep_king_devick", "assign_trials",
    "asof_backward", "asof_nearest", "precalc_metrics", "fix_distance", "fix_per_s", "sacc_per_s", "antisacc_correct",
    "reaction_reaction_time", "fitts_overshoot", "kd_wrong_dir", "asc_roundtrip", "scan_path_evil_bastard",
    "prep_samples", "acceleration", "disconjugacy", "samples_with_nearest_fixpoint", "distance_to_stimulus", "playback",
    "feature_matrix", "corr_pairs", "mad_outliers", "mann_whitney", "mann_whitney_documents", "survey_latest", "multi_hot",
    "davies_bouldin", "core_distance", "silhouette_exact", "knee_cut",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINES
    spark = build_session("saccadia-bench", f"local[{cpus}]", int(cpus), spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            registry.SPARK[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total query time, second run", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
