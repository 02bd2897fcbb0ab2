"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from foldwright.plans import QUERIES
from foldwright.session import build_session

HEADLINE = [
    "feature_frame",
    "stratified_folds",
    "block_folds",
    "tail_holdout",
    "log_standardise",
    "feature_drop_list",
    "rmspe_by_fold",
    "gini_by_fold",
    "lorenz_curve",
    "gram_matrix",
    "blend_weight_grid",
    "greedy_full",
    "recipe_replay",
    "prefix_best",
    "rank_average",
    "rank_pairs",
    "trial_grid",
    "knn_join",
    "knn_join_blocked",
    "smote",
    "stack_matrix",
    "oof_linear",
    "oof_forest",
    "oof_gbt",
]
#: Median of so many runs; a query whose first run takes longer than ``ONCE`` seconds is run once.
RUNS, ONCE = 3, 20.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flagship"](spark, folder).collect()  # warm-up: session, scan and shuffle code
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS):
            start = time.perf_counter()
            # the noop sink computes every row and column without moving them to the driver
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
            if took[0] > ONCE:
                break
        seconds[name] = round(statistics.median(took), 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
