"""Time the headline queries; prints one JSON line.

Each query is run to completion twice on the whole tables at $BENCH_SF_DIR with
local[$BENCH_CPUS]; "queries" holds the second (warm) run, "cold" the first. "jobs" holds
queries that land files, keep state or train, run once after these.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from fieldspark import catalog

HEADLINE = [
    "flagship",
    "build_combined",
    "merge_insert_only",
    "dedup_last",
    "enrich_weather",
    "backfill_weather",
    "lookback_expand",
    "missing_weather_dates",
    "positive_days_per_site",
    "correlation_matrix",
    "boxplot_stats",
    "boxplot_stats_per_site",
    "fit_standardizer",
    "standardize",
    "fit_dictionary",
    "label_encode",
    "one_hot_columns",
    "time_series",
    "attach_sequence",
    "moving_kernel",
    "pool_windows",
    "exact_split",
    "hash_split",
    "seeded_shuffle",
    "preview",
    "scatter_bins",
    "softmax",
    "layer_norm",
    "dense_score",
    "training_features",
]
# Jobs that land files, keep state or train: timed once, beside the total.
JOBS = [
    "read_inspections",
    "assign_batches",
    "merge_into_bucketed",
    "incremental_backfill",
    "incremental_merge",
    "keyed_merge",
    "training_matrix_days",
    "sparse_training_matrix",
    "train_and_evaluate",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {"cold": {}, "warm": {}, "jobs": {}}
    for run, names in (("cold", HEADLINE), ("warm", HEADLINE), ("jobs", JOBS)):
        for name in names:
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[run][name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_warm",
                "value": round(sum(times["warm"].values()), 3),
                "unit": "sec",
                "queries": times["warm"],
                "cold": times["cold"],
                "jobs": times["jobs"],
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
