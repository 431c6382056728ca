"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tabloom.catalog.registry import load_all

HEADLINE = [
    "trim_table", "full_prepare", "score_batch", "knn_topk", "corr_matrix", "category_freq", "chi2_select",
    "anova_select", "iqr_bounds", "impute_numeric", "target_encode", "stratified_sample", "cv_folds",
    "dedup_by_key", "smote_counts", "classification_report", "classify_logistic_regression", "regress_random_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tabloom-bench-"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    checks = load_all()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the JVM's threads
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        checks[name].query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
