"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tidewave.queries import QUERIES
from tidewave.sources.io import workspace

HEADLINE = [
    "panel_wide",
    "panel_dense",
    "row_and_dense_index",
    "corr_within",
    "corr_between",
    "m_sd_by_wave",
    "expand_grid",
    "interval_by_parameter",
    "interval_by_rank",
    "predict_grid_students",
    "cohens_d_students",
    "cohens_d_schools",
    "loglik_students",
    "posterior_predictive_summary",
    "impute_score",
    "is_loo",
    "psis_loo",
    "merge_fitted",
    "dropout_panel",
    "dropout_loglik_by_draw",
    "dropout_odds_ratios",
    "counterfactual_summary",
    "parameter_summary",
    "sampler_health",
    "check_design",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with workspace(spark):
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
