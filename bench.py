"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local threads.
The derived race tables are written first (reported as setup): the reports read stored
tables, as they would in use. Every query runs twice; the second run counts, both are shown.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from furlong import catalog
from furlong.catalog import base

HEADLINE = [
    "q_min_slice", "evaluated_view", "perf_summary", "perf_history_page", "perf_daily_chart", "diagnostics_view",
    "diag_summary", "group_performance", "shadow_segments", "pnl_flat_stake", "pnl_streaks", "asof_market_strict",
    "asof_feature_frame", "training_dataset", "history_rolling_n", "roc_auc", "average_precision", "rank_metrics",
    "roi_topn_drawdown", "psi_numeric", "feature_drift", "results_coverage", "id_priority_chain", "field_completeness",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    started = time.time()
    for table in (base.snapshots, base.program, base.field, base.results, base.predictions, base.prediction_results):
        table(spark, directory)
    setup = time.time() - started
    times, first = {}, {}
    for name in HEADLINE:
        for seen in (first, times):
            t0 = time.time()
            queries[name](spark, directory).write.format("noop").mode("overwrite").save()
            seen[name] = round(time.time() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "first_run": first, "setup_sec": round(setup, 3), "sf": directory.rstrip("/").split("sf")[-1],
                "cpus": int(cpus),
                "rows": {t: base_rows(spark, directory, t) for t in ("lineitem", "orders", "events")},
            }
        )
    )


def base_rows(spark: SparkSession, directory: str, table: str) -> int:
    return spark.read.parquet(f"{directory}/{table}.parquet").count()


if __name__ == "__main__":
    main()
