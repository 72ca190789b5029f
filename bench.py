"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the scale.
Each query runs BENCH_RUNS times (default 3) after one warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from demandloom.plans import catalog  # noqa: E402
from demandloom.session import build_session  # noqa: E402

HEADLINE = (
    "scan_filters",
    "upsert",
    "profile_lineitem",
    "quality_check",
    "gatekeeper_passed",
    "drop_outliers",
    "scale_standard",
    "explode_orders",
    "daily_demand",
    "import_orders_sales",
    "business_kpis",
    "revenue_breakdown",
    "inventory_status",
    "describe",
    "correlation_matrix",
    "resample_monthly",
    "demand_trends_week",
    "product_sales_history",
    "lag_features",
    "series_stats_month",
    "trend",
    "anomaly_scan",
    "reorder_plan",
    "insight_facts",
    "forecast_naive",
    "forecast_arima",
    "stream_metric_cache_hourly",
)
# The heaviest queries, timed once each without a warm-up; not part of the sum.
HEAVY = ("forecast_arimax", "backtest", "power_transform_box_cox", "ingest_table", "stream_sync")
# Two times a hundred rounds of boosting over all products: minutes each, with BENCH_TREES=1.
TREES = ("train_gbt", "predict_demand")


def run_once(query, spark, sf) -> float:
    begun = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "demandloom-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        run_once(query, spark, sf)
        times[name] = round(statistics.median(run_once(query, spark, sf) for _ in range(runs)), 3)
    heavy = {}
    for name in HEAVY + (TREES if os.environ.get("BENCH_TREES") else ()):
        heavy[name] = round(run_once(catalog.QUERIES[name], spark, sf), 3)
    spark.stop()
    result = {
        "metric": "headline queries, sum of median warm wall times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "heavy": heavy,
        "sf": os.path.basename(sf.rstrip("/")),
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
