"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is executed to completion with the no-op sink (every row is
produced, nothing is collected to the driver). Every query runs once as a
warm-up (JIT, code generation, file listing); the cache is then cleared and
the query timed on a second run, so no timing reads another run's cache. The
whole runs (exploration and report included) are timed once: order status with
one model, document quality with all three.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabloom.plans.experiment import run_experiment  # noqa: E402
from tabloom.plans.queries import QUERIES  # noqa: E402
from tabloom.session import build_session  # noqa: E402
from tabloom.sources.tables import document_features, order_features  # noqa: E402

HEADLINE = [
    "table_shape", "missing_report", "cardinality", "numeric_stats", "top_values",
    "correlation_matrix", "structure_report", "class_balance",
    "dedup_rows", "impute_median", "iqr_clip", "cleaning_report",
    "ordinal_encode", "one_hot_encode", "standard_scale", "mi_classification", "mi_regression",
    "train_test_split", "metric_prf_weighted", "metric_auc_binary", "metric_auc_ovr",
    "metric_regression", "model_comparison",
    "histogram_density", "kde_curve", "box_stats", "category_bars",
    "run_transitions_valid", "run_latest_state", "stage_timeline", "run_errors",
    "column_types", "safe_identifier", "train_linreg",
]


def run_orders(spark, sf_dir):
    return run_experiment(order_features(spark, sf_dir), "o_orderstatus", id_col="o_orderkey",
                          config={"training": {"models": ["logistic_regression"]}})


def run_documents(spark, sf_dir):
    return run_experiment(document_features(spark, sf_dir), "quality", id_col="doc_id")


FULL_RUNS = {"full_run_logreg": run_orders, "full_run_three_models": run_documents}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times = {}
    for key in HEADLINE:
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        spark.catalog.clearCache()
        t0 = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    for key, run in FULL_RUNS.items():
        spark.catalog.clearCache()
        t0 = time.time()
        res = run(spark, sf_dir)
        if res.errors:
            raise RuntimeError(res.errors)
        times[key] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))


if __name__ == "__main__":
    main()
