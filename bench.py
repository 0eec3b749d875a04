"""Benchmark: headline jobs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

Headline jobs (wall seconds each, fresh plan per job):
  panel          nation-month panel from orders/lineitem/customer (scan, joins, aggregates)
  features       full feature plan, materialized (entity windows, NaN drop, split)
  quality        range + IQR + null checks on the (materialized) panel
  metrics        3 baselines -> regression + business metrics
  train_cv       Gram -> select 15 -> ridge, grouped 5-fold CV from fold Grams
  walk_forward   36/3/3 walk-forward over all features (month Grams once)
  customer_panel customer-month panel + feature plan (rows grow with the data)
  forward_batch  monthly forecasts of all requests with the fixed model
  inverse_batch  inverse search of all requests (five rounds of 21 candidates)
  shap           exact SHAP values of the test rows
``train_cv`` and ``walk_forward`` work on an engineered panel that is written before their
time is taken; ``features`` has the time for that.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from panelengine.operators import metrics as M  # noqa: E402
from panelengine.operators import quality as Q  # noqa: E402
from panelengine.plans import training as TR  # noqa: E402
from panelengine.plans.catalog import load_all  # noqa: E402
from panelengine.plans.common import features, materialize, panel, raw  # noqa: E402
from panelengine.session import local_session  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    sf = sf_dir.rstrip("/").split("sf")[-1]

    def run_panel():
        return panel(spark, sf_dir).agg(F.count(F.lit(1)), F.sum("total_revenue")).collect()

    def run_features():
        return features(spark, sf_dir).count()

    def run_quality():
        r = materialize(raw(spark, sf_dir))  # one panel build shared by the check families
        Q.range_violations(r).collect()
        Q.iqr_outliers(r).collect()
        return Q.null_counts(r).collect()

    def run_metrics():
        w = M.all_baselines(features(spark, sf_dir))
        M.regression_metrics(M.to_long(w)).collect()
        return M.business_metrics(w).collect()

    shared = {}

    def engineered():
        if not shared:
            shared["feat"] = features(spark, sf_dir)
        return shared["feat"]

    def run_train_cv():
        feat = engineered()
        model, gf, sel = TR.train(feat)
        gs, shift = TR.fold_grams(TR.fit_rows(feat), sel)
        return TR.cross_validate_grams(gs, len(sel), shift)

    def run_walk_forward():
        scored, _, _ = TR.walk_forward(engineered())
        return TR.walk_forward_metrics(scored).collect()

    def run_customer_panel():
        return features(spark, sf_dir, level="customer").count()

    queries, _ = load_all()

    jobs = {
        "panel": run_panel,
        "features": run_features,
        "quality": run_quality,
        "metrics": run_metrics,
        "train_cv": run_train_cv,
        "walk_forward": run_walk_forward,
        "customer_panel": run_customer_panel,
        "forward_batch": lambda: queries["forecast_totals"](spark, sf_dir).collect(),
        "inverse_batch": lambda: queries["achievement"](spark, sf_dir).collect(),
        "shap": lambda: queries["shap_fixed_linear"](spark, sf_dir).count(),
    }
    only = [j for j in os.environ.get("BENCH_ONLY", "").split(",") if j]
    times = {}
    run_panel()  # JVM / file-system warm-up, not timed
    engineered()
    for name, fn in jobs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
