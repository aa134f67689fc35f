"""Headline timings: python bench.py  ->  one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs its whole plan through a ``noop`` sink (no driver collect);
model queries time ``fit`` plus scoring the holdout.  Before timing, the
flagship query and the feature table run once on the sf0.001 smoke tables
(untimed JVM/JIT warm-up); every timed run then reads the benchmark tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tillcast.operators import windows  # noqa: E402
from tillcast.plans import features, models, q_aggregates, q_models  # noqa: E402
from tillcast.session import get_session  # noqa: E402
from tillcast.sources import panels  # noqa: E402
from tillcast.sources.tables import read  # noqa: E402


def run_noop(df):
    df.write.format("noop").mode("overwrite").save()


def q_feature_table(spark, sf):
    run_noop(features.feature_table(spark, sf))


def q_rmspe_group_mean(spark, sf):
    run_noop(q_aggregates.ag13(spark, sf))


def q_lag_bank_orders(spark, sf):
    """Sparse panel (customer x order) that grows with the data: 14+14 lags/leads."""
    p = panels.p2_sparse(spark, sf)
    offs = list(range(1, 15)) + [-k for k in range(1, 15)]
    run_noop(windows.shift_cols(p, ["Sales", "Open"], offs, order=["Date", "Seq"], blocked=True))


def q_lag_bank_lineitem(spark, sf):
    """(supplier, ship day) panel from lineitem, order key tie-break."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    p = li.select(F.col("l_suppkey").alias("Store"), F.to_date("l_shipdate").alias("Date"),
                  "l_orderkey", "l_linenumber", "l_quantity")
    out = windows.shift_cols(p, ["l_quantity"], [1, 2, 3, 7, 14, -1, -2, -3],
                             order=["Date", "l_orderkey", "l_linenumber"], blocked=True)
    run_noop(out)


def q_refurb_sparse(spark, sf):
    p = panels.p2_sparse(spark, sf)
    run_noop(windows.refurb_features(p, order=["Date", "Seq"], blocked=True))


def q_per_store_ols(spark, sf):
    run_noop(q_models.ml11b(spark, sf))


def q_per_customer_ols(spark, sf):
    """Per-store regression on the sparse panel (one model per customer)."""
    from tillcast.plans import ols
    p = panels.p2_sparse(spark, sf).withColumn("y", F.ln("Sales")).withColumn("dow", F.dayofweek("Date"))
    run_noop(ols.fit_per_store(p, ["Promo", "Open", "dow"], "y"))


def q_blend_grid(spark, sf):
    run_noop(q_models.ml19(spark, sf))


def q_recursive_forecast(spark, sf):
    run_noop(q_models.ml22(spark, sf))


def _model_data(spark, sf):
    df = models.model_frame(spark, sf)
    cut = F.lit("2000-06-01").cast("date")
    fit = models.training_input(df.filter(F.col("Date") < cut))
    return fit, df.filter(F.col("Date") >= cut)


def q_gbt_50_trees(spark, sf):
    fit, valid = _model_data(spark, sf)
    m = models.boosted(models.NUMERIC_FEATURES, iters=50, depth=6, step=0.1).fit(fit)
    run_noop(models.predict_sales(m, valid, ["Store", "Date"]))


def q_rf_50_trees(spark, sf):
    fit, valid = _model_data(spark, sf)
    m = models.forest(models.NUMERIC_FEATURES, trees=50, depth=12).fit(fit)
    run_noop(models.predict_sales(m, valid, ["Store", "Date"]))


QUERIES = {
    "feature_table": q_feature_table,
    "rmspe_group_mean": q_rmspe_group_mean,
    "lag_bank_orders": q_lag_bank_orders,
    "lag_bank_lineitem": q_lag_bank_lineitem,
    "refurb_sparse": q_refurb_sparse,
    "per_store_ols": q_per_store_ols,
    "per_customer_ols": q_per_customer_ols,
    "blend_grid": q_blend_grid,
    "recursive_forecast": q_recursive_forecast,
    "gbt_50_trees": q_gbt_50_trees,
    "rf_50_trees": q_rf_50_trees,
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="tillcast-bench")
    smoke = "/root/testdata/sf0.001"
    if os.path.isdir(smoke):  # untimed warm-up on the smoke tables
        run_noop(q_aggregates.ag13(spark, smoke))
        run_noop(features.feature_table(spark, smoke))
    read(spark, sf_dir, "nation").count()
    times = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn(spark, sf_dir)
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
