"""Per-store OLS from moment sums vs brute-force least squares per store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.plans import ols
from tillcast.sources import panels

FEATS = ["Customers", "Promo", "SchoolHoliday", "DayOfWeek"]


def test_moment_solve_matches_lstsq(spark, sf_small):
    o = (panels.p1_train(spark, sf_small).filter(F.col("Sales") > 0)
         .withColumn("y", F.ln("Sales")).select("Store", "y", *FEATS))
    got = {r["Store"]: r["coef"] for r in ols.fit_per_store(o, FEATS, "y").collect()}
    pdf = o.toPandas()
    assert set(got) == set(pdf["Store"])
    for store, g in pdf.groupby("Store"):
        x = np.column_stack([np.ones(len(g))] + [g[f].to_numpy(dtype=float) for f in FEATS])
        y = g["y"].to_numpy()
        ref = np.linalg.lstsq(x, y, rcond=None)[0]
        # same fitted values (coefficients may differ only along collinear directions)
        assert np.allclose(x @ np.asarray(got[store]), x @ ref, atol=1e-6), store


def test_scoring_joins_by_key(spark, sf_small):
    o = (panels.p1_train(spark, sf_small).filter(F.col("Sales") > 0)
         .withColumn("y", F.ln("Sales")).select("Store", "Date", "y", *FEATS))
    m = ols.fit_per_store(o, FEATS, "y")
    scored = ols.score_per_store(o, m, FEATS)
    assert scored.count() == o.count()
    assert scored.filter(F.col("pred").isNull()).count() == 0


def test_large_offsets_and_collinear_columns_agree_with_qr(spark):
    rng = np.random.default_rng(4)
    n = 3000
    x = {"far": 2_000_000 + rng.normal(size=n), "near": rng.normal(size=n), "flat": np.full(n, 7.5)}
    for i in range(4):  # four indicators of one column: together they are the intercept
        x[f"d{i}"] = (np.arange(n) % 4 == i).astype(float)
    y = 3 + 0.5 * x["far"] - 2 * x["near"] + x["d1"] - x["d2"] + rng.normal(size=n) * 0.01
    rows = [(int(i % 2), *[float(x[c][i]) for c in x], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, ["Store", *x, "y"]).repartition(7)
    full, all_ = ["far", "near", "d1", "d2", "d3"], list(x)
    got = {r.Store: r for r in ols.fit_per_store(df, full, "y").collect()}
    over = {r.Store: r for r in ols.fit_per_store(df, all_, "y").collect()}
    for s in (0, 1):
        own = np.arange(n) % 2 == s
        # QR on centred columns; without loss of digits by the offset
        cols = full if s == 1 else ["far", "near", "d2"]  # even rows have d0 and d2 only
        a = np.column_stack([x[c][own] - x[c][own].mean() for c in cols])
        q, r = np.linalg.qr(a)
        yc = y[own] - y[own].mean()
        ref = dict(zip(cols, np.linalg.solve(r, q.T @ yc))) if s == 0 else None
        fitted = y[own].mean() + a @ np.linalg.lstsq(a, yc, rcond=None)[0]
        for model, names in ((got[s], full), (over[s], all_)):
            c = np.asarray(model.coef)
            mean = np.array([x[k][own].mean() for k in names])
            own_fit = (c[0] + mean @ c[1:]) + np.column_stack([x[k][own] - x[k][own].mean() for k in names]) @ c[1:]
            assert np.allclose(own_fit, fitted, rtol=0, atol=1e-8)
        if ref:
            assert got[s].coef[1] == pytest.approx(ref["far"], abs=1e-8) and got[s].coef[2] == pytest.approx(ref["near"], abs=1e-8)
        raw = np.column_stack([np.ones(own.sum()), x["far"][own], x["near"][own]])
        sums = np.linalg.solve(raw.T @ raw, raw.T @ y[own])
        centred = ols.fit_per_store(df.filter(f"Store = {s}"), ["far", "near"], "y").first().coef
        b = raw[:, 1:] - raw[:, 1:].mean(0)
        true = np.linalg.lstsq(b, yc, rcond=None)[0]
        assert np.allclose(centred[1:], true, rtol=0, atol=1e-8)
        assert not np.allclose(sums[1:], true, rtol=0, atol=1e-8)  # raw sums lose them
