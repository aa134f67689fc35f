"""One least-squares regression per store (ML11-ML13).

The reference fits 1,115 models in a driver loop, each scanning the whole
table.  Here one ``groupBy(store)`` computes, for every store in a single pass,
the means and the *centred* co-moments of all columns (Spark's covariance
aggregates, which update and merge around running means, so a column like
2,000,000 + noise loses no digits as its raw sum of squares would).  A store
holding a third of the rows still ships one small row per task.  Each store's
tiny system is then scaled to correlations and solved in ``mapInPandas`` over the
moments table -- one row per store, no raw rows in Python.  Directions without
variance (collinear dummies, constant columns) get the least solution.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Correlation directions with less than this share of the greatest one count as collinear.
RANK_TOLERANCE = 1e-11


def store_moments(df: DataFrame, features: Sequence[str], target: str, store: str = "Store") -> DataFrame:
    """Per store: n, means of the features and the target, their co-moments (sums of products around the means, upper triangle)."""
    xs = [F.col(c).cast("double") for c in (*features, target)]
    clean = df.dropna(subset=[*features, target])
    n = F.count(F.lit(1))
    means = [F.avg(x) for x in xs]
    moments = [F.covar_pop(xs[i], xs[j]) * n for i in range(len(xs)) for j in range(i, len(xs))]
    return clean.groupBy(store).agg(n.alias("n"), F.array(*means).alias("means"), F.array(*moments).alias("moments"))


def solve_centred(means: np.ndarray, moments: np.ndarray) -> np.ndarray:
    """Coefficients, intercept first, from means and the upper triangle of the co-moments (target last)."""
    p = len(means) - 1
    c = np.zeros((p + 1, p + 1))
    c[np.triu_indices(p + 1)] = moments
    c = c + np.triu(c, 1).T
    scale = np.sqrt(np.maximum(np.diag(c)[:p], 0))
    # a column whose spread is rounding noise of its mean is constant
    live = scale > 1e-13 * np.abs(means[:p])
    safe = np.where(live, scale, 1.0)
    r = np.where(np.outer(live, live), c[:p, :p] / np.outer(safe, safe), 0.0)
    w, v = np.linalg.eigh(r)
    kept = w > RANK_TOLERANCE * max(w.max(initial=0.0), 1e-300)
    inverse = np.where(kept, 1 / np.where(kept, w, 1.0), 0.0)
    rhs = np.where(live, c[:p, p] / safe, 0.0)
    solve = lambda b: v @ (inverse * (v.T @ b))
    beta = solve(rhs)
    beta = beta + solve(rhs - r @ beta)  # one refinement step
    beta = np.where(live, beta / safe, 0.0)
    return np.concatenate([[means[p] - beta @ means[:p]], beta])


def solve_moments(moments: DataFrame, store: str = "Store") -> DataFrame:
    """Coefficients (intercept first) per store."""
    store_type = moments.schema[store].dataType.simpleString()

    def solve(batches):
        for pdf in batches:
            coefs = [solve_centred(np.asarray(m, float), np.asarray(c, float)).tolist() for m, c in zip(pdf["means"], pdf["moments"])]
            yield pd.DataFrame({store: pdf[store], "n": pdf["n"], "coef": coefs})

    return moments.mapInPandas(solve, f"{store} {store_type}, n long, coef array<double>")


def fit_per_store(df: DataFrame, features: Sequence[str], target: str, store: str = "Store") -> DataFrame:
    return solve_moments(store_moments(df, features, target, store), store)


def predict_expr(features: Sequence[str], coef: str = "coef") -> Column:
    expr = F.col(coef)[0]
    for i, f in enumerate(features, start=1):
        expr = expr + F.col(coef)[i] * F.col(f)
    return expr


def score_per_store(df: DataFrame, models: DataFrame, features: Sequence[str], store: str = "Store",
                    name: str = "pred") -> DataFrame:
    """Join each row to its store's coefficients (by key, never by position)."""
    return df.join(models.select(store, "coef"), store, "left").withColumn(
        name, predict_expr(features)).drop("coef")


def fit_one_feature(df: DataFrame, x: str, y: str, store: str = "Store") -> DataFrame:
    """Closed form for one regressor: slope and intercept per store.

    A store whose regressor never varies has no slope: both are NULL.
    """
    has_var = F.regr_sxx(F.col(y), F.col(x)) > 0
    return df.groupBy(store).agg(F.when(has_var, F.regr_slope(F.col(y), F.col(x))).alias("slope"),
                                 F.when(has_var, F.regr_intercept(F.col(y), F.col(x))).alias("intercept"),
                                 F.regr_count(F.col(y), F.col(x)).alias("n"))
