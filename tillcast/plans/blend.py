"""Blends of several forecasts and the blend-weight grid search (ML17, ML19).

The reference rescans every row for every weight vector.  With relative
errors r_i = p_i / t - 1 and weights summing to 1,
RMSPE(w)^2 = sum_ij w_i w_j avg(r_i r_j): one aggregation produces the
n x n Gram matrix, after which every grid point costs O(n^2) arithmetic on a
one-row table.  The grid is generated by ``explode(sequence(...))`` on that
row (no join at all).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_blend(preds: Sequence[str], weights: Sequence[float]) -> Column:
    total = float(sum(weights))
    return sum(F.col(p) * float(w) for p, w in zip(preds, weights)) / total


def gram_matrix(df: DataFrame, preds: Sequence[str], target: str) -> DataFrame:
    """One row: G_i_j = avg(r_i * r_j) over rows with a non-zero target."""
    rows = df.filter(F.col(target) != 0).dropna(subset=list(preds))
    r = {p: F.col(p) / F.col(target) - 1 for p in preds}
    cells = [F.avg(r[a] * r[b]).alias(f"G_{i}_{j}") for i, a in enumerate(preds) for j, b in enumerate(preds)]
    return rows.agg(*cells, F.count(F.lit(1)).alias("n"))


def grid_search(df: DataFrame, sides: Sequence[str], main: str, target: str, max_weight: int = 10) -> DataFrame:
    """Affine grid of the reference: side weights (i_k - M/2)/M with nested
    bounds sum(i_k) <= M, main weight (1 + n_sides/2) - sum(i_k)/M.

    Returns one row per grid point with its weights and RMSPE.
    """
    preds = list(sides) + [main]
    m = float(max_weight)
    cur = gram_matrix(df, preds, target)
    used = F.lit(0)
    idx = []
    for k, _ in enumerate(sides):
        name = f"i{k}"
        cur = cur.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(max_weight) - used)))
        used = used + F.col(name)
        idx.append(name)
    w = [(F.col(i) - m / 2) / m for i in idx]
    w.append((F.lit((1 + len(sides) / 2) * m) - sum(F.col(i) for i in idx)) / m)
    return _scored(cur, preds, w)


def signed_grid_search(df: DataFrame, sides: Sequence[str], main: str, target: str, max_weight: int = 6) -> DataFrame:
    """Grid of whole weights from -max_weight to max_weight that sum to 1."""
    preds = list(sides) + [main]
    cur = gram_matrix(df, preds, target)
    used, idx = F.lit(0), []
    for k, _ in enumerate(sides):
        cur = cur.withColumn(f"i{k}", F.explode(F.sequence(F.lit(-max_weight), F.lit(max_weight))))
        used = used + F.col(f"i{k}")
        idx.append(F.col(f"i{k}"))
    cur = cur.filter(F.abs(1 - used) <= max_weight)
    return _scored(cur, preds, [*idx, 1 - used])


def _scored(cur: DataFrame, preds: Sequence[str], w: Sequence[Column]) -> DataFrame:
    """Weights and RMSPE of each grid row from its Gram matrix columns."""
    n = len(preds)
    quad = sum(w[a] * w[b] * F.col(f"G_{a}_{b}") for a in range(n) for b in range(n))
    # rounding may leave a perfect blend just below zero
    return cur.select(*[wi.alias(f"w_{p}") for wi, p in zip(w, preds)],
                      F.sqrt(F.greatest(quad, F.lit(0.0))).alias("rmspe"))
