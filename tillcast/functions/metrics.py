"""Error metrics as aggregate expressions (one pass, partial aggregation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import inverse_square_weight


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_mean(c, decimals: int = 2) -> Column:
    """Mean of values carrying ``decimals`` decimals (money).

    The sum is taken in decimals (28 digits a value, 38 in all), where order
    does not matter, before one IEEE division: the same value on every
    partitioning, rerun and engine, for totals of any size.
    """
    return F.try_divide(exact_sum(c, decimals), F.count(_c(c)))


def exact_sum(c, decimals: int = 2) -> Column:
    """Sum of values carrying ``decimals`` decimals, independent of their order."""
    return F.sum(_c(c).cast(f"decimal(28,{decimals})")).cast("double")


def sq_rel_error(pred, target) -> Column:
    """((p - t) / t)^2; NULL where t is 0 or NULL (ANSI-safe)."""
    return F.pow(F.try_divide(_c(pred) - _c(target), _c(target)), 2)


def rmspe(pred, target, where: Column | None = None) -> Column:
    """sqrt(mean squared relative error) over rows with a non-zero target."""
    e = sq_rel_error(pred, target)
    if where is not None:
        e = F.when(where, e)
    return F.sqrt(F.avg(e))


def weighted_rmspe(pred, target) -> Column:
    """Zero targets count with weight 0 but stay in the denominator."""
    w = inverse_square_weight(target)
    return F.sqrt(F.avg(w * F.pow(_c(target) - _c(pred), 2)))


def log_space_rmspe(log_pred, log_target) -> Column:
    return weighted_rmspe(F.expm1(_c(log_pred)), F.expm1(_c(log_target)))


def mse(pred, target) -> Column:
    return F.avg(F.pow(_c(pred) - _c(target), 2))


def r2(pred, target) -> Column:
    return 1 - F.sum(F.pow(_c(target) - _c(pred), 2)) / (
        F.count(_c(target)) * F.var_pop(_c(target)))


def log_loss(p_true) -> Column:
    """Mean negative log-likelihood of the probability given to the true class."""
    eps = 1e-15
    return F.avg(-F.ln(F.least(F.greatest(_c(p_true), F.lit(eps)), F.lit(1 - eps))))
