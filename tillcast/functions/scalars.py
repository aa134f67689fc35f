"""Scalar column expressions: target transforms, flags, code maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Competition-promo month lists and their codes 1..3 (0 = none).
PROMO_INTERVAL_CODES = {"Jan,Apr,Jul,Oct": 1, "Feb,May,Aug,Nov": 2, "Mar,Jun,Sept,Dec": 3}
# Letter codes mapped to ordinals.
LETTER_ORDINALS = {"a": 1, "b": 2, "c": 3, "d": 4}
# Distance bucket edges (right-closed).
DISTANCE_EDGES = (0, 1500, 6000, 12000, 20000)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log1p_target(c) -> Column:
    """log(1 + y); y <= -1 gives NULL rather than -inf."""
    return F.when(_c(c) > -1, F.log1p(_c(c)))


def expm1_target(c) -> Column:
    return F.expm1(_c(c))


def log_target(c) -> Column:
    return F.when(_c(c) > 0, F.ln(_c(c)))


def clamp_at_zero(c) -> Column:
    return F.greatest(_c(c), F.lit(0.0))


def closed_flag(open_col="Open") -> Column:
    return F.abs(1 - _c(open_col))


def open_on_sunday(open_col="Open", dow_col="DayOfWeek") -> Column:
    return F.when((_c(open_col) == 1) & (_c(dow_col) == 7), 1).otherwise(0)


def inverse_square_weight(y) -> Column:
    return F.when(_c(y) != 0, 1.0 / (_c(y) * _c(y))).otherwise(0.0)


def code_map(c, mapping: Mapping, default=None) -> Column:
    """Literal map lookup as a CASE chain (stays in codegen)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(_c(c) == k, v) if expr is None else expr.when(_c(c) == k, v)
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default) if default is not None else F.lit(None))


def letter_ordinal(c) -> Column:
    return code_map(c, LETTER_ORDINALS)


def promo_interval_code(c) -> Column:
    return code_map(c, PROMO_INTERVAL_CODES, 0)


def standard_holiday(c) -> Column:
    """Codes arrive as 0 / '0' / missing: one string code, '0' for none."""
    return F.coalesce(_c(c).cast("string"), F.lit("0"))


def remap_state(c, compound: str, file_key: str) -> Column:
    return F.when(_c(c) == compound, file_key).otherwise(_c(c))


def competition_score(dist, max_dist, months_open) -> Column:
    """sqrt(max distance - distance) * months since the competitor opened."""
    return F.sqrt(_c(max_dist) - _c(dist)) * _c(months_open)


def label_from_last_char(c) -> Column:
    return F.right(_c(c), F.lit(1)).try_cast("double")


def bucketize(c, edges=DISTANCE_EDGES) -> Column:
    """Right-closed buckets: (e0, e1] -> 1, ...; <= e0 -> 0, > last -> len(edges)."""
    expr = F.when(_c(c) <= edges[0], 0)
    for i, hi in enumerate(edges[1:], start=1):
        expr = expr.when(_c(c) <= hi, i)
    return expr.when(_c(c).isNotNull(), len(edges))
