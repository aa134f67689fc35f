"""Set operations and reshaping (SE*, RS*)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import numbered


def union_all(frames: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """Union by name; columns missing from a frame become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def union_levels(frames: Sequence[DataFrame], col: str) -> DataFrame:
    """Distinct levels of a column across frames (no NULL level)."""
    return union_all([f.select(col) for f in frames]).filter(F.col(col).isNotNull()).distinct()


def one_hot(df: DataFrame, col: str, levels: Sequence, prefix: str | None = None,
            drop_first: bool = True) -> DataFrame:
    """Indicator columns ``{prefix}_{level}``; the first of ``levels`` is dropped.

    The levels name the output's columns, so the caller states them.
    """
    prefix = prefix or col
    keep = list(levels)[1:] if drop_first else list(levels)
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in keep])


def joint_label_codes(frames: Sequence[DataFrame], col: str, code: str | None = None) -> DataFrame:
    """Level -> 1-based code, ordered by level value, fitted on all frames."""
    code = code or f"{col}_code"
    return numbered(union_levels(frames, col), col, name=code).withColumn(code, F.col(code) + 1)


def apply_label_codes(df: DataFrame, codes: DataFrame, col: str) -> DataFrame:
    return df.join(codes, col, "left")


def unpivot_years(df: DataFrame, id_cols: Sequence[str], year_cols: Sequence[str] | None = None) -> DataFrame:
    """Wide year columns ('1995 [YR1995]' style) to (ids, year, value); '..' -> NULL."""
    year_cols = list(year_cols or [c for c in df.columns if c not in set(id_cols)])
    long = df.unpivot(list(id_cols), year_cols, "year_label", "raw")
    return long.select(*id_cols, F.regexp_extract("year_label", r"(\d{4})", 1).cast("int").alias("year"),
                       F.when(F.col("raw").cast("string") == "..", None)
                        .otherwise(F.col("raw").cast("string")).try_cast("double").alias("value"))


def pivot_indicators(df: DataFrame, location: str, indicators: Sequence[str], time_col: str = "TIME",
                     key: str = "INDICATOR", value: str = "Value") -> DataFrame:
    """Long indicator file to one column per indicator, for one location."""
    return (df.filter(F.col("LOCATION") == location).groupBy(time_col)
              .pivot(key, list(indicators)).agg(F.first(value)))


def weekly_to_daily(df: DataFrame, start: str = "week_start", end: str = "week_end",
                    value_cols: Sequence[str] = ("value",)) -> DataFrame:
    """Each interval row becomes one row per day it covers."""
    return df.select(F.explode(F.sequence(start, end)).alias("Date"), *value_cols)


def parse_week_range(text: Column) -> tuple[Column, Column]:
    """'2012-12-30 - 2013-01-05' -> (start, end) dates."""
    parts = F.split(text, " - ")
    return parts.getItem(0).try_cast("date"), parts.getItem(1).try_cast("date")


def standardise(df: DataFrame, col: str, name: str | None = None, sample: bool = True,
                fit_on: DataFrame | None = None) -> DataFrame:
    src = fit_on if fit_on is not None else df
    sd = F.stddev_samp(col) if sample else F.stddev_pop(col)
    mean_v = src.select(F.avg(col)).scalar()
    sd_v = src.select(sd).scalar()
    return df.withColumn(name or f"{col}_std", (F.col(col) - mean_v) / sd_v)


def min_max_scale(df: DataFrame, col: str, name: str | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    src = fit_on if fit_on is not None else df
    lo = src.select(F.min(col)).scalar()
    hi = src.select(F.max(col)).scalar()
    return df.withColumn(name or f"{col}_norm", (F.col(col) - lo) / (hi - lo))
