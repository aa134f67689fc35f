"""Projection, filter and cleaning operators (PF*, CL*)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def all_but(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Feature list: every column not excluded, in table order."""
    ex = set(excluded)
    return [c for c in df.columns if c not in ex]


def select_positions(df: DataFrame, keep: Sequence[int] = (), drop: Sequence[int] = ()) -> DataFrame:
    """Positional select/drop resolved to names (1-based, like R)."""
    cols = df.columns
    if keep:
        return df.select(*[cols[i - 1] for i in keep])
    gone = {cols[i - 1] for i in drop}
    return df.select(*[c for c in cols if c not in gone])


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    rx = re.compile(pattern)
    return df.select(*[c for c in df.columns if rx.search(c)])


def add_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def align_columns(df: DataFrame, reference_columns: Sequence[str], fill=0) -> DataFrame:
    """Add columns present in training but absent here as constants, one projection."""
    have = set(df.columns)
    missing = [F.lit(fill).alias(c) for c in reference_columns if c not in have]
    return df.select("*", *missing)


def set_where(df: DataFrame, cond: Column, col: str, value) -> DataFrame:
    return df.withColumn(col, F.when(cond, F.lit(value)).otherwise(F.col(col)))


def drop_zero_target(df: DataFrame, target: str = "Sales") -> DataFrame:
    """Keep rows with target > 0 (drops 0 and NULL)."""
    return df.filter(F.col(target) > 0)


def drop_closed(df: DataFrame, open_col: str = "Open") -> DataFrame:
    return df.filter(F.col(open_col) != 0)


def any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def rows_with_null(df: DataFrame) -> DataFrame:
    return df.filter(any_null(df.columns))


def fill_open(df: DataFrame, value: int = 1, col: str = "Open") -> DataFrame:
    return df.fillna({col: value})


def fill_numeric(df: DataFrame, value) -> DataFrame:
    """Fill every numeric column (strings untouched)."""
    return df.fillna(value, subset=numeric_columns(df))


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(defaults))


def fill_with_means(df: DataFrame, cols: Sequence[str], decimals: int | None = None) -> DataFrame:
    """Replace NULL with the column mean (scalar subqueries, merged into one scan)."""
    from ..functions.metrics import exact_mean

    def mean(c):
        return F.avg(c) if decimals is None else exact_mean(c, decimals)
    return df.select(*[F.coalesce(F.col(c), df.select(mean(c)).scalar()).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def open_rule_sales(df: DataFrame, open_col: str = "Open", sales: str = "Sales") -> DataFrame:
    """Rule J: close days with zero sales (NULL sales untouched)."""
    return set_where(df, F.col(sales) == 0, open_col, 0)


def open_rule_sales_or_customers(df: DataFrame, open_col="Open", sales="Sales",
                                 customers="Customers") -> DataFrame:
    """Rule V: open days with zero sales or zero customers are closed."""
    cond = (F.col(open_col) == 1) & ((F.col(sales) == 0) | (F.col(customers) == 0))
    return set_where(df, cond, open_col, 0)


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: number of NULLs and an any-null flag (one pass, long output)."""
    agg = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = agg.unpivot([], df.columns, "column", "null_count")
    return long.select("column", F.col("null_count").cast("long").alias("null_count"),
                       (F.col("null_count") > 0).cast("int").alias("has_null"))
