"""Sorts, limits and rankings (SO*).

Rankings number a range-partitioned sequence (sequence.py), so no task holds
the whole table.  Top-n uses ``orderBy().limit()`` which Spark plans as TakeOrderedAndProject
(per-task top-n, then a merge), never a full global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import numbered


def sort_panel(df: DataFrame, keys: Sequence[str] = ("Store", "Date")) -> DataFrame:
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def top_n(df: DataFrame, metric: str, n: int, ascending: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    o = F.col(metric).asc() if ascending else F.col(metric).desc()
    return df.orderBy(o, *tie).limit(n)


def arg_min_rows(df: DataFrame, metric: str) -> DataFrame:
    """All rows where the metric equals its minimum (ties kept)."""
    return df.filter(F.col(metric) == df.select(F.min(metric)).scalar())


def ranked(df: DataFrame, metric: str, name: str = "rank", tie: str | None = None) -> DataFrame:
    """Rank from 1 by descending metric."""
    order = [F.col(metric).desc()] + ([F.col(tie)] if tie else [])
    return numbered(df, *order, name=name).withColumn(name, F.col(name) + 1)


def strided_subset(ranked_df: DataFrame, rank: str = "rank", keep_top: int = 2, step: int = 4,
                   start: int = 3) -> DataFrame:
    """Ranks 1..keep_top plus every ``step``-th rank from ``start``."""
    r = F.col(rank)
    cond = (r <= keep_top) | ((r >= start) & ((r - start) % step == 0))
    return ranked_df.filter(cond)


def ordered_unique(df: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """First occurrence of each name, kept in list order."""
    return df.groupBy(name).agg(F.min(pos).alias(pos)).orderBy(pos)
