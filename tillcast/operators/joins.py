"""Joins (JN*).

No join here carries a broadcast hint on a side whose size grows with the
data: dimension and aggregate sides are left to Catalyst/AQE, which broadcast
them only after measuring them (static statistics or the materialised
shuffle) below ``spark.sql.autoBroadcastJoinThreshold``; otherwise the join
is a shuffle join and AQE splits skewed partitions.  Scalars are attached as
scalar subqueries, never through a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .sequence import running


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str] | str, how: str = "inner") -> DataFrame:
    return left.join(right, [keys] if isinstance(keys, str) else list(keys), how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    common = [c for c in left.columns if c in set(right.columns)]
    if not common:
        raise ValueError("no shared columns")
    return left.join(right, common, how)


def scalar_of(df: DataFrame, agg: Column) -> Column:
    """A one-value aggregate usable as a column (planned as a scalar subquery)."""
    return df.select(agg).scalar()


def attach_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of an aggregate back to detail rows."""
    return df.join(stats, list(keys), "left")


def step_series_daily(series: DataFrame, date_col: str, value_cols: Sequence[str],
                      last_day: Column | None = None) -> DataFrame:
    """Turn an irregular (or monthly/annual) series into one row per day.

    Dates and timestamps count by day; of several observations on one day the
    latest one holds (at one time: the greatest values, in column order), and
    those without a date are dropped.  Each observation holds from its day
    until the day before the next one; the last one holds until ``last_day``
    (default: itself).  The series is reduced to one row per day first, so the
    ordering window spans at most the calendar length whatever the fact size.
    """
    latest = F.max(F.struct(F.col(date_col).alias("__at"), *value_cols)).alias("__v")
    days = (series.filter(F.col(date_col).isNotNull()).groupBy(F.to_date(date_col).alias("__from")).agg(latest)
            .select("__from", *[F.col("__v")[c].alias(c) for c in value_cols]))
    nxt = F.lead("__from").over(Window.orderBy("__from"))
    # the last observation holds until last_day (never before its own date:
    # sequence() would count backwards)
    tail = F.col("__from") if last_day is None else F.greatest(last_day, F.col("__from"))
    ranged = days.select("__from", F.coalesce(F.date_sub(nxt, 1), tail).alias("__to"), *value_cols)
    return ranged.select(F.explode(F.sequence("__from", "__to")).alias("Date"), *value_cols)


def asof_attach(df: DataFrame, series: DataFrame, date_col: str, value_cols: Sequence[str],
                on: str = "Date", last_day: Column | None = None) -> DataFrame:
    """Each row gets the latest observation dated on or before its day.

    The last observation is carried to ``last_day``, by default the last day
    of ``df``.  ``on`` may be a date or a timestamp.
    """
    if last_day is None:
        last_day = df.select(F.max(F.to_date(on))).scalar()
    daily = step_series_daily(series, date_col, value_cols, last_day).withColumnRenamed("Date", "__on")
    return df.withColumn("__on", F.to_date(on)).join(daily, "__on", "left").drop("__on")


def asof_by_key(facts: DataFrame, series: DataFrame, keys: Sequence[str], fact_at: str, series_at: str,
                value_cols: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Each fact gets the values of its key's latest observation at or before its own time, to full precision.

    Facts and observations are sorted together by key and time over all tasks,
    observations first at equal times, and the greatest (time, ``tie``, values)
    so far is carried along: inside a range of rows, and across ranges by one
    value a range.  A key with any share of either side spans many tasks, and
    nothing is expanded to days.  Facts without key or time, and those before
    the first observation, get nulls; observations without time are ignored.
    """
    kind = {f.name: f.dataType for f in series.schema.fields}
    seen = F.struct(F.col(series_at).alias("at"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)],
                    *[F.col(c).alias(f"v{i}") for i, c in enumerate(value_cols)])
    obs = series.filter(F.col(series_at).isNotNull()).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(series_at).alias("__at"), F.lit(0).alias("__side"),
        seen.alias("__seen"), F.lit(None).cast(facts.schema).alias("__fact"))
    rows = facts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(fact_at).alias("__at"), F.lit(1).alias("__side"),
        F.lit(None).cast(obs.schema["__seen"].dataType).alias("__seen"), F.struct(*facts.columns).alias("__fact"))
    both = obs.unionByName(rows)
    last = running(both, [f"__k{i}" for i in range(len(keys))], [F.col("__at").asc_nulls_first(), "__side", "__seen", F.xxhash64("__fact")],
                   {"__last": "__seen"}, F.max)
    found = last.filter("__side = 1")
    known = F.col("__at").isNotNull()
    for i in range(len(keys)):
        known &= F.col(f"__k{i}").isNotNull()
    return found.select(*[F.col("__fact")[c].alias(c) for c in facts.columns],
                        *[F.when(known, F.col("__last")[f"v{i}"]).cast(kind[c]).alias(c) for i, c in enumerate(value_cols)])


def blend_by_id(preds: Sequence[DataFrame], weights: Sequence[float], key: str = "Id",
                value: str = "Sales") -> DataFrame:
    """Weighted sum of several prediction tables aligned by key (not by position)."""
    total = float(sum(weights))
    named = [p.select(key, F.col(value).alias(f"__p{i}")) for i, p in enumerate(preds)]
    out = named[0]
    for p in named[1:]:
        out = out.join(p, key)
    expr = sum(F.col(f"__p{i}") * float(w) for i, w in enumerate(weights)) / total
    return out.select(key, expr.alias(value))
