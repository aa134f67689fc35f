"""Aggregations (AG*): group means, profiles, summaries, metric tables.

All are ``groupBy().agg()`` plans: partial aggregation runs map-side, so a
key holding a third of the rows still reaches the shuffle as one partial row
per task.  Whole-table statistics are single-row aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..session import cut_lineage
from .clean import numeric_columns

# The three target means of the feature table and their keys.
TARGET_MEANS = (
    (("Store", "Promo"), "Sales_all_avg"),
    (("Store", "Promo", "month"), "Sales_month_avg"),
    (("Store", "Promo", "DayOfWeek"), "Sales_day_avg"),
)


def group_mean(df: DataFrame, keys: Sequence[str], target: str = "Sales", name: str | None = None,
               decimals: int | None = 2) -> DataFrame:
    """Mean target per key; NULL keys are dropped like a pandas group-by.

    ``decimals``: precision of the target (money: 2) for an order-independent
    mean; ``None`` for a plain ``avg``.
    """
    name = name or f"{target}_avg"
    mean = F.avg(target) if decimals is None else M.exact_mean(target, decimals)
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(mean.alias(name))


def attach_target_means(df: DataFrame, fit_on: DataFrame | None = None, target: str = "Sales",
                        specs=TARGET_MEANS) -> DataFrame:
    """Add the target-mean columns; ``fit_on`` gives an honest (train-only) fit."""
    src = df if fit_on is None else fit_on
    out = df
    for keys, name in specs:
        out = out.join(group_mean(src, keys, target, name), list(keys), "left")
    return out


def mean_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or numeric_columns(df)) if c not in set(keys)]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


QUARTILES = (0.25, 0.5, 0.75)
# Sketch accuracy (relative rank error about 1 / accuracy).
QUANTILE_ACCURACY = 10000


def quantile_sketch(x: Column, probs: Sequence[float] = QUARTILES) -> Column:
    """Approximate quantiles as an array: a mergeable sketch, bounded memory for each group."""
    return F.percentile_approx(x, list(probs), QUANTILE_ACCURACY).cast("array<double>")


# Distinct values of one bracket that are counted one by one; a wider bracket is narrowed again.
BRACKET_VALUES = 200_000
GRID = 256  # parts that a pass cuts a bracket into
# Brackets (a few numbers each) that may be broadcast to the rows; beyond it rows are shuffled to them.
BROADCAST_BRACKETS = 100_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = QUARTILES,
                    accuracy: int = QUANTILE_ACCURACY, bracket_values: int = BRACKET_VALUES) -> DataFrame:
    """keys + q (array): quantiles by linear interpolation between neighbours in rank.

    No sort, no row numbers: a sketch gives each asked rank a bracket of values,
    a pass counts what lies below and inside, brackets with many distinct values
    are cut again, and what is left is counted by value.  Every pass is an
    aggregation with partial sums, so a value or group with any share of the rows
    spans all tasks; a bracket shrinks to about 1 / ``accuracy`` of a group at
    first and by about ``GRID`` / 4 in each further pass.  Sketches only place the
    brackets: counts decide, and a rank outside its bracket widens it.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    slack = 2 / accuracy
    asked = [F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]
    edges = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-slack, slack)})
    place = lambda p, d: edges.index(min(max(p + d, 0.0), 1.0))
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
                                     F.percentile_approx("__v", edges, accuracy).alias("__e"))
    lows = F.array(*[F.lit(place(p, -slack)) for p in probs])
    highs = F.array(*[F.lit(place(p, slack)) for p in probs])
    brackets = sketch.filter("__n > 0").select(*keys, "__n", "__min", "__max", "__e", F.explode(F.array(*asked)).alias("__a"))
    at = F.col("__a.p") * (F.col("__n") - 1)
    brackets = cut_lineage(brackets.select(
        *keys, F.col("__a.i").alias("__i"), F.floor(at).alias("__low_rank"), F.ceil(at).alias("__high_rank"),
        (at - F.floor(at)).alias("__part"), "__min", "__max", F.lit(float("inf")).alias("__before"),
        F.get("__e", F.get(lows, F.col("__a.i"))).alias("__lo"), F.get("__e", F.get(highs, F.col("__a.i"))).alias("__hi")))
    held = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    # few groups: rows stay where they are, a shuffle by group would sort each group in one task
    small = F.broadcast if brackets.count() <= BROADCAST_BRACKETS else lambda b: b
    while True:
        met = _met(rows, small(brackets), keys)
        grid = F.percentile_approx(F.when(held, F.col("__v")), [i / GRID for i in range(GRID + 1)], max(accuracy, 16 * GRID))
        counts = met.groupBy(*keys, "__i").agg(F.count_if(F.col("__v") < F.col("__lo")).alias("__below"), F.count_if(held).alias("__in"),
                                               F.approx_count_distinct(F.when(held, F.col("__v"))).alias("__values"), grid.alias("__g"))
        state = cut_lineage(_by_key(brackets, counts, [*keys, "__i"]))
        missed = (F.col("__low_rank") < F.col("__below")) | (F.col("__high_rank") >= F.col("__below") + F.col("__in"))
        # a cut that hardly helped (a value that fills the bracket) is the last one
        wide = (F.col("__values") > bracket_values) & (F.col("__values") < 0.7 * F.col("__before"))
        missing, widest = state.agg(F.count_if(missed), F.count_if(wide & ~missed)).first()
        if not missing and not widest:
            break
        spot = lambda rank: (F.col(rank) - F.col("__below")) * GRID / F.greatest(F.col("__in"), F.lit(1))
        first = F.greatest(F.floor(spot("__low_rank")).cast("int") - 1, F.lit(0))
        last = F.least(F.ceil(spot("__high_rank")).cast("int") + 1, F.lit(GRID))
        lo = F.when(missed, F.col("__min")).when(wide, F.get("__g", first)).otherwise(F.col("__lo"))
        hi = F.when(missed, F.col("__max")).when(wide, F.get("__g", last)).otherwise(F.col("__hi"))
        before = F.when(missed, float("inf")).when(wide, F.col("__values").cast("double")).otherwise(F.col("__before"))
        brackets = cut_lineage(state.withColumns({"__lo": lo, "__hi": hi, "__before": before}).select(*brackets.columns))
    inside = _met(rows, small(state.select(*keys, "__i", "__lo", "__hi")), keys).filter(held)
    values = inside.groupBy(*keys, "__i", "__v").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__i").orderBy("__v"))  # at most a bracket's values
    ranked = _by_key(values.withColumn("__upto", upto), small(state.select(*keys, "__i", "__below", "__low_rank", "__high_rank", "__part")),
                     [*keys, "__i"]).withColumn("__last", F.col("__below") + F.col("__upto") - 1)
    holds = lambda rank: F.col(rank).between(F.col("__last") - F.col("__c") + 1, F.col("__last"))
    low, high = F.max(F.when(holds("__low_rank"), F.col("__v"))), F.max(F.when(holds("__high_rank"), F.col("__v")))
    q = ranked.groupBy(*keys, "__i").agg((low + (high - low) * F.max("__part")).alias("__q"))
    return q.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__q"))),
                                            lambda s: s["__q"]).alias("q"))


def _by_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join where null keys meet; one set of key columns."""
    renamed = right.select(*[F.col(k).alias(f"__r{i}") if k in keys else F.col(k) for i, k in enumerate(right.columns)])
    at = {k: f"__r{i}" for i, k in enumerate(right.columns)}
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(at[k]))
    return left.join(renamed, same).drop(*[at[k] for k in keys])


def _met(rows: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the brackets of its group (a few rows a group)."""
    if keys:
        return _by_key(rows, brackets, keys)
    # one group: its few brackets ride along as one array
    one = brackets.agg(F.collect_list(F.struct(*brackets.columns)).alias("b"))
    return rows.withColumn("__b", F.explode(one.scalar())).select("__v", "__b.*")


def describe_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max per column; long form."""
    cols = list(cols or numeric_columns(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
    s = long.groupBy("column").agg(F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"),
                                   F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    s = s.join(exact_quantiles(long, ["column"], "v"), "column", "left")
    s = s.withColumns({"25%": F.get("q", F.lit(0)), "50%": F.get("q", F.lit(1)), "75%": F.get("q", F.lit(2))})
    return s.unpivot(["column"], ["count", "mean", "std", "min", "25%", "50%", "75%", "max"], "stat", "value")


def six_number_summary(df: DataFrame, value_cols: Sequence[str], group: str | None = None) -> DataFrame:
    """Min, Q1, median, mean, Q3, max and sd per series (series = unpivoted column)."""
    keys = ["series"] if group is None else [group, "series"]
    long = df.select(*keys[:-1], *[F.col(c).cast("double").alias(c) for c in value_cols]).unpivot(
        keys[:-1], list(value_cols), "series", "v")
    s = long.groupBy(*keys).agg(F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"),
                                F.stddev_samp("v").alias("sd"))
    s = s.join(exact_quantiles(long, keys, "v"), keys, "left")
    return s.select(*keys, "min", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), "mean",
                    F.get("q", F.lit(2)).alias("q3"), "max", "sd")


def distinct_values(df: DataFrame) -> DataFrame:
    """(column, value as text, n): the values of every column and how often each occurs."""
    return (df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def profile(df: DataFrame) -> DataFrame:
    """Shape, distinct count and any-null flag per column, from the table of values."""
    per = distinct_values(df).groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"),
        F.max(F.col("value").isNull().cast("int")).alias("has_null"))
    return per.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "column", "n_distinct", "has_null")


# Items that the heavy-hitter sketch of a profile tracks, and those it lists.
TRACKED, LISTED = 10_000, 100
LOG_SIZE = 14  # of the distinct-count sketch: relative error about 0.8 / sqrt(2 ** LOG_SIZE), 0.65 %


def profile_sketch(df: DataFrame, cols: Sequence[str] | None = None, listed: int = LISTED, tracked: int = TRACKED) -> DataFrame:
    """One row per column from one mergeable aggregation over all of them.

    column, n_rows, n_null, min, max (as text), n_distinct, exact, top (array of
    (value, n), most frequent first).  A task keeps a bounded sketch per
    column and sends that, whatever the number of rows or values.  A column of at
    most ``listed`` values has them all in ``top``, with their true counts, and
    ``exact`` is true: the counts add up to the column's rows.  Elsewhere
    ``n_distinct`` is an estimate with the error that ``LOG_SIZE`` states.
    """
    cols = list(cols or df.columns)
    text = {c: F.col(c).cast("string") for c in cols}
    parts = []
    for c in cols:
        top = F.call_function("approx_top_k", text[c], F.lit(listed), F.lit(tracked))
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"),
            F.min(F.col(c)).cast("string").alias("min"), F.max(F.col(c)).cast("string").alias("max"),
            F.hll_sketch_estimate(F.hll_sketch_agg(text[c], LOG_SIZE)).alias("estimate"),
            F.filter(top, lambda x: x["item"].isNotNull()).alias("top")))
    one = df.agg(F.array(*parts).alias("__p")).select(F.explode("__p").alias("p")).select("p.*")
    found = F.aggregate("top", F.lit(0).cast("bigint"), lambda a, x: a + x["count"])
    exact = found == F.col("n_rows") - F.col("n_null")
    return one.select(
        "column", "n_rows", "n_null", "min", "max",
        F.when(exact, F.size("top")).otherwise(F.coalesce("estimate", F.lit(0))).cast("bigint").alias("n_distinct"), exact.alias("exact"),
        F.transform("top", lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n"))).alias("top"))


def rmspe_table(df: DataFrame, pred: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(M.rmspe(pred, target).alias("rmspe"),
                               F.count_if(F.col(target) != 0).alias("n"))


def importance_table(df: DataFrame, name: str = "variable", value: str = "relative_importance") -> DataFrame:
    """relative, scaled = rel / max, percentage = rel / sum (scalar subqueries)."""
    mx = df.select(F.max(value)).scalar()
    tot = df.select(F.sum(value)).scalar()
    return df.select(name, value, (F.col(value) / mx).alias("scaled_importance"),
                     (F.col(value) / tot).alias("percentage"))
