"""Panel-aware window features (lags, leads, promo runs, closure runs).

Offsets are by row position inside a store, as in the reference, and never
cross stores.  Every feature is written against ``off(col, k)``, the
store-guarded value k rows back/ahead, so the same expressions run on two
physical layouts:

* plain (default): ``partitionBy(store).orderBy(order...)``.  All features of
  one call share the specification: one exchange on the store, one sort, one
  ``Window`` operator.  A group is one store's history; on a panel keyed by
  (store, day) that is bounded by the calendar length, not by the table.
* ``blocked=True``, for panels where one store may hold an unbounded share of
  the rows (customers, suppliers, users): the rows form one globally sorted
  (store, order) sequence, cut into fixed-size blocks with ``reach`` halo
  rows from each neighbour; groups are blocks, so no task ever holds more
  than ``block_rows + 2 * reach`` rows, and results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .sequence import numbered


def _order_cols(order: Sequence[str] | str) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def panel_window(store: str = "Store", order: Sequence[str] | str = "Date") -> WindowSpec:
    return Window.partitionBy(store).orderBy(*_order_cols(order))


def lag_name(col: str, k: int, style: str = "suffix") -> str:
    if style == "reference":
        return f"{col}{k}" if k > 0 else f"{col}-{-k}"
    return f"{col}_lag{k}" if k > 0 else f"{col}_lead{-k}"


Offset = Callable[[str, int], Column]


def with_panel_windows(df: DataFrame, build, store: str = "Store", order: Sequence[str] | str = "Date",
                       reach: int = 15, blocked: bool = False, block_rows: int = 4096) -> DataFrame:
    """Add the columns returned by ``build(window, off)``.

    ``off(col, k)`` is the store-guarded value of ``col`` k rows back (k > 0)
    or ahead (k < 0): NULL past the store's first/last row.  ``build`` may be
    a list of builders applied as successive passes (a later pass may read an
    earlier pass's columns); ``reach`` is then the sum of their reaches.
    """
    builds = list(build) if isinstance(build, (list, tuple)) else [build]
    order = _order_cols(order)
    if not blocked:
        w = panel_window(store, order)

        def off(col, k):  # the partition is the store: no guard needed
            return (F.lag(col, k) if k > 0 else F.lead(col, -k)).over(w)
        out = df
        for b in builds:
            out = out.select("*", *b(w, off))
        return out
    return _blocked(df, builds, store, order, reach, block_rows)


def _blocked(df, builds, store, order, reach, block_rows):
    """Exact windows over fixed-size blocks of the global (store, order) sequence.

    1. The rows get their global numbers in (store, order), see sequence.py: a
       hot store spans many tasks; no per-store numbering, no join keyed by
       store.
    2. Blocks of ``block_rows`` consecutive rows plus ``reach`` halo rows
       copied from each neighbouring block; every offset is store-guarded,
       so blocks may mix stores and a store may span many blocks.
    """
    if block_rows < 2 * reach:
        raise ValueError("block_rows must be at least twice the reach")
    seq = numbered(df, store, *order)
    blk = F.floor(F.col("__g") / block_rows)
    inner = F.col("__g") % block_rows

    def target(b, halo):
        return F.struct(b.alias("b"), F.lit(halo).alias("h"))
    # each row goes to its block, and rows near an edge also go to the
    # neighbouring block as halo: one projection, no union of re-scans
    targets = F.array(target(blk, False),
                      F.when(inner >= block_rows - reach, target(blk + 1, True)),
                      F.when(inner < reach, target(blk - 1, True)))
    out = (seq.select("*", F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("__t"))
              .select("*", F.col("__t.b").alias("__blk"), F.col("__t.h").alias("__halo")).drop("__t"))
    w = Window.partitionBy("__blk").orderBy("__g")

    def off(col, k):
        shift = (lambda c: F.lag(c, k)) if k > 0 else (lambda c: F.lead(c, -k))
        return F.when(shift(store).over(w) == F.col(store), shift(col).over(w))

    for b in builds:  # all passes over the same blocks: one numbering, one exchange
        out = out.select("*", *b(w, off))
    return out.filter(~F.col("__halo")).drop("__g", "__blk", "__halo")


# ---- expression builders: several features share one Window operator ----

def lag_exprs(off: Offset, cols: Sequence[str], offsets: Sequence[int], style: str = "suffix") -> list[Column]:
    return [off(c, k).alias(lag_name(c, k, style)) for c in cols for k in offsets]


def promo_exprs(off: Offset, promo: str = "Promo", older_second_rule: bool = False) -> list[Column]:
    p = F.col(promo)
    prev1, prev2 = off(promo, 1), off(promo, 2)
    first = F.when((p == 1) & (prev1 == 0), 1).otherwise(0)
    prev_first = F.when((prev1 == 1) & (prev2 == 0), 1).otherwise(0)
    second = F.when((p == 1) & (prev_first == 1), 1).otherwise(0)
    out = [first.alias("PromoFirstDate"), second.alias("PromoSecondDate")]
    if older_second_rule:
        out.append(F.when((p == 1) & (prev2 == 0), 1).otherwise(0).alias("PromoSecondDateOld"))
    return out


def closed_exprs(off: Offset, open_col: str = "Open") -> list[Column]:
    o = F.col(open_col)
    return [F.when((o == 1) & (off(open_col, -1) == 0), 1).otherwise(0).alias("DayBeforeClosed"),
            F.when((o == 1) & (off(open_col, 1) == 0), 1).otherwise(0).alias("DayAfterClosed")]


def refurb_flag_exprs(off: Offset, open_col: str = "Open", run: int = 5) -> list[Column]:
    """Open now and ``run`` closed rows of the same store ahead / behind
    (a missing row or a missing ``Open`` never matches)."""
    o = F.col(open_col)
    before, after = o == 1, o == 1
    for k in range(1, run + 1):
        before = before & (off(open_col, -k) == 0)
        after = after & (off(open_col, k) == 0)
    return [F.when(before, 1).otherwise(0).alias("DayBeforeRefurb"),
            F.when(after, 1).otherwise(0).alias("DayAfterRefurb")]


def refurb_counter_exprs(off: Offset, before_flag: str = "DayBeforeRefurb", after_flag: str = "DayAfterRefurb",
                         horizon: int = 15) -> list[Column]:
    """k+1 for the farthest flag within ``horizon`` rows (the last of the
    reference's overwriting assignments wins), else 0."""
    days_before = F.when(F.col(before_flag) == 1, 1).otherwise(0)
    days_after = F.when(F.col(after_flag) == 1, 1).otherwise(0)
    for k in range(1, horizon):  # nearer first; each farther hit overrides
        days_before = F.when(off(before_flag, -k) == 1, k + 1).otherwise(days_before)
        days_after = F.when(off(after_flag, k) == 1, k + 1).otherwise(days_after)
    return [days_before.cast("int").alias("DaysBeforeRefurb"), days_after.cast("int").alias("DaysAfterRefurb")]


# ---- operators ----

def shift_cols(df: DataFrame, cols: Sequence[str], offsets: Sequence[int], store: str = "Store",
               order: Sequence[str] | str = "Date", style: str = "suffix", **kw) -> DataFrame:
    """Lag (k > 0) / lead (k < 0) bank: one sort for all columns and offsets."""
    reach = max(abs(k) for k in offsets)
    return with_panel_windows(df, lambda _w, off: lag_exprs(off, cols, offsets, style), store, order,
                              reach=reach, **kw)


def promo_flags(df: DataFrame, promo: str = "Promo", store: str = "Store",
                order: Sequence[str] | str = "Date", older_second_rule: bool = False,
                **kw) -> DataFrame:
    """PromoFirstDate: promo now, not on the previous row of the same store.
    PromoSecondDate: promo now and the previous row was a first day.
    ``older_second_rule``: promo now and promo two rows back is 0."""
    return with_panel_windows(df, lambda _w, off: promo_exprs(off, promo, older_second_rule), store, order,
                              reach=2, **kw)


def closed_neighbours(df: DataFrame, open_col: str = "Open", store: str = "Store",
                      order: Sequence[str] | str = "Date", **kw) -> DataFrame:
    """DayBeforeClosed / DayAfterClosed: open now, closed on the next / previous row."""
    return with_panel_windows(df, lambda _w, off: closed_exprs(off, open_col), store, order, reach=1, **kw)


def refurb_flags(df: DataFrame, open_col: str = "Open", store: str = "Store",
                 order: Sequence[str] | str = "Date", run: int = 5, **kw) -> DataFrame:
    """DayBeforeRefurb: open, then ``run`` closed rows of the same store.
    DayAfterRefurb: ``run`` closed rows, then open."""
    return with_panel_windows(df, lambda _w, off: refurb_flag_exprs(off, open_col, run), store, order,
                              reach=run, **kw)


def refurb_counters(df: DataFrame, before_flag: str = "DayBeforeRefurb", after_flag: str = "DayAfterRefurb",
                    store: str = "Store", order: Sequence[str] | str = "Date", horizon: int = 15,
                    **kw) -> DataFrame:
    """DaysBeforeRefurb: k+1 for the farthest before-flag k rows ahead (k < horizon), else 0.
    DaysAfterRefurb: k+1 for the farthest after-flag k rows back (k < horizon), else 0."""
    return with_panel_windows(df, lambda _w, off: refurb_counter_exprs(off, before_flag, after_flag, horizon),
                              store, order, reach=horizon, **kw)


def refurb_features(df: DataFrame, open_col: str = "Open", store: str = "Store",
                    order: Sequence[str] | str = "Date", run: int = 5, horizon: int = 15,
                    **kw) -> DataFrame:
    """Refurbishment flags, then their countdown / count-up columns (two passes
    over one window / one blocking)."""
    passes = [lambda _w, off: refurb_flag_exprs(off, open_col, run),
              lambda _w, off: refurb_counter_exprs(off, horizon=horizon)]
    return with_panel_windows(df, passes, store, order, reach=run + horizon, **kw)


def group_means_over(df: DataFrame, specs, target: str = "Sales", fit: Column | None = None,
                     decimals: int = 2) -> DataFrame:
    """Several group means as analytic columns, fitted on rows where ``fit`` holds.

    ``specs``: ((keys...), name) pairs.  When every key set starts with the
    column the frame is already hash-partitioned on (``repartition(store)``),
    Spark adds only local sorts -- no exchange per key set.
    """
    y = F.col(target) if fit is None else F.when(fit, F.col(target))
    cols = []
    for keys, name in specs:
        w = Window.partitionBy(*keys)
        cols.append(F.try_divide(F.sum(y.cast(f"decimal(28,{decimals})")).over(w).cast("double"), F.count(y).over(w)).alias(name))
    return df.select("*", *cols)


def group_mean_over(df: DataFrame, keys: Sequence[str], target: str, name: str,
                    decimals: int | None = 2) -> DataFrame:
    """Group mean as an analytic column (same values as aggregate + join).

    Prefer aggregate + join on large facts: each distinct key set here costs
    its own exchange and sort.
    """
    w = Window.partitionBy(*keys)
    if decimals is None:
        return df.withColumn(name, F.avg(target).over(w))
    total = F.sum(F.col(target).cast(f"decimal(28,{decimals})")).over(w).cast("double")
    return df.withColumn(name, F.try_divide(total, F.count(target).over(w)))
