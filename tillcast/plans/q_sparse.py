"""Registered queries on panels whose size grows with the data.

The dense nation-by-day panel keeps a fixed row count at every scale; these
run the same operators on the per-customer order panel (P2, order key as
tie-break), a (supplier, ship day) panel from lineitem and the per-user
event panel (P3), so their work and output scale with the input.

A customer or supplier history is not bounded by the calendar (one may hold
a third of all rows), so window features here use the blocked path: exact,
and no group ever larger than one block plus its halos.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import metrics as M
from ..operators import stats, windows
from ..sources import panels
from ..sources.panels import P2_SQL, P3_SQL, sql_with
from ..sources.tables import read
from . import ols
from .forecast import fit_group_mean

_W2 = "OVER (PARTITION BY Store ORDER BY Date, Seq)"
_ORDER2 = ["Date", "Seq"]


@register("wn6_promo_flags_sparse", sql_with(P2_SQL) + f""",
pf AS (SELECT Store, Seq, Promo, CASE WHEN Promo = 1 AND lag(Promo, 1) {_W2} = 0 THEN 1 ELSE 0 END AS PromoFirstDate,
              Date FROM p2)
SELECT Store, Seq, PromoFirstDate,
       CASE WHEN Promo = 1 AND lag(PromoFirstDate, 1) {_W2} = 1 THEN 1 ELSE 0 END AS PromoSecondDate FROM pf""")
def wn6s(spark, sf):
    p = panels.p2_sparse(spark, sf).select("Store", "Date", "Seq", "Promo")
    return windows.promo_flags(p, order=_ORDER2, blocked=True).select("Store", "Seq", "PromoFirstDate", "PromoSecondDate")


def _refurb_sparse_sql():
    before = " AND ".join(f"lead(Open, {k}) {_W2} = 0" for k in range(1, 6))
    after = " AND ".join(f"lag(Open, {k}) {_W2} = 0" for k in range(1, 6))
    db = "CASE " + " ".join(f"WHEN lead(DayBeforeRefurb, {k}) {_W2} = 1 THEN {k + 1}" for k in range(14, 0, -1)) \
        + " WHEN DayBeforeRefurb = 1 THEN 1 ELSE 0 END"
    da = "CASE " + " ".join(f"WHEN lag(DayAfterRefurb, {k}) {_W2} = 1 THEN {k + 1}" for k in range(14, 0, -1)) \
        + " WHEN DayAfterRefurb = 1 THEN 1 ELSE 0 END"
    return sql_with(P2_SQL) + f""",
rf AS (SELECT Store, Date, Seq, CASE WHEN Open = 1 AND {before} THEN 1 ELSE 0 END AS DayBeforeRefurb,
              CASE WHEN Open = 1 AND {after} THEN 1 ELSE 0 END AS DayAfterRefurb FROM p2)
SELECT Store, Seq, DayBeforeRefurb, DayAfterRefurb, CAST({db} AS INTEGER) AS DaysBeforeRefurb,
       CAST({da} AS INTEGER) AS DaysAfterRefurb FROM rf"""


@register("wn13_refurb_counters_sparse", _refurb_sparse_sql())
def wn13s(spark, sf):
    p = panels.p2_sparse(spark, sf).select("Store", "Date", "Seq", "Open")
    out = windows.refurb_features(p, order=_ORDER2, blocked=True)
    return out.select("Store", "Seq", "DayBeforeRefurb", "DayAfterRefurb", "DaysBeforeRefurb", "DaysAfterRefurb")


_LI_OFFS = [1, 2, 3, 7, 14, -1, -2, -3]
# the table repeats some (order, line) pairs: part and quantity tell such rows apart
_WL = "OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, l_partkey, l_quantity)"


@register("wn3_lag_bank_lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    (f"lag(l_quantity, {k}) {_WL}" if k > 0 else f"lead(l_quantity, {-k}) {_WL}") + f" AS {windows.lag_name('l_quantity', k)}"
    for k in _LI_OFFS) + " FROM lineitem")
def wn3l(spark, sf):
    li = read(spark, sf, "lineitem", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    p = li.withColumn("Date", F.to_date("l_shipdate"))
    out = windows.shift_cols(p, ["l_quantity"], _LI_OFFS, store="l_suppkey", order=["Date", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], blocked=True)
    return out.drop("l_suppkey", "l_shipdate", "Date", "l_partkey", "l_quantity")


@register("ag3_mean_customer_promo_weekday_sparse", sql_with(P2_SQL) + """
SELECT Store, Promo, CAST(isodow(Date) AS INTEGER) AS DayOfWeek, round(sum(Sales), 2) / count(Sales) AS Sales_day_avg
FROM p2 GROUP BY ALL""")
def ag3s(spark, sf):
    p = panels.p2_sparse(spark, sf).withColumn("DayOfWeek", F.extract(F.lit("DAYOFWEEK_ISO"), F.col("Date")).cast("int"))
    return stats.group_mean(p, ["Store", "Promo", "DayOfWeek"], "Sales", "Sales_day_avg")


@register("ml11_per_customer_ols_one_feature_sparse", sql_with(P2_SQL) + """
SELECT Store, CASE WHEN regr_sxx(ln(Sales), CAST(isodow(Date) AS DOUBLE)) > 0 THEN round(regr_slope(ln(Sales), CAST(isodow(Date) AS DOUBLE)), 6) END AS slope,
       CAST(count(*) AS BIGINT) AS n FROM p2 WHERE Sales > 0 GROUP BY Store""")
def ml11s(spark, sf):
    p = (panels.p2_sparse(spark, sf).filter(F.col("Sales") > 0)
         .select("Store", F.ln("Sales").alias("y"), F.extract(F.lit("DAYOFWEEK_ISO"), F.col("Date")).cast("double").alias("x")))
    m = ols.fit_one_feature(p, "x", "y")
    return m.select("Store", F.round("slope", 6).alias("slope"), F.col("n").cast("long").alias("n"))


@register("ag12_rmspe_events_holdout", sql_with(P3_SQL) + """,
e AS (SELECT *, CAST(isodow(Date) AS INTEGER) AS dow FROM p3 WHERE Sales > 0),
m AS (SELECT Store, dow, round(sum(Sales), 2) / count(Sales) AS p FROM e WHERE Date < DATE '2024-01-21' GROUP BY ALL),
h AS (SELECT e.Sales, m.p FROM e JOIN m USING (Store, dow) WHERE e.Date >= DATE '2024-01-21')
SELECT round(sqrt(avg(power((p - Sales) / Sales, 2))), 6) AS rmspe, CAST(count(*) AS BIGINT) AS n FROM h""")
def ag12e(spark, sf):
    e = panels.p3_events(spark, sf).filter(F.col("Sales") > 0).withColumn(
        "dow", F.extract(F.lit("DAYOFWEEK_ISO"), F.col("Date")).cast("int"))
    cut = F.lit("2024-01-21").cast("date")
    m = fit_group_mean(e.filter(F.col("Date") < cut), ["Store", "dow"], "Sales", "p")
    h = e.filter(F.col("Date") >= cut).join(m, ["Store", "dow"])
    return h.agg(F.round(M.rmspe("p", "Sales"), 6).alias("rmspe"), F.count(F.lit(1)).cast("long").alias("n"))
