"""Registered window-feature and ranking queries (WN*, SO*).

The oracles spell each rule the long way (explicit lag/lead chains and
"last assignment wins" ladders) so they check the framed formulations used
on the Spark side rather than restating them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import ranking, windows
from ..session import ensure_checkpoint_dir
from ..sources import panels, stored
from ..sources.panels import P1_SQL, P2_SQL, STORE_SQL, WEATHER_SQL, sql_with
from .q_joins import WEATHER_PANEL_SQL, weather_for_panel

_P1 = sql_with(P1_SQL)
_W = "OVER (PARTITION BY Store ORDER BY Date)"


def _shift_sql(col, offsets, w=_W):
    out = []
    for k in offsets:
        fn = f"lag({col}, {k})" if k > 0 else f"lead({col}, {-k})"
        out.append(f"{fn} {w} AS {windows.lag_name(col, k)}")
    return ", ".join(out)


@register("wn1_lag_sales", _P1 + f"\nSELECT Store, Date, Sales, {_shift_sql('Sales', [1, 2, 3])} FROM p1")
def wn1(spark, sf):
    p = panels.p1_dense(spark, sf).select("Store", "Date", "Sales")
    return windows.shift_cols(p, ["Sales"], [1, 2, 3])


@register("wn2_lead_sales", _P1 + f"\nSELECT Store, Date, Sales, {_shift_sql('Sales', [-1, -2, -3])} FROM p1")
def wn2(spark, sf):
    p = panels.p1_dense(spark, sf).select("Store", "Date", "Sales")
    return windows.shift_cols(p, ["Sales"], [-1, -2, -3])


_OPEN_BANK = list(range(1, 15)) + [-k for k in range(1, 15)]


@register("wn3_open_lag_lead_bank", _P1 + f"\nSELECT Store, Date, Open, {_shift_sql('Open', _OPEN_BANK)} FROM p1")
def wn3(spark, sf):
    p = panels.p1_dense(spark, sf).select("Store", "Date", "Open")
    return windows.shift_cols(p, ["Open"], _OPEN_BANK)


@register("wn3_lag_bank_bucketed", _P1 + f"\nSELECT Store, Date, Open, {_shift_sql('Open', _OPEN_BANK)} FROM p1")
def wn3_bucketed(spark, sf):
    """The same bank over a panel stored in buckets of its store: no exchange after the write."""
    name = f"tillcast_panel_{uuid.uuid4().hex}"
    p = panels.p1_dense(spark, sf).select("Store", "Date", "Open")
    stored.store_panel(p, name, 8, path=f"{ensure_checkpoint_dir(spark)}/{name}")
    return windows.shift_cols(stored.read_panel(spark, name), ["Open"], _OPEN_BANK)


_WEATHER_BANK = {"Mean_TemperatureC": list(range(1, 15)) + [-1, -2, -3],
                 "Events": list(range(1, 15)) + [-1, -2, -3]}


@register("wn4_weather_string_lags", sql_with(P1_SQL, STORE_SQL, WEATHER_SQL, WEATHER_PANEL_SQL)
          + "\nSELECT Store, Date, " + ", ".join(_shift_sql(c, o) for c, o in _WEATHER_BANK.items())
          + " FROM pw")
def wn4(spark, sf):
    p = weather_for_panel(spark, sf, panels.p1_dense(spark, sf).select("Store", "Date"))
    p = p.select("Store", "Date", *_WEATHER_BANK)
    out = p
    for c, offs in _WEATHER_BANK.items():
        out = windows.shift_cols(out, [c], offs)
    return out.drop(*_WEATHER_BANK)


_AIR_BANK = {c: list(range(1, 8)) + [-1, -2, -3] for c in ("Max_Wind_SpeedKm_h", "Precipitationmm")}


@register("wn3_wind_rain_banks", sql_with(P1_SQL, STORE_SQL, WEATHER_SQL, WEATHER_PANEL_SQL)
          + "\nSELECT Store, Date, " + ", ".join(_shift_sql(c, o) for c, o in _AIR_BANK.items()) + " FROM pw")
def wn3w(spark, sf):
    p = weather_for_panel(spark, sf, panels.p1_dense(spark, sf).select("Store", "Date"))
    return windows.shift_cols(p.select("Store", "Date", *_AIR_BANK), list(_AIR_BANK), list(range(1, 8)) + [-1, -2, -3]).drop(
        *_AIR_BANK)


_W2 = "OVER (PARTITION BY Store ORDER BY Date, Seq)"


@register("wn5_sparse_sales_lags", sql_with(P2_SQL)
          + f"\nSELECT Store, Seq, {_shift_sql('Sales', range(1, 22), _W2)} FROM p2")
def wn5(spark, sf):
    p = panels.p2_sparse(spark, sf).select("Store", "Date", "Seq", "Sales")
    return windows.shift_cols(p, ["Sales"], list(range(1, 22)), order=["Date", "Seq"], blocked=True).drop("Date", "Sales")


_PROMO_SQL = _P1 + f""",
pf AS (SELECT Store, Date, Promo,
              CASE WHEN Promo = 1 AND lag(Promo, 1) {_W} = 0 THEN 1 ELSE 0 END AS PromoFirstDate,
              CASE WHEN Promo = 1 AND lag(Promo, 2) {_W} = 0 THEN 1 ELSE 0 END AS PromoSecondDateOld FROM p1),
ps AS (SELECT *, CASE WHEN Promo = 1 AND lag(PromoFirstDate, 1) {_W} = 1 THEN 1 ELSE 0 END AS PromoSecondDate FROM pf)"""


def _promo(spark, sf):
    p = panels.p1_dense(spark, sf).select("Store", "Date", "Promo")
    return windows.promo_flags(p, older_second_rule=True)


@register("wn6_promo_first_day", _PROMO_SQL + "\nSELECT Store, Date, PromoFirstDate FROM ps")
def wn6(spark, sf):
    return _promo(spark, sf).select("Store", "Date", "PromoFirstDate")


@register("wn7_promo_second_day", _PROMO_SQL + "\nSELECT Store, Date, PromoSecondDate FROM ps")
def wn7(spark, sf):
    return _promo(spark, sf).select("Store", "Date", "PromoSecondDate")


@register("wn8_promo_second_day_older_rule", _PROMO_SQL + "\nSELECT Store, Date, PromoSecondDateOld FROM ps")
def wn8(spark, sf):
    return _promo(spark, sf).select("Store", "Date", "PromoSecondDateOld")


_CLOSED_SQL = _P1 + f""",
cn AS (SELECT Store, Date, CASE WHEN Open = 1 AND lead(Open, 1) {_W} = 0 THEN 1 ELSE 0 END AS DayBeforeClosed,
              CASE WHEN Open = 1 AND lag(Open, 1) {_W} = 0 THEN 1 ELSE 0 END AS DayAfterClosed FROM p1)"""


def _closed(spark, sf):
    return windows.closed_neighbours(panels.p1_dense(spark, sf).select("Store", "Date", "Open"))


@register("wn9_day_before_closed", _CLOSED_SQL + "\nSELECT Store, Date, DayBeforeClosed FROM cn")
def wn9(spark, sf):
    return _closed(spark, sf).select("Store", "Date", "DayBeforeClosed")


@register("wn10_day_after_closed", _CLOSED_SQL + "\nSELECT Store, Date, DayAfterClosed FROM cn")
def wn10(spark, sf):
    return _closed(spark, sf).select("Store", "Date", "DayAfterClosed")


def _refurb_sql():
    before = " AND ".join(f"lead(Open, {k}) {_W} = 0" for k in range(1, 6))
    after = " AND ".join(f"lag(Open, {k}) {_W} = 0" for k in range(1, 6))
    # last assignment wins in the reference: the farthest flag decides
    days_before = "CASE " + " ".join(
        f"WHEN lead(DayBeforeRefurb, {k}) {_W} = 1 THEN {k + 1}" for k in range(14, 0, -1)) + \
        " WHEN DayBeforeRefurb = 1 THEN 1 ELSE 0 END"
    days_after = "CASE " + " ".join(
        f"WHEN lag(DayAfterRefurb, {k}) {_W} = 1 THEN {k + 1}" for k in range(14, 0, -1)) + \
        " WHEN DayAfterRefurb = 1 THEN 1 ELSE 0 END"
    return _P1 + f""",
rf AS (SELECT Store, Date, Open, CASE WHEN Open = 1 AND {before} THEN 1 ELSE 0 END AS DayBeforeRefurb,
              CASE WHEN Open = 1 AND {after} THEN 1 ELSE 0 END AS DayAfterRefurb FROM p1),
rc AS (SELECT *, CAST({days_before} AS INTEGER) AS DaysBeforeRefurb, CAST({days_after} AS INTEGER) AS DaysAfterRefurb FROM rf)"""


_REFURB_SQL = _refurb_sql()


def _refurb(spark, sf):
    return windows.refurb_features(panels.p1_dense(spark, sf).select("Store", "Date", "Open"))


@register("wn11_day_before_refurb", _REFURB_SQL + "\nSELECT Store, Date, DayBeforeRefurb FROM rc")
def wn11(spark, sf):
    return _refurb(spark, sf).select("Store", "Date", "DayBeforeRefurb")


@register("wn12_day_after_refurb", _REFURB_SQL + "\nSELECT Store, Date, DayAfterRefurb FROM rc")
def wn12(spark, sf):
    return _refurb(spark, sf).select("Store", "Date", "DayAfterRefurb")


@register("wn13_countdown_before_refurb", _REFURB_SQL + "\nSELECT Store, Date, DaysBeforeRefurb FROM rc")
def wn13(spark, sf):
    return _refurb(spark, sf).select("Store", "Date", "DaysBeforeRefurb")


@register("wn14_countup_after_refurb", _REFURB_SQL + "\nSELECT Store, Date, DaysAfterRefurb FROM rc")
def wn14(spark, sf):
    return _refurb(spark, sf).select("Store", "Date", "DaysAfterRefurb")


@register("wn15_group_mean_window", _P1 + """
SELECT Store, Date, round(sum(Sales) OVER (PARTITION BY Store, Promo, DayOfWeek), 2)
       / count(Sales) OVER (PARTITION BY Store, Promo, DayOfWeek) AS Sales_day_avg FROM train""")
def wn15(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date", "Promo", "DayOfWeek", "Sales")
    return windows.group_mean_over(t, ["Store", "Promo", "DayOfWeek"], "Sales", "Sales_day_avg").select(
        "Store", "Date", "Sales_day_avg")


# ------------------------------------------------------------------ ranking

@register("so1_sort_store_date", _P1 + "\nSELECT Id, Store, Date FROM test ORDER BY Store, Date NULLS LAST")
def so1(spark, sf):
    return ranking.sort_panel(panels.p1_test(spark, sf).select("Id", "Store", "Date"))


@register("so2_sort_by_id", _P1 + "\nSELECT Id, Open FROM test ORDER BY Id")
def so2(spark, sf):
    return panels.p1_test(spark, sf).select("Id", "Open").orderBy("Id")


_BRAND_SQL = """
WITH br AS (SELECT p.p_brand AS variable, round(sum(l.l_extendedprice), 2) AS relative_importance
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY relative_importance DESC, variable) AS INTEGER) AS rank FROM br)"""


@register("so3_top_n_by_metric", _BRAND_SQL + "\nSELECT variable, relative_importance FROM rk WHERE rank <= 10")
def so3(spark, sf):
    return ranking.top_n(panels.brand_revenue(spark, sf), "relative_importance", 10, ascending=False,
                         tie=["variable"])


@register("so4_arg_min_rows", _BRAND_SQL + """
SELECT variable, relative_importance FROM br WHERE relative_importance = (SELECT min(relative_importance) FROM br)""")
def so4(spark, sf):
    return ranking.arg_min_rows(panels.brand_revenue(spark, sf), "relative_importance")


@register("so5_top_features", _BRAND_SQL + "\nSELECT variable, rank FROM rk WHERE rank <= 5")
def so5(spark, sf):
    top = ranking.top_n(panels.brand_revenue(spark, sf), "relative_importance", 5, ascending=False, tie=["variable"])
    return ranking.ranked(top, "relative_importance", tie="variable").select(
        "variable", F.col("rank").cast("int").alias("rank"))


@register("so6_strided_feature_subset", _BRAND_SQL + """
SELECT variable, rank FROM rk WHERE rank <= 2 OR (rank >= 3 AND (rank - 3) % 4 = 0)""")
def so6(spark, sf):
    r = ranking.ranked(panels.brand_revenue(spark, sf), "relative_importance", tie="variable")
    return ranking.strided_subset(r).select("variable", F.col("rank").cast("int").alias("rank"))


@register("so7_ordered_unique", """
SELECT p_brand AS name, min(p_partkey) AS pos FROM part GROUP BY p_brand""")
def so7(spark, sf):
    from ..sources.tables import read
    p = read(spark, sf, "part", "p_partkey", "p_brand").select(F.col("p_brand").alias("name"),
                                                                F.col("p_partkey").alias("pos"))
    return ranking.ordered_unique(p)
