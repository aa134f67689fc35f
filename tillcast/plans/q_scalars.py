"""Registered date, math and string scalar queries (DT*, MA*, ST*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import calendar as C
from ..functions import scalars as S
from ..operators import reshape
from ..sources import panels
from ..sources.panels import P1_SQL, STORE_SQL, sql_with
from ..sources.tables import read

_P1 = sql_with(P1_SQL)
_P1S = sql_with(P1_SQL, STORE_SQL)
# Calendar columns are computed for every order row, so their work grows with the table.
_CAL = "WITH cal AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS Date FROM orders)"


def _order_days(spark, sf):
    return read(spark, sf, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", F.to_date("o_orderdate").alias("Date"))


@register("dt1_split_date_text", _CAL + """
SELECT o_orderkey, Date, CAST(split_part(strftime(Date, '%Y-%m-%d'), '-', 1) AS INTEGER) AS year,
       CAST(split_part(strftime(Date, '%Y-%m-%d'), '-', 2) AS INTEGER) AS month,
       CAST(split_part(strftime(Date, '%Y-%m-%d'), '-', 3) AS INTEGER) AS day FROM cal""")
def dt1(spark, sf):
    txt = F.date_format("Date", "yyyy-MM-dd")
    return _order_days(spark, sf).select("o_orderkey", "Date", C.split_iso_text(txt, 0).alias("year"),
                                       C.split_iso_text(txt, 1).alias("month"), C.split_iso_text(txt, 2).alias("day"))


@register("dt2_text_to_date", """
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS parsed
FROM orders""")
def dt2(spark, sf):
    o = read(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    txt = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", C.parse_date(txt, "yyyy-MM-dd").alias("parsed"))


@register("dt3_day_of_year", _CAL + "\nSELECT o_orderkey, Date, CAST(dayofyear(Date) AS INTEGER) AS day_of_year FROM cal")
def dt3(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "Date", C.day_of_year("Date").alias("day_of_year"))


@register("dt4_quarter", _CAL + "\nSELECT o_orderkey, Date, CAST(quarter(Date) AS INTEGER) AS quarter FROM cal")
def dt4(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "Date", C.quarter("Date").alias("quarter"))


@register("dt5_month_start_end", _CAL + """
SELECT o_orderkey, Date, CAST(day(Date) = 1 AS INTEGER) AS is_month_start, CAST(Date = last_day(Date) AS INTEGER) AS is_month_end
FROM cal""")
def dt5(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "Date", C.is_month_start("Date").alias("is_month_start"),
                                       C.is_month_end("Date").alias("is_month_end"))


@register("dt6_quarter_start_end", _CAL + """
SELECT o_orderkey, Date, CAST(Date = date_trunc('quarter', Date) AS INTEGER) AS is_quarter_start,
       CAST(Date = CAST(date_trunc('quarter', Date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS INTEGER) AS is_quarter_end
FROM cal""")
def dt6(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "Date", C.is_quarter_start("Date").alias("is_quarter_start"),
                                       C.is_quarter_end("Date").alias("is_quarter_end"))


@register("dt7_week_number", _CAL + "\nSELECT o_orderkey, Date, CAST(ceil(dayofyear(Date) / 7.0) AS INTEGER) AS weeknum FROM cal")
def dt7(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "Date", C.week_number("Date").alias("weeknum"))


@register("dt8_iso_week", _CAL + "\nSELECT o_orderkey, Date, CAST(weekofyear(Date) AS INTEGER) AS week_of_year FROM cal")
def dt8(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "Date", C.iso_week("Date").alias("week_of_year"))


@register("dt9_formatted_parts", _CAL + """
SELECT o_orderkey, Date, CAST(strftime(Date, '%y') AS INTEGER) AS yy, CAST(strftime(Date, '%m') AS INTEGER) AS mm FROM cal""")
def dt9(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "Date", C.two_digit_year("Date").alias("yy"),
                                       C.two_digit_month("Date").alias("mm"))


@register("dt10_months_since_competition", _P1S + """
SELECT Store, Date, CAST((year(Date) - CompetitionOpenSinceYear) * 12 - (CompetitionOpenSinceMonth - month(Date)) AS INTEGER)
       AS competition_months FROM train JOIN store USING (Store)""")
def dt10(spark, sf):
    t = panels.p1_train(spark, sf).join(panels.store_table(spark, sf), "Store")
    return t.select("Store", "Date", C.months_since(F.year("Date"), F.month("Date"), F.col("CompetitionOpenSinceYear"),
                                                    F.col("CompetitionOpenSinceMonth")).cast("int")
                    .alias("competition_months"))


@register("dt11_day_of_year_parity", _CAL + "\nSELECT o_orderkey, Date, CAST(dayofyear(Date) % 2 AS INTEGER) AS parity FROM cal")
def dt11(spark, sf):
    return _order_days(spark, sf).select("o_orderkey", "Date", C.parity(C.day_of_year("Date")).alias("parity"))


@register("dt12_parse_release_formats", """
SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%m/%d/%Y %H:%M:%S'), '%m/%d/%Y %H:%M:%S') AS DATE) AS released,
       CAST(strptime(strftime(o_orderdate, '%Y-%m') || '-01', '%Y-%m-%d') AS DATE) AS month_start
FROM orders""")
def dt12(spark, sf):
    o = read(spark, sf, "orders", "o_orderkey", "o_orderdate")
    ts_txt = F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss")
    ym = F.date_format("o_orderdate", "yyyy-MM")
    return o.select("o_orderkey", C.parse_timestamp(ts_txt, "MM/dd/yyyy HH:mm:ss").cast("date").alias("released"),
                    C.parse_date(ym, "yyyy-MM").alias("month_start"))


# ------------------------------------------------------------------- math

@register("ma1_log1p_expm1", _P1 + """
SELECT Store, Date, round(ln(1 + Sales), 6) AS logSales, round(exp(ln(1 + Sales)) - 1, 2) AS back FROM train""")
def ma1(spark, sf):
    t = panels.p1_train(spark, sf)
    lg = S.log1p_target("Sales")
    return t.select("Store", "Date", F.round(lg, 6).alias("logSales"), F.round(S.expm1_target(lg), 2).alias("back"))


@register("ma2_log_exp", _P1 + """
SELECT Store, Date, round(ln(Sales), 6) AS lnSales, round(exp(ln(Sales)), 2) AS back FROM train WHERE Sales > 0""")
def ma2(spark, sf):
    t = panels.p1_train(spark, sf).filter(F.col("Sales") > 0)
    lg = S.log_target("Sales")
    return t.select("Store", "Date", F.round(lg, 6).alias("lnSales"), F.round(F.exp(lg), 2).alias("back"))


@register("ma3_math_functions", _P1 + """
SELECT Store, Date, round(sqrt(Sales), 6) AS sqrt_sales, abs(Sales - 100000) AS abs_dev,
       CAST(ceil(Sales / 1000) AS BIGINT) AS ceil_k, round(Sales / 1000, 1) AS round_k,
       power(CAST(Customers AS DOUBLE), 2) AS customers_sq, CAST(Customers % 3 AS INTEGER) AS customers_mod3
FROM train""")
def ma3(spark, sf):
    t = panels.p1_train(spark, sf)
    return t.select("Store", "Date", F.round(F.sqrt("Sales"), 6).alias("sqrt_sales"),
                    F.abs(F.col("Sales") - 100000).alias("abs_dev"), F.ceil(F.col("Sales") / 1000).cast("long").alias("ceil_k"),
                    F.round(F.col("Sales") / 1000, 1).alias("round_k"),
                    F.pow(F.col("Customers").cast("double"), 2).alias("customers_sq"),
                    (F.col("Customers") % 3).cast("int").alias("customers_mod3"))


@register("ma4_competition_score", _P1S + """,
j AS (SELECT t.Store, t.Date, s.CompetitionDistance AS dist,
             (year(t.Date) - s.CompetitionOpenSinceYear) * 12 - (s.CompetitionOpenSinceMonth - month(t.Date)) AS months
      FROM train t JOIN store s USING (Store))
SELECT Store, Date, round(sqrt((SELECT max(dist) FROM j) - dist) * months, 4) AS Competition FROM j""")
def ma4(spark, sf):
    t = panels.p1_train(spark, sf).join(panels.store_table(spark, sf), "Store")
    months = C.months_since(F.year("Date"), F.month("Date"), F.col("CompetitionOpenSinceYear"),
                            F.col("CompetitionOpenSinceMonth"))
    max_dist = t.select(F.max("CompetitionDistance")).scalar()
    return t.select("Store", "Date", F.round(S.competition_score(F.col("CompetitionDistance"), max_dist, months), 4)
                    .alias("Competition"))


@register("ma5_closed_indicator", _P1 + "\nSELECT Store, Date, abs(1 - Open) AS Closed FROM train")
def ma5(spark, sf):
    return panels.p1_train(spark, sf).select("Store", "Date", S.closed_flag("Open").alias("Closed"))


@register("ma6_open_on_sunday", _P1 + """
SELECT Store, Date, CASE WHEN Open = 1 AND DayOfWeek = 7 THEN 1 ELSE 0 END AS OpenSunday FROM train""")
def ma6(spark, sf):
    return panels.p1_train(spark, sf).select("Store", "Date", S.open_on_sunday().alias("OpenSunday"))


@register("ma7_inverse_square_weight", _P1 + """
SELECT Store, Date, CASE WHEN Sales <> 0 THEN 1.0 / (Sales * Sales) ELSE 0.0 END AS weight FROM train""")
def ma7(spark, sf):
    return panels.p1_train(spark, sf).select("Store", "Date", S.inverse_square_weight("Sales").alias("weight"))


# ----------------------------------------------------------------- strings

_ST = sql_with(STORE_SQL)


@register("st1_letter_ordinals", _ST + """
SELECT Store, CASE StoreType WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'd' THEN 4 END AS StoreType,
       CASE Assortment WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'd' THEN 4 END AS Assortment FROM store""")
def st1(spark, sf):
    s = panels.store_table(spark, sf)
    return s.select("Store", S.letter_ordinal("StoreType").alias("StoreType"),
                    S.letter_ordinal("Assortment").alias("Assortment"))


@register("st2_promo_interval_code", _ST + """
SELECT Store, CASE PromoInterval WHEN 'Jan,Apr,Jul,Oct' THEN 1 WHEN 'Feb,May,Aug,Nov' THEN 2
                                 WHEN 'Mar,Jun,Sept,Dec' THEN 3 ELSE 0 END AS PromoInterval FROM store""")
def st2(spark, sf):
    s = panels.store_table(spark, sf)
    return s.select("Store", S.promo_interval_code("PromoInterval").alias("PromoInterval"))


@register("st3_date_range_split", """
WITH w AS (SELECT CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS ws FROM orders),
t AS (SELECT DISTINCT strftime(ws, '%Y-%m-%d') || ' - ' || strftime(ws + 6, '%Y-%m-%d') AS week_range FROM w)
SELECT week_range, TRY_CAST(split_part(week_range, ' - ', 1) AS DATE) AS week_start,
       TRY_CAST(split_part(week_range, ' - ', 2) AS DATE) AS week_end FROM t""")
def st3(spark, sf):
    wk = panels.weekly_orders(spark, sf)
    txt = wk.select(F.concat(F.date_format("week_start", "yyyy-MM-dd"), F.lit(" - "),
                             F.date_format("week_end", "yyyy-MM-dd")).alias("week_range"))
    s, e = reshape.parse_week_range(F.col("week_range"))
    return txt.select("week_range", s.alias("week_start"), e.alias("week_end"))


@register("st4_label_from_last_char", """
SELECT c_custkey, TRY_CAST(right('Class_' || CAST(c_nationkey % 9 + 1 AS VARCHAR), 1) AS DOUBLE) AS label FROM customer""")
def st4(spark, sf):
    c = read(spark, sf, "customer", "c_custkey", "c_nationkey")
    txt = F.concat(F.lit("Class_"), (F.col("c_nationkey") % 9 + 1).cast("string"))
    return c.select("c_custkey", S.label_from_last_char(txt).alias("label"))
