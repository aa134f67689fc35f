"""Registered reshaping queries (RS*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalars as S
from ..functions.metrics import exact_mean
from ..operators import reshape
from ..sources import panels
from ..sources.panels import P1_SQL, STORE_SQL, sql_with
from ..sources.tables import read

_ST = sql_with(STORE_SQL)


@register("rs1_one_hot_drop_first", _ST + """
SELECT Store, CAST(StoreType = 'b' AS INTEGER) AS StoreType_b, CAST(StoreType = 'c' AS INTEGER) AS StoreType_c,
       CAST(StoreType = 'd' AS INTEGER) AS StoreType_d, CAST(Assortment = 'b' AS INTEGER) AS Assortment_b,
       CAST(Assortment = 'c' AS INTEGER) AS Assortment_c FROM store""")
def rs1(spark, sf):
    s = panels.store_table(spark, sf).select("Store", "StoreType", "Assortment")
    s = reshape.one_hot(s, "StoreType", panels.STORE_TYPES)
    return reshape.one_hot(s, "Assortment", panels.ASSORTMENTS).drop("StoreType", "Assortment")


@register("rs2_joint_label_codes", sql_with(P1_SQL) + """,
lv AS (SELECT StateHoliday FROM train WHERE StateHoliday IS NOT NULL
       UNION SELECT StateHoliday FROM test WHERE StateHoliday IS NOT NULL),
codes AS (SELECT StateHoliday, CAST(dense_rank() OVER (ORDER BY StateHoliday) AS INTEGER) AS StateHoliday_code FROM lv)
SELECT t.Id, c.StateHoliday_code FROM test t LEFT JOIN codes c USING (StateHoliday)""")
def rs2(spark, sf):
    tr, te = panels.p1_train(spark, sf), panels.p1_test(spark, sf)
    codes = reshape.joint_label_codes([tr, te], "StateHoliday")
    return reshape.apply_label_codes(te.select("Id", "StateHoliday"), codes, "StateHoliday").select(
        "Id", F.col("StateHoliday_code").cast("int").alias("StateHoliday_code"))


REPORT_YEARS = range(1990, 2010)  # year columns that the report has at least


def _wide_orders(spark, sf):
    """Wide report: one row per (country, series), one text column per year, '..' = missing."""
    o = read(spark, sf, "orders", "o_orderstatus", "o_orderpriority", "o_orderdate")
    loc = F.when(F.col("o_orderstatus") == "F", "DEU").when(F.col("o_orderstatus") == "O", "FRA").otherwise("ITA")
    label = F.concat(F.year("o_orderdate").cast("string"), F.lit(" [YR"), F.year("o_orderdate").cast("string"),
                     F.lit("]"))
    found = {r.y for r in o.select(F.year("o_orderdate").alias("y")).distinct().collect()}  # bounded by the calendar
    columns = [f"{y} [YR{y}]" for y in sorted((found | {*REPORT_YEARS}) - {None})]
    g = (o.select(loc.alias("Country"), F.col("o_orderpriority").alias("SeriesCode"), label.alias("label"))
          .groupBy("Country", "SeriesCode").pivot("label", columns).agg(F.count(F.lit(1))))
    years = [c for c in g.columns if c not in ("Country", "SeriesCode")]
    return g.select("Country", "SeriesCode", *[F.coalesce(F.col(c).cast("string"), F.lit("..")).alias(c)
                                                for c in years])


@register("rs4_unpivot_years", """
WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'DEU' WHEN 'O' THEN 'FRA' ELSE 'ITA' END AS Country,
                  o_orderpriority AS SeriesCode, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
grid AS (SELECT Country, SeriesCode, CAST(y AS INTEGER) AS year FROM (SELECT DISTINCT Country, SeriesCode FROM o)
         CROSS JOIN (SELECT range AS y FROM range(1990, 2010) UNION SELECT year FROM o WHERE year IS NOT NULL) r),
c AS (SELECT Country, SeriesCode, year, CAST(count(*) AS DOUBLE) AS value FROM o GROUP BY ALL)
SELECT g.Country, g.SeriesCode, g.year, c.value FROM grid g LEFT JOIN c USING (Country, SeriesCode, year)""")
def rs4(spark, sf):
    w = _wide_orders(spark, sf)
    return reshape.unpivot_years(w, ["Country", "SeriesCode"])


@register("rs5_pivot_long_indicators", """
WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'DEU' WHEN 'O' THEN 'FRA' ELSE 'ITA' END AS LOCATION,
                  strftime(o_orderdate, '%Y-%m') AS TIME, o_totalprice, o_orderpriority FROM orders)
SELECT TIME, CAST(count(*) AS DOUBLE) AS ORDERS, CAST(count_if(o_orderpriority = '1-URGENT') AS DOUBLE) AS URGENT,
       round(sum(o_totalprice), 2) / count(o_totalprice) AS AVGPRICE
FROM o WHERE LOCATION = 'DEU' GROUP BY TIME""")
def rs5(spark, sf):
    long = panels.indicators_long(spark, sf, "M")
    return reshape.pivot_indicators(long, "DEU", ["ORDERS", "URGENT", "AVGPRICE"])


@register("rs6_weekly_to_daily", """
WITH w AS (SELECT CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER) AS week_start, count(*) AS value
           FROM orders GROUP BY 1)
SELECT CAST(unnest(generate_series(week_start, week_start + 6, INTERVAL 1 DAY)) AS DATE) AS Date,
       CAST(value AS INTEGER) AS value FROM w""")
def rs6(spark, sf):
    return reshape.weekly_to_daily(panels.weekly_orders(spark, sf))


@register("rs8_standardise_sample_sd", sql_with(P1_SQL) + """,
o AS (SELECT * FROM train WHERE Sales > 0),
s AS (SELECT round(sum(Sales), 2) / count(Sales) AS m, stddev_samp(Sales) AS sd FROM o)
SELECT Store, Date, round((Sales - s.m) / s.sd, 6) AS Sales_std FROM o, s""")
def rs8(spark, sf):
    t = panels.p1_train(spark, sf).filter(F.col("Sales") > 0).select("Store", "Date", "Sales")
    m = t.select(exact_mean("Sales")).scalar()
    sd = t.select(F.stddev_samp("Sales")).scalar()
    return t.select("Store", "Date", F.round((F.col("Sales") - m) / sd, 6).alias("Sales_std"))


@register("rs9_min_max_scale", sql_with(P1_SQL) + """
SELECT Store, Date, (Sales - (SELECT min(Sales) FROM train)) / ((SELECT max(Sales) FROM train) - (SELECT min(Sales) FROM train))
       AS Sales_norm FROM train""")
def rs9(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date", "Sales")
    return reshape.min_max_scale(t, "Sales").select("Store", "Date", "Sales_norm")


@register("rs10_bucketize_distance", _ST + """
SELECT Store, CASE WHEN CompetitionDistance <= 0 THEN 0 WHEN CompetitionDistance <= 1500 THEN 1
                   WHEN CompetitionDistance <= 6000 THEN 2 WHEN CompetitionDistance <= 12000 THEN 3
                   WHEN CompetitionDistance <= 20000 THEN 4 WHEN CompetitionDistance IS NOT NULL THEN 5 END AS distance_bucket
FROM store""")
def rs10(spark, sf):
    s = panels.store_table(spark, sf)
    return s.select("Store", S.bucketize("CompetitionDistance").alias("distance_bucket"))
