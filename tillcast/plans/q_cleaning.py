"""Registered projection, filter and cleaning queries (PF*, CL*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalars as S
from ..operators import clean
from ..sources import panels
from ..sources.panels import P1_SQL, STORE_SQL, sql_with
from .forecast import fit_group_mean

_P1 = sql_with(P1_SQL)
_P1S = sql_with(P1_SQL, STORE_SQL)
_ST = sql_with(STORE_SQL)


@register("pf1_column_subset", _P1 + "\nSELECT Id, Store, Date FROM test")
def pf1(spark, sf):
    return panels.p1_test(spark, sf).select("Id", "Store", "Date")


@register("pf2_drop_columns", _P1 + "\nSELECT Store, DayOfWeek, Date, Sales, Open, Promo FROM train")
def pf2(spark, sf):
    return panels.p1_train(spark, sf).drop("Customers", "StateHoliday", "SchoolHoliday")


_EXCLUDED = ["Id", "Date", "Sales", "Customers"]


@register("pf3_all_but_excluded", _P1S + """
SELECT Store, DayOfWeek, Open, Promo, StateHoliday, SchoolHoliday, StoreType, Assortment, CompetitionDistance,
       CompetitionOpenSinceMonth, CompetitionOpenSinceYear, Promo2, Promo2SinceWeek, Promo2SinceYear, PromoInterval
FROM train JOIN store USING (Store)""")
def pf3(spark, sf):
    t = panels.p1_train(spark, sf).join(panels.store_table(spark, sf), "Store")
    return t.select(*clean.all_but(t, _EXCLUDED))


@register("pf5_constant_column", _P1 + "\nSELECT Store, Date, 'train' AS type FROM train")
def pf5(spark, sf):
    return clean.add_constant(panels.p1_train(spark, sf).select("Store", "Date"), "type", "train")


@register("pf6_align_test_columns", _P1 + "\nSELECT Id, Store, Date, Open, 0 AS Sales, 0 AS Customers FROM test")
def pf6(spark, sf):
    t = panels.p1_test(spark, sf).select("Id", "Store", "Date", "Open")
    return clean.align_columns(t, ["Store", "Date", "Sales", "Customers", "Open"], fill=0)


@register("pf7_conditional_assignment", _P1 + """
SELECT Store, Date, CASE WHEN Open = 0 THEN -1 ELSE Customers END AS Customers FROM train""")
def pf7(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date", "Open", "Customers")
    return clean.set_where(t, F.col("Open") == 0, "Customers", -1).drop("Open")


@register("pf8_drop_zero_sales", _P1 + "\nSELECT Store, Date, Sales FROM train WHERE Sales > 0")
def pf8(spark, sf):
    return clean.drop_zero_target(panels.p1_train(spark, sf)).select("Store", "Date", "Sales")


@register("pf9_drop_closed", _P1 + "\nSELECT Id, Store, Date FROM test WHERE Open <> 0")
def pf9(spark, sf):
    return clean.drop_closed(panels.p1_test(spark, sf)).select("Id", "Store", "Date")


@register("pf10_compound_predicate", _P1 + """
SELECT Store, Date FROM train WHERE Open = 1 AND (Sales < 100000 OR Customers = 1)""")
def pf10(spark, sf):
    t = panels.p1_train(spark, sf)
    return t.filter((F.col("Open") == 1) & ((F.col("Sales") < 100000) | (F.col("Customers") == 1))).select(
        "Store", "Date")


@register("pf11_membership_filter", _P1 + "\nSELECT Store, Date, Sales FROM train WHERE month(Date) IN (8, 9)")
def pf11(spark, sf):
    t = panels.p1_train(spark, sf)
    return t.filter(F.month("Date").isin(8, 9)).select("Store", "Date", "Sales")


@register("pf12_rows_with_null", _ST + """
SELECT * FROM store WHERE CompetitionDistance IS NULL OR CompetitionOpenSinceMonth IS NULL
   OR CompetitionOpenSinceYear IS NULL OR Promo2SinceWeek IS NULL OR Promo2SinceYear IS NULL OR PromoInterval IS NULL""")
def pf12(spark, sf):
    return clean.rows_with_null(panels.store_table(spark, sf))


@register("pf13_rename", _ST + """
SELECT Store AS store_id, StoreType AS store_type, CompetitionDistance AS distance FROM store""")
def pf13(spark, sf):
    s = panels.store_table(spark, sf).select("Store", "StoreType", "CompetitionDistance")
    return s.withColumnsRenamed({"Store": "store_id", "StoreType": "store_type", "CompetitionDistance": "distance"})


@register("pf14_cast", _P1 + """
SELECT Store, Date, CAST(trunc(Sales) AS INTEGER) AS sales_int, CAST(Store AS VARCHAR) AS store_str,
       CAST(Open AS DOUBLE) AS open_dbl FROM train""")
def pf14(spark, sf):
    t = panels.p1_train(spark, sf)
    return t.select("Store", "Date", F.col("Sales").cast("int").alias("sales_int"),
                    F.col("Store").cast("string").alias("store_str"), F.col("Open").cast("double").alias("open_dbl"))


@register("pf15_head_tail", _P1 + """
SELECT * FROM (SELECT 'head' AS part, Store, Date, Sales FROM train ORDER BY Store, Date LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'tail', Store, Date, Sales FROM train ORDER BY Store DESC, Date DESC LIMIT 1)""")
def pf15(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date", "Sales")
    head = t.orderBy("Store", "Date").limit(5).withColumn("part", F.lit("head"))
    tail = t.orderBy(F.desc("Store"), F.desc("Date")).limit(1).withColumn("part", F.lit("tail"))
    return head.unionByName(tail).select("part", "Store", "Date", "Sales")


@register("pf16_shape", _P1 + "\nSELECT CAST(count(*) AS BIGINT) AS n_rows, 9 AS n_columns FROM train")
def pf16(spark, sf):
    t = panels.p1_train(spark, sf)
    return t.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).withColumn("n_columns", F.lit(len(t.columns)))


@register("pf17_distinct_values", _P1 + "\nSELECT DISTINCT StateHoliday FROM train")
def pf17(spark, sf):
    return panels.p1_train(spark, sf).select("StateHoliday").distinct()


@register("pf19_columns_by_pattern", _ST + "\nSELECT Promo2, Promo2SinceWeek, Promo2SinceYear, PromoInterval FROM store")
def pf19(spark, sf):
    return clean.columns_like(panels.store_table(spark, sf), "Promo")


@register("pf20_equality_filter", _P1 + """
SELECT Store, Date, Sales FROM train WHERE dayofyear(Date) = 213 AND Store = 7""")
def pf20(spark, sf):
    t = panels.p1_train(spark, sf)
    return t.filter((F.dayofyear("Date") == 213) & (F.col("Store") == 7)).select("Store", "Date", "Sales")


# ---------------------------------------------------------------- cleaning

@register("cl1_fill_open", _P1 + "\nSELECT Id, coalesce(Open, 1) AS Open FROM test")
def cl1(spark, sf):
    return clean.fill_open(panels.p1_test(spark, sf).select("Id", "Open"), 1)


@register("cl2_fill_all_numeric", _ST + """
SELECT Store, StoreType, Assortment, coalesce(CompetitionDistance, 0) AS CompetitionDistance,
       coalesce(CompetitionOpenSinceMonth, 0) AS CompetitionOpenSinceMonth,
       coalesce(CompetitionOpenSinceYear, 0) AS CompetitionOpenSinceYear, Promo2,
       coalesce(Promo2SinceWeek, 0) AS Promo2SinceWeek, coalesce(Promo2SinceYear, 0) AS Promo2SinceYear,
       PromoInterval FROM store""")
def cl2(spark, sf):
    return clean.fill_numeric(panels.store_table(spark, sf), 0)


@register("cl3_per_column_defaults", _ST + """
SELECT Store, coalesce(CompetitionOpenSinceYear, 1990) AS CompetitionOpenSinceYear,
       coalesce(CompetitionOpenSinceMonth, 1) AS CompetitionOpenSinceMonth,
       coalesce(CompetitionDistance, 75000) AS CompetitionDistance FROM store""")
def cl3(spark, sf):
    s = panels.store_table(spark, sf).select("Store", "CompetitionOpenSinceYear", "CompetitionOpenSinceMonth",
                                             "CompetitionDistance")
    return clean.fill_defaults(s, {"CompetitionOpenSinceYear": 1990, "CompetitionOpenSinceMonth": 1,
                                   "CompetitionDistance": 75000.0})


@register("cl4_missing_open_as_zero", _P1 + "\nSELECT Id, coalesce(Open, 0) AS Open FROM test")
def cl4(spark, sf):
    t = panels.p1_test(spark, sf)
    return t.select("Id", F.coalesce("Open", F.lit(0)).alias("Open"))


@register("cl5_mean_fill", _ST + """
SELECT Store, coalesce(CompetitionDistance,
       (SELECT round(sum(CompetitionDistance), 2) / count(CompetitionDistance) FROM store)) AS CompetitionDistance
FROM store""")
def cl5(spark, sf):
    s = panels.store_table(spark, sf).select("Store", "CompetitionDistance")
    return clean.fill_with_means(s, ["CompetitionDistance"], decimals=2)


@register("cl6_standard_holiday_code", _P1 + """
SELECT coalesce(StateHoliday, '0') AS StateHoliday, CAST(count(*) AS BIGINT) AS n FROM train GROUP BY 1""")
def cl6(spark, sf):
    t = panels.p1_train(spark, sf)
    return t.groupBy(S.standard_holiday("StateHoliday").alias("StateHoliday")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))


@register("cl7_open_rules", _P1 + """,
raw AS (SELECT *, CASE WHEN DayOfWeek = 7 THEN 0 ELSE 1 END AS OpenRaw FROM train)
SELECT Store, CAST(sum(OpenRaw) AS BIGINT) AS open_raw,
       CAST(sum(CASE WHEN Sales = 0 THEN 0 ELSE OpenRaw END) AS BIGINT) AS open_rule_j,
       CAST(sum(CASE WHEN OpenRaw = 1 AND (Sales = 0 OR Customers = 0) THEN 0 ELSE OpenRaw END) AS BIGINT) AS open_rule_v
FROM raw GROUP BY Store""")
def cl7(spark, sf):
    t = panels.p1_train(spark, sf).withColumn("Open", F.when(F.col("DayOfWeek") == 7, 0).otherwise(1))
    t = clean.open_rule_sales(t.withColumn("OJ", F.col("Open")), "OJ")
    t = clean.open_rule_sales_or_customers(t.withColumn("OV", F.col("Open")), "OV")
    return t.groupBy("Store").agg(F.sum("Open").cast("long").alias("open_raw"),
                                  F.sum("OJ").cast("long").alias("open_rule_j"),
                                  F.sum("OV").cast("long").alias("open_rule_v"))


def _null_sql(kind):
    cols = ["Store", "StoreType", "Assortment", "CompetitionDistance", "CompetitionOpenSinceMonth",
            "CompetitionOpenSinceYear", "Promo2", "Promo2SinceWeek", "Promo2SinceYear", "PromoInterval"]
    if kind == "flag":
        sel = "CAST(count_if({c} IS NULL) > 0 AS INTEGER) AS has_null"
    else:
        sel = "CAST(count_if({c} IS NULL) AS BIGINT) AS null_count"
    return _ST + "\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", " + sel.format(c=c) + " FROM store" for c in cols)


@register("cl8_any_null_per_column", _null_sql("flag"))
def cl8(spark, sf):
    return clean.null_profile(panels.store_table(spark, sf)).select("column", "has_null")


@register("cl9_null_count_per_column", _null_sql("count"))
def cl9(spark, sf):
    return clean.null_profile(panels.store_table(spark, sf)).select("column", "null_count")


@register("cl10_clamp_negative", _P1 + """
SELECT Store, Date, round(greatest(ln(1 + Sales) - 12.0, 0.0), 6) AS clamped FROM train WHERE Sales > 0""")
def cl10(spark, sf):
    t = panels.p1_train(spark, sf).filter(F.col("Sales") > 0)
    return t.select("Store", "Date", F.round(S.clamp_at_zero(F.log1p("Sales") - 12.0), 6).alias("clamped"))


@register("cl11_zero_closed_forecast", _P1 + """,
m AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p FROM train WHERE Sales > 0 GROUP BY ALL)
SELECT Id, CASE WHEN Open = 0 THEN 0.0 ELSE m.p END AS Sales FROM test LEFT JOIN m USING (Store, Promo, DayOfWeek)""")
def cl11(spark, sf):
    tr = panels.p1_train(spark, sf).filter(F.col("Sales") > 0)
    m = fit_group_mean(tr, ["Store", "Promo", "DayOfWeek"], "Sales", "p")
    t = panels.p1_test(spark, sf).join(m, ["Store", "Promo", "DayOfWeek"], "left")
    return t.select("Id", F.when(F.col("Open") == 0, F.lit(0.0)).otherwise(F.col("p")).alias("Sales"))


@register("cl12_state_code_remap", _ST + """
SELECT Store, State, CASE WHEN State = 'AS,MI' THEN 'MI' ELSE State END AS file_key FROM store_states""")
def cl12(spark, sf):
    s = panels.store_states(spark, sf)
    return s.withColumn("file_key", S.remap_state(F.col("State"), panels.COMPOUND_STATE, "MI"))
