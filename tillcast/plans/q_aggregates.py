"""Registered aggregation and metric queries (AG*, ML23) on the dense panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import metrics as M
from ..operators import split, stats
from ..sources import panels
from ..sources.panels import P1_SQL, STORE_SQL, sql_with
from ..sources.tables import read
from .forecast import HOLDOUT_SQL, holdout_frame

_TRAIN = sql_with(P1_SQL)


def _r(c, n=4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@register("ag1_mean_store_promo", _TRAIN + """
SELECT Store, Promo, round(sum(Sales), 2) / count(Sales) AS Sales_all_avg FROM train GROUP BY Store, Promo""")
def ag1(spark, sf):
    t = panels.p1_train(spark, sf)
    return stats.group_mean(t, ["Store", "Promo"], "Sales", "Sales_all_avg")


@register("ag2_mean_store_promo_month", _TRAIN + """
SELECT Store, Promo, CAST(month(Date) AS INTEGER) AS month, round(sum(Sales), 2) / count(Sales) AS Sales_month_avg
FROM train GROUP BY ALL""")
def ag2(spark, sf):
    t = panels.p1_train(spark, sf).withColumn("month", F.month("Date"))
    return stats.group_mean(t, ["Store", "Promo", "month"], "Sales", "Sales_month_avg")


@register("ag3_mean_store_promo_weekday", _TRAIN + """
SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS Sales_day_avg FROM train GROUP BY ALL""")
def ag3(spark, sf):
    t = panels.p1_train(spark, sf)
    return stats.group_mean(t, ["Store", "Promo", "DayOfWeek"], "Sales", "Sales_day_avg")


_AG4_COLS = ["DayOfWeek", "Sales", "Customers", "Open", "Promo", "SchoolHoliday"]


@register("ag4_mean_numeric_by_store_weekday", _TRAIN + "\nSELECT Store, DayOfWeek, " + ", ".join(
    f"round(avg({c}), 4) AS {c}" for c in _AG4_COLS if c != "DayOfWeek") + " FROM train GROUP BY ALL")
def ag4(spark, sf):
    t = panels.p1_train(spark, sf).drop("Date", "StateHoliday")
    out = stats.mean_by(t, ["Store", "DayOfWeek"])
    return out.select("Store", "DayOfWeek", *[_r(c).alias(c) for c in out.columns if c not in ("Store", "DayOfWeek")])


_DESC_COLS = ["Sales", "Customers", "Open", "Promo"]


def _describe_sql():
    parts = []
    for c in _DESC_COLS:
        for stat, expr in [("count", f"CAST(count({c}) AS DOUBLE)"), ("mean", f"avg({c})"),
                           ("std", f"stddev_samp({c})"), ("min", f"CAST(min({c}) AS DOUBLE)"),
                           ("25%", f"quantile_cont({c}, 0.25)"), ("50%", f"quantile_cont({c}, 0.5)"),
                           ("75%", f"quantile_cont({c}, 0.75)"), ("max", f"CAST(max({c}) AS DOUBLE)")]:
            parts.append(f"SELECT '{c}' AS \"column\", '{stat}' AS stat, round({expr}, 4) AS value FROM train")
    return _TRAIN + "\n" + "\nUNION ALL ".join(parts)


@register("ag5_describe", _describe_sql())
def ag5(spark, sf):
    d = stats.describe_long(panels.p1_train(spark, sf), _DESC_COLS)
    return d.withColumn("value", _r("value"))


_SIX = ["min", "q1", "median", "mean", "q3", "max", "sd"]


_SUB_SQL = """,
sub AS (SELECT 'all' AS subset, Sales, p3 FROM hold
        UNION ALL SELECT 'aug_sep', Sales, p3 FROM hold WHERE month IN (8, 9)),
lng AS (SELECT subset, 'Sales' AS series, Sales AS v FROM sub UNION ALL SELECT subset, 'p3', p3 FROM sub)"""
_SIX_SQL = """round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q1,
       round(quantile_cont(v, 0.5), 4) AS median, round(avg(v), 4) AS mean,
       round(quantile_cont(v, 0.75), 4) AS q3, round(max(v), 4) AS max, round(stddev_samp(v), 4) AS sd"""


def _holdout_subsets(spark, sf):
    """Holdout rows once for the whole period and, if in August or September, once more."""
    h = holdout_frame(spark, sf).select("Sales", "p3", "month")
    subsets = F.array_compact(F.array(F.lit("all"), F.when(F.col("month").isin(8, 9), F.lit("aug_sep"))))
    return h.select("Sales", "p3", F.explode(subsets).alias("subset"))


@register("ag6_summary_actual_vs_pred", sql_with(P1_SQL, HOLDOUT_SQL) + _SUB_SQL + f"""
SELECT subset, series, {_SIX_SQL} FROM lng GROUP BY ALL""")
def ag6(spark, sf):
    s = stats.six_number_summary(_holdout_subsets(spark, sf), ["Sales", "p3"], "subset")
    return s.select("subset", "series", *[_r(c).alias(c) for c in _SIX])


@register("ag6_lineitem_summary", f"""
WITH lng AS (SELECT l_returnflag AS subset, 'l_extendedprice' AS series, l_extendedprice AS v FROM lineitem
             UNION ALL SELECT l_returnflag, 'l_quantity', l_quantity FROM lineitem)
SELECT subset, series, {_SIX_SQL} FROM lng GROUP BY ALL""")
def ag6b(spark, sf):
    """Exact quartiles of whole columns of the largest fact."""
    li = read(spark, sf, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity").withColumnRenamed(
        "l_returnflag", "subset")
    s = stats.six_number_summary(li, ["l_extendedprice", "l_quantity"], "subset")
    return s.select("subset", "series", *[_r(c).alias(c) for c in _SIX])


@register("ag6_sketch_rank_error", """
SELECT l_returnflag AS subset, prob, TRUE AS within_bound
FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) p(prob)""")
def ag6c(spark, sf):
    """Ranks of sketched quartiles are within 1 / accuracy (plus one row) of those asked for."""
    li = read(spark, sf, "lineitem", "l_returnflag", "l_extendedprice").toDF("subset", "v")
    q = li.groupBy("subset").agg(stats.quantile_sketch(F.col("v")).alias("q"), F.count("v").alias("n"))
    probs = F.array(*[F.lit(p) for p in stats.QUARTILES])
    asked = q.select("subset", "n", F.explode(F.arrays_zip(probs.alias("p"), F.col("q"))).alias("x"))
    ranks = li.join(asked, "subset").groupBy("subset", "n", "x").agg(
        F.count_if(F.col("v") < F.col("x.q")).alias("below"), F.count_if(F.col("v") <= F.col("x.q")).alias("upto"))
    slack = F.col("n") / stats.QUANTILE_ACCURACY + 1
    want = F.col("x.p") * F.col("n")
    return ranks.select("subset", F.col("x.p").alias("prob"),
                        ((F.col("below") <= want + slack) & (F.col("upto") >= want - slack)).alias("within_bound"))


@register("ag7_column_sums", _TRAIN + """
SELECT round(sum(Sales), 2) AS Sales, CAST(sum(Customers) AS BIGINT) AS Customers,
       CAST(sum(Open) AS BIGINT) AS Open, CAST(sum(Promo) AS BIGINT) AS Promo,
       round(avg(Sales), 4) AS mean_sales FROM train""")
def ag7(spark, sf):
    t = panels.p1_train(spark, sf)
    return t.agg(_r(F.sum("Sales"), 2).alias("Sales"), F.sum("Customers").cast("long").alias("Customers"),
                 F.sum("Open").cast("long").alias("Open"), F.sum("Promo").cast("long").alias("Promo"),
                 _r(F.avg("Sales")).alias("mean_sales"))


_STORE_COLS = ["Store", "StoreType", "Assortment", "CompetitionDistance", "CompetitionOpenSinceMonth",
               "CompetitionOpenSinceYear", "Promo2", "Promo2SinceWeek", "Promo2SinceYear", "PromoInterval"]


def _profile_sql():
    parts = [f"SELECT CAST(count(*) AS BIGINT) AS n_rows, {len(_STORE_COLS)} AS n_columns, '{c}' AS \"column\", "
             f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
             f"CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS has_null FROM store"
             for c in _STORE_COLS]
    return sql_with(STORE_SQL) + "\n" + "\nUNION ALL ".join(parts)


@register("ag8_profile_store_table", _profile_sql())
def ag8(spark, sf):
    return stats.profile(panels.store_table(spark, sf))


_CUST_COLS = ["c_nationkey", "c_mktsegment", "c_acctbal"]


@register("ag8_distinct_values", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY {c}"
    for c in _CUST_COLS[:2]))
def ag8b(spark, sf):
    """The values themselves, with their counts."""
    return stats.distinct_values(read(spark, sf, "customer", *_CUST_COLS[:2]))


@register("ag8_profile_customers", "\nUNION ALL ".join(
    f"SELECT CAST(count(*) AS BIGINT) AS n_rows, {len(_CUST_COLS)} AS n_columns, '{c}' AS \"column\", "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, CAST(count(*) > count({c}) AS INTEGER) AS has_null FROM customer"
    for c in _CUST_COLS))
def ag8c(spark, sf):
    return stats.profile(read(spark, sf, "customer", *_CUST_COLS))


_EVENT_COLS = ["event_type", "user_id", "value", "ts"]


@register("ag8_profile_one_pass", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null,
    CASE WHEN count(DISTINCT {c}) <= 100 THEN CAST(count(DISTINCT {c}) AS BIGINT) END AS n_distinct, TRUE AS within_error,
    CASE WHEN count(DISTINCT {c}) <= 100 THEN (SELECT CAST(max(n) AS BIGINT) FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})) END
    AS most FROM {t}""" for t, c in [("events", c) for c in _EVENT_COLS] + [("customer", c) for c in ("c_nationkey", "c_mktsegment", "c_acctbal")]))
def ag8d(spark, sf):
    """Null, distinct and heavy-hitter figures of all columns in one aggregation per table.

    Columns of up to 100 values are exact; for the others the estimate's error is held against the true count.
    """
    out = None
    for name, cols in (("events", _EVENT_COLS), ("customer", ["c_nationkey", "c_mktsegment", "c_acctbal"])):
        df = read(spark, sf, name, *cols)
        true = df.agg(*[F.count_distinct(c).alias(c) for c in cols]).unpivot([], cols, "of", "true")
        p = stats.profile_sketch(df).join(true, F.col("column") == F.col("of"))
        error = F.abs(F.col("n_distinct") - F.col("true")) <= F.greatest(F.lit(0.03) * F.col("true"), F.lit(0))
        few = F.col("exact")
        p = p.select("column", "n_rows", "n_null", F.when(few, F.col("n_distinct")).alias("n_distinct"), error.alias("within_error"),
                     F.when(few, F.array_max(F.transform("top", lambda x: x["n"]))).alias("most"))
        out = p if out is None else out.unionByName(p)
    return out


@register("ag9_conditional_counts", _TRAIN + """
SELECT CAST(count_if(Open = 1 AND (Sales = 0 OR Customers = 0)) AS BIGINT) AS open_without_sales,
       CAST(count_if(Promo = 1) AS BIGINT) AS promo_days, CAST(count_if(Sales = 0) AS BIGINT) AS zero_sales_days
FROM train""")
def ag9(spark, sf):
    t = panels.p1_train(spark, sf)
    return t.agg(
        F.count_if((F.col("Open") == 1) & ((F.col("Sales") == 0) | (F.col("Customers") == 0)))
         .cast("long").alias("open_without_sales"),
        F.count_if(F.col("Promo") == 1).cast("long").alias("promo_days"),
        F.count_if(F.col("Sales") == 0).cast("long").alias("zero_sales_days"))


@register("ag10_global_stats", _TRAIN + """
SELECT round(min(Sales), 4) AS min_sales, round(max(Sales), 4) AS max_sales, round(avg(Sales), 4) AS mean_sales,
       round(stddev_samp(Sales), 4) AS sd_sales FROM train WHERE Sales > 0""")
def ag10(spark, sf):
    t = panels.p1_train(spark, sf).filter(F.col("Sales") > 0)
    return t.agg(_r(F.min("Sales")).alias("min_sales"), _r(F.max("Sales")).alias("max_sales"),
                 _r(F.avg("Sales")).alias("mean_sales"), _r(F.stddev_samp("Sales")).alias("sd_sales"))


@register("ag11_fold_summary", _TRAIN + """,
folds AS (SELECT DISTINCT Store, CAST(CAST(('0x' || substr(md5(CAST(Store AS VARCHAR)), 1, 8)) AS BIGINT) % 10 AS INTEGER) AS fold FROM train)
SELECT f.fold, CAST(count(DISTINCT t.Store) AS BIGINT) AS stores, CAST(count(*) AS BIGINT) AS n_rows,
       round(avg(t.Sales), 4) AS mean_sales
FROM train t JOIN folds f USING (Store) GROUP BY f.fold""")
def ag11(spark, sf):
    t = panels.p1_train(spark, sf)
    folds = split.store_folds(t.select("Store").distinct(), 10)
    j = t.join(folds, "Store")
    return j.groupBy("fold").agg(F.count_distinct("Store").cast("long").alias("stores"),
                                 F.count(F.lit(1)).cast("long").alias("n_rows"),
                                 _r(F.avg("Sales")).alias("mean_sales"))


_HOLD = sql_with(P1_SQL, HOLDOUT_SQL)


@register("ag12_rmspe_all", _HOLD + """
SELECT round(sqrt(avg(power((p1 - Sales) / Sales, 2))), 6) AS rmspe_p1,
       round(sqrt(avg(power((p2 - Sales) / Sales, 2))), 6) AS rmspe_p2,
       round(sqrt(avg(power((p3 - Sales) / Sales, 2))), 6) AS rmspe_p3,
       CAST(count(*) AS BIGINT) AS n FROM hold""")
def ag12(spark, sf):
    h = holdout_frame(spark, sf)
    return h.agg(*[_r(M.rmspe(p, "Sales"), 6).alias(f"rmspe_{p}") for p in ("p1", "p2", "p3")],
                 F.count(F.lit(1)).cast("long").alias("n"))


AG13_SQL = _HOLD + """
SELECT round(sqrt(avg(power((p3 - Sales) / Sales, 2))), 6) AS rmspe_all,
       round(sqrt(avg(CASE WHEN month IN (8, 9) THEN power((p3 - Sales) / Sales, 2) END)), 6) AS rmspe_aug_sep,
       CAST(count(*) AS BIGINT) AS n_all, CAST(count_if(month IN (8, 9)) AS BIGINT) AS n_aug_sep FROM hold"""


@register("ag13_rmspe_aug_sep", AG13_SQL)
def ag13(spark, sf):
    """How far off is the (store, promo, weekday) mean, overall and in Aug/Sep?"""
    h = holdout_frame(spark, sf)
    aug_sep = F.col("month").isin(8, 9)
    return h.agg(_r(M.rmspe("p3", "Sales"), 6).alias("rmspe_all"),
                 _r(M.rmspe("p3", "Sales", where=aug_sep), 6).alias("rmspe_aug_sep"),
                 F.count(F.lit(1)).cast("long").alias("n_all"),
                 F.count_if(aug_sep).cast("long").alias("n_aug_sep"))


_HOLD_ALL = sql_with(P1_SQL) + f""",
st AS (SELECT *, CAST(month(Date) AS INTEGER) AS month FROM train),
fit AS (SELECT * FROM st WHERE Date < DATE '2000-06-01' AND Sales > 0),
m3 AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p3 FROM fit GROUP BY ALL),
hz AS (SELECT st.*, m3.p3 FROM st LEFT JOIN m3 USING (Store, Promo, DayOfWeek) WHERE st.Date >= DATE '2000-06-01')"""


def _holdout_with_zeros(spark, sf):
    from .forecast import fit_group_mean
    t = panels.p1_train(spark, sf).withColumn("month", F.month("Date"))
    cut = F.lit("2000-06-01").cast("date")
    fit = t.filter((F.col("Date") < cut) & (F.col("Sales") > 0))
    m3 = fit_group_mean(fit, ["Store", "Promo", "DayOfWeek"], "Sales", "p3")
    return t.filter(F.col("Date") >= cut).join(m3, ["Store", "Promo", "DayOfWeek"], "left")


@register("ag14_weighted_rmspe", _HOLD_ALL + """
SELECT round(sqrt(avg(CASE WHEN Sales <> 0 THEN 1.0 / (Sales * Sales) ELSE 0 END * power(Sales - coalesce(p3, 0), 2))), 6) AS wrmspe,
       CAST(count(*) AS BIGINT) AS n, CAST(count_if(Sales = 0) AS BIGINT) AS n_zero FROM hz""")
def ag14(spark, sf):
    h = _holdout_with_zeros(spark, sf).fillna({"p3": 0.0})
    return h.agg(_r(M.weighted_rmspe("p3", "Sales"), 6).alias("wrmspe"),
                 F.count(F.lit(1)).cast("long").alias("n"),
                 F.count_if(F.col("Sales") == 0).cast("long").alias("n_zero"))


@register("ag15_log_space_rmspe", _HOLD_ALL + """,
lg AS (SELECT ln(1 + coalesce(p3, 0)) AS lp, ln(1 + Sales) AS ly FROM hz),
bk AS (SELECT exp(lp) - 1 AS p, exp(ly) - 1 AS y FROM lg)
SELECT round(sqrt(avg(CASE WHEN y <> 0 THEN 1.0 / (y * y) ELSE 0 END * power(y - p, 2))), 5) AS log_rmspe FROM bk""")
def ag15(spark, sf):
    h = _holdout_with_zeros(spark, sf).fillna({"p3": 0.0})
    lg = h.select(F.log1p("p3").alias("lp"), F.log1p("Sales").alias("ly"))
    return lg.agg(_r(M.log_space_rmspe("lp", "ly"), 5).alias("log_rmspe"))


@register("ag16_mse_r2_log", _HOLD + """,
lg AS (SELECT ln(1 + p3) AS p, ln(1 + Sales) AS y FROM hold WHERE p3 IS NOT NULL)
SELECT round(avg(power(p - y, 2)), 5) AS mse, round(1 - sum(power(y - p, 2)) / (count(y) * var_pop(y)), 5) AS r2,
       round(avg(power(p - y, 2)), 5) AS mean_residual_deviance FROM lg""")
def ag16(spark, sf):
    h = holdout_frame(spark, sf).filter(F.col("p3").isNotNull())
    lg = h.select(F.log1p("p3").alias("p"), F.log1p("Sales").alias("y"))
    return lg.agg(_r(M.mse("p", "y"), 5).alias("mse"), _r(M.r2("p", "y"), 5).alias("r2"),
                  _r(M.mse("p", "y"), 5).alias("mean_residual_deviance"))


@register("ag17_importance_normalised", """
WITH br AS (SELECT p.p_brand AS variable, round(sum(l.l_extendedprice), 2) AS relative_importance
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1)
SELECT variable, relative_importance, round(relative_importance / (SELECT max(relative_importance) FROM br), 6) AS scaled_importance,
       round(relative_importance / (SELECT sum(relative_importance) FROM br), 6) AS percentage FROM br""")
def ag17(spark, sf):
    imp = stats.importance_table(panels.brand_revenue(spark, sf))
    return imp.select("variable", "relative_importance", _r("scaled_importance", 6).alias("scaled_importance"),
                      _r("percentage", 6).alias("percentage"))


@register("ml23_train_report", _HOLD + _SUB_SQL + f""",
err AS (SELECT subset, round(sqrt(avg(power((p3 - Sales) / Sales, 2))), 6) AS rmspe, CAST(count(*) AS BIGINT) AS n FROM sub GROUP BY subset)
SELECT subset, series, rmspe, n, {_SIX_SQL} FROM lng JOIN err USING (subset) GROUP BY ALL""")
def ml23(spark, sf):
    """Error and seven-number summaries of predicted and actual sales, all days and August-September."""
    rows = _holdout_subsets(spark, sf)
    err = rows.groupBy("subset").agg(_r(M.rmspe("p3", "Sales"), 6).alias("rmspe"), F.count(F.lit(1)).alias("n"))
    s = stats.six_number_summary(rows, ["Sales", "p3"], "subset").join(err, "subset")
    return s.select("subset", "series", "rmspe", "n", *[_r(c).alias(c) for c in _SIX])


def flagship(spark, sf):
    return ag13(spark, sf)
