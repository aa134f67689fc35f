"""Registered join and set-operation queries (JN*, SE*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scalars as S
from ..functions.metrics import exact_sum
from ..operators import joins, reshape, stats
from ..sources import panels
from ..sources.panels import P1_SQL, STORE_SQL, WEATHER_SQL, sql_with
from .forecast import BASE_LEARNERS, fit_group_mean

_P1S = sql_with(P1_SQL, STORE_SQL)
_P1SW = sql_with(P1_SQL, STORE_SQL, WEATHER_SQL)


@register("jn1_inner_join_states", _P1S + "\nSELECT t.Store, t.Date, t.Sales, s.State FROM train t JOIN store_states s USING (Store)")
def jn1(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date", "Sales")
    return joins.join_on(t, panels.store_states(spark, sf), "Store")


@register("jn2_natural_join_store", _P1S + """
SELECT t.Store, t.Date, t.Sales, s.StoreType, s.Assortment, s.CompetitionDistance FROM train t NATURAL JOIN
  (SELECT Store, StoreType, Assortment, CompetitionDistance FROM store) s""")
def jn2(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date", "Sales")
    s = panels.store_table(spark, sf).select("Store", "StoreType", "Assortment", "CompetitionDistance")
    return joins.natural_join(t, s)


@register("jn3_full_outer_join", _P1S + """,
a AS (SELECT o_custkey AS Store, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey),
b AS (SELECT c_custkey AS Store, c_mktsegment AS StoreType FROM customer)
SELECT Store, a.total, b.StoreType FROM a FULL OUTER JOIN b USING (Store)""")
def jn3(spark, sf):
    """Every customer with or without orders (either side may lack the key)."""
    from ..sources.tables import read
    o = read(spark, sf, "orders", "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "Store")
    a = o.groupBy("Store").agg(exact_sum("o_totalprice").alias("total"))
    b = read(spark, sf, "customer", "c_custkey", "c_mktsegment").toDF("Store", "StoreType")
    return joins.join_on(a, b, "Store", "full")


def weather_for_panel(spark, sf, panel):
    """Panel rows with their state's weather (compound code reads its file key)."""
    st = panels.store_states(spark, sf).withColumn(
        "file_key", S.remap_state(F.col("State"), panels.COMPOUND_STATE, "MI"))
    w = panels.weather(spark, sf).withColumnRenamed("State", "file_key")
    return panel.join(st, "Store").join(w, ["file_key", "Date"], "left").drop("file_key")


WEATHER_PANEL_SQL = """
ss AS (SELECT Store, State, CASE WHEN State = 'AS,MI' THEN 'MI' ELSE State END AS file_key FROM store_states),
pw AS (SELECT p1.*, ss.State, w.Mean_TemperatureC, w.Max_Wind_SpeedKm_h, w.Precipitationmm, w.Goog_trend, w.Events
       FROM p1 JOIN ss USING (Store) LEFT JOIN weather w ON w.State = ss.file_key AND w.Date = p1.Date)"""


@register("jn4_left_join_state_date", sql_with(P1_SQL, STORE_SQL, WEATHER_SQL, WEATHER_PANEL_SQL) + """
SELECT Store, Date, State, Mean_TemperatureC, Max_Wind_SpeedKm_h, Precipitationmm, Goog_trend, Events FROM pw""")
def jn4(spark, sf):
    p = panels.p1_dense(spark, sf).select("Store", "Date")
    return weather_for_panel(spark, sf, p)


@register("jn5_left_join_date", _P1SW + """
SELECT t.Store, t.Date, a.Goog_trend_ALL FROM train t LEFT JOIN trend_all a USING (Date)""")
def jn5(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date")
    return joins.join_on(t, panels.trend_all(spark, sf), "Date", "left")


@register("jn6_group_stats_back", _P1S + """,
tm AS (SELECT *, CAST(month(Date) AS INTEGER) AS month FROM train),
a1 AS (SELECT Store, Promo, round(sum(Sales), 2) / count(Sales) AS Sales_all_avg FROM tm GROUP BY ALL),
a2 AS (SELECT Store, Promo, month, round(sum(Sales), 2) / count(Sales) AS Sales_month_avg FROM tm GROUP BY ALL),
a3 AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS Sales_day_avg FROM tm GROUP BY ALL)
SELECT Store, Date, Sales_all_avg, Sales_month_avg, Sales_day_avg FROM tm
  LEFT JOIN a1 USING (Store, Promo) LEFT JOIN a2 USING (Store, Promo, month) LEFT JOIN a3 USING (Store, Promo, DayOfWeek)""")
def jn6(spark, sf):
    t = panels.p1_train(spark, sf).withColumn("month", F.month("Date"))
    out = stats.attach_target_means(t)
    return out.select("Store", "Date", "Sales_all_avg", "Sales_month_avg", "Sales_day_avg")


@register("jn7_scalar_attach", _P1S + """
SELECT Store, Date, round(Sales / (SELECT max(Sales) FROM train), 6) AS share_of_max FROM train""")
def jn7(spark, sf):
    t = panels.p1_train(spark, sf)
    mx = joins.scalar_of(t, F.max("Sales"))
    return t.select("Store", "Date", F.round(F.col("Sales") / mx, 6).alias("share_of_max"))


@register("jn8_column_bind", sql_with(STORE_SQL) + """
SELECT Store, CompetitionDistance, CAST(StoreType = 'b' AS INTEGER) AS StoreType_b,
       CAST(StoreType = 'c' AS INTEGER) AS StoreType_c, CAST(StoreType = 'd' AS INTEGER) AS StoreType_d FROM store""")
def jn8(spark, sf):
    s = panels.store_table(spark, sf).select("Store", "CompetitionDistance", "StoreType")
    return reshape.one_hot(s, "StoreType", panels.STORE_TYPES).drop("StoreType")


_REL_SQL = """
rel AS (SELECT CAST(o_orderdate AS DATE) AS Released, CAST(count(*) AS DOUBLE) AS Actual FROM orders
        WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1)"""


@register("jn9_asof_release_attach", sql_with(P1_SQL, _REL_SQL) + """
SELECT t.Store, t.Date, r.Actual FROM train t ASOF LEFT JOIN rel r ON t.Date >= r.Released""")
def jn9(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date")
    return joins.asof_attach(t, panels.releases(spark, sf), "Released", ["Actual"])


@register("jn9_asof_repeated_timestamps", """
WITH obs AS (SELECT date_trunc('day', ts) AS d, ts, event_id, value FROM events WHERE event_type = 'purchase'),
rel AS (SELECT d, arg_max(value, (ts, event_id)) AS Actual FROM obs GROUP BY d)
SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_shipdate AS DATE) AS Day, r.Actual
FROM lineitem l ASOF LEFT JOIN rel r ON date_trunc('day', l.l_shipdate) >= r.d""")
def jn9b(spark, sf):
    """Many observations a day, by timestamp; detail rows long after the last one."""
    from ..sources.tables import read
    e = read(spark, sf, "events", "ts", "event_id", "event_type", "value")
    obs = e.filter(F.col("event_type") == "purchase")
    obs = obs.select(F.col("ts").alias("Released"), "event_id", F.col("value").alias("Actual"))
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate")
    out = joins.asof_attach(li, obs, "Released", ["event_id", "Actual"], on="l_shipdate")
    return out.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("Day"), "Actual")


@register("jn9_asof_user_events", """
WITH obs AS (SELECT user_id, ts, arg_max(value, (event_id, value)) AS last_value, max(event_id) AS last_event
             FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, o.last_event, o.last_value
FROM events e ASOF LEFT JOIN obs o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def jn9c(spark, sf):
    """Every event with its user's latest purchase at or before it, by user and time of day."""
    from ..sources.tables import read
    e = read(spark, sf, "events", "event_id", "user_id", "ts", "event_type", "value")
    bought = e.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("last_event"), F.col("value").alias("last_value"))
    out = joins.asof_by_key(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "bought_at", ["last_event", "last_value"])
    return out.select("event_id", "user_id", "last_event", "last_value")


@register("jn10_blend_by_id", _P1S + """,
fit AS (SELECT *, CAST(month(Date) AS INTEGER) AS month FROM train WHERE Sales > 0),
m1 AS (SELECT Store, Promo, round(sum(Sales), 2) / count(Sales) AS p1 FROM fit GROUP BY ALL),
m2 AS (SELECT Store, Promo, month, round(sum(Sales), 2) / count(Sales) AS p2 FROM fit GROUP BY ALL),
m3 AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p3 FROM fit GROUP BY ALL),
te AS (SELECT *, CAST(month(Date) AS INTEGER) AS month FROM test)
SELECT Id, (m1.p1 * 1.0 + m2.p2 * 2.0 + m3.p3 * 3.0) / 6.0 AS Sales FROM te
  JOIN m1 USING (Store, Promo) JOIN m2 USING (Store, Promo, month) JOIN m3 USING (Store, Promo, DayOfWeek)""")
def jn10(spark, sf):
    fit = panels.p1_train(spark, sf).filter(F.col("Sales") > 0).withColumn("month", F.month("Date"))
    te = panels.p1_test(spark, sf).withColumn("month", F.month("Date"))
    preds = []
    for name, keys in BASE_LEARNERS.items():
        m = fit_group_mean(fit, keys, "Sales", "Sales")
        preds.append(te.join(m, list(keys)).select("Id", "Sales"))
    # exact means blended in the same IEEE order as the oracle: no rounding needed
    return joins.blend_by_id(preds, [1.0, 2.0, 3.0])


# ------------------------------------------------------------ set operations

@register("se1_union_by_name", sql_with(P1_SQL) + """
SELECT *, 'train' AS type FROM train UNION ALL BY NAME SELECT *, 'test' AS type FROM test""")
def se1(spark, sf):
    tr = panels.p1_train(spark, sf).withColumn("type", F.lit("train"))
    te = panels.p1_test(spark, sf).withColumn("type", F.lit("test"))
    return reshape.union_all([tr, te])


@register("se2_union_all", sql_with(P1_SQL) + """
SELECT Store, Date, Sales FROM train WHERE year(Date) < 1998
UNION ALL SELECT Store, Date, Sales FROM train WHERE year(Date) >= 1998""")
def se2(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date", "Sales")
    return reshape.union_all([t.filter(F.year("Date") < 1998), t.filter(F.year("Date") >= 1998)], False)


@register("se3_union_distinct_levels", sql_with(P1_SQL) + """
SELECT StateHoliday FROM train WHERE StateHoliday IS NOT NULL
UNION SELECT StateHoliday FROM test WHERE StateHoliday IS NOT NULL""")
def se3(spark, sf):
    return reshape.union_levels([panels.p1_train(spark, sf), panels.p1_test(spark, sf)], "StateHoliday")
