"""Golden micro-fixtures: literal frames with hand-derived expected values."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tillcast.functions import scalars as S
from tillcast.operators import clean, reshape, windows


def _days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def _col(df, name, order=("Store", "Date")):
    return [r[0] for r in df.orderBy(*order).select(name).collect()]


def test_lag_demo(spark):
    rows = [(s, d, float(v)) for s in (1, 2) for d, v in zip(_days(5), range(1, 6))]
    df = spark.createDataFrame(rows, "Store int, Date date, Sales double")
    out = windows.shift_cols(df, ["Sales"], [2, -1])
    assert _col(out, "Sales_lag2") == [None, None, 1.0, 2.0, 3.0] * 2
    assert _col(out, "Sales_lead1") == [2.0, 3.0, 4.0, 5.0, None] * 2


def test_lag_reference_names(spark):
    df = spark.createDataFrame([(1, d, 1) for d in _days(3)], "Store int, Date date, Open int")
    out = windows.shift_cols(df, ["Open"], [3, -3], style="reference")
    assert "Open3" in out.columns and "Open-3" in out.columns


def test_scaling_demo(spark):
    df = spark.createDataFrame([(float(x),) for x in range(6)], "x double")
    std = reshape.standardise(df, "x")
    got = [r[0] for r in std.orderBy("x").select("x_std").collect()]
    sd = math.sqrt(3.5)
    assert all(abs(g - (x - 2.5) / sd) < 1e-12 for g, x in zip(got, range(6)))
    mm = reshape.min_max_scale(df, "x")
    assert [round(r[0], 10) for r in mm.orderBy("x").select("x_norm").collect()] == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    pop = reshape.standardise(df, "x", sample=False)
    assert abs(pop.orderBy("x").first()["x_std"] + 2.5 / math.sqrt(35 / 12)) < 1e-12


def test_weekly_to_daily(spark):
    wk = spark.createDataFrame([(dt.date(2012, 12, 30), dt.date(2013, 1, 5), 69),
                                (dt.date(2013, 1, 6), dt.date(2013, 1, 12), 70)],
                               "week_start date, week_end date, value int")
    daily = reshape.weekly_to_daily(wk).filter(F.year("Date") == 2013)
    got = {r["Date"]: r["value"] for r in daily.collect()}
    assert all(got[dt.date(2013, 1, d)] == 69 for d in range(1, 6))
    assert all(got[dt.date(2013, 1, d)] == 70 for d in range(6, 13))


def test_closed_run(spark):
    opens = [1] * 20 + [0] * 17 + [1] * 20
    df = spark.createDataFrame([(909, d, o) for d, o in zip(_days(len(opens)), opens)], "Store int, Date date, Open int")
    out = windows.refurb_features(df).orderBy("Date").collect()
    last_open, reopen = 19, 37
    assert [i for i, r in enumerate(out) if r["DayBeforeRefurb"] == 1] == [last_open]
    assert [i for i, r in enumerate(out) if r["DayAfterRefurb"] == 1] == [reopen]
    assert [r["DaysBeforeRefurb"] for r in out[last_open - 14:last_open + 1]] == list(range(15, 0, -1))
    assert [r["DaysAfterRefurb"] for r in out[reopen:reopen + 15]] == list(range(1, 16))
    inside = out[last_open + 1:reopen]
    assert all(r["DaysBeforeRefurb"] == 0 and r["DaysAfterRefurb"] == 0 for r in inside)


def test_two_close_flags_farthest_wins(spark):
    n = 23
    flag = [1 if i in (2, 5) else 0 for i in range(n)]
    df = spark.createDataFrame([(1, d, f, f) for d, f in zip(_days(n), flag)],
                               "Store int, Date date, DayBeforeRefurb int, DayAfterRefurb int")
    out = windows.refurb_counters(df).orderBy("Date").collect()
    assert [r["DaysBeforeRefurb"] for r in out] == [6, 5, 4, 3, 2, 1] + [0] * (n - 6)
    assert [r["DaysAfterRefurb"] for r in out] == [0, 0] + list(range(1, 16)) + [13, 14, 15] + [0] * 3


def test_counters_do_not_cross_stores(spark):
    rows = [(s, d, 1 if (s == 1 and i == 4) else 0, 0) for s in (1, 2) for i, d in enumerate(_days(5))]
    df = spark.createDataFrame(rows, "Store int, Date date, DayBeforeRefurb int, DayAfterRefurb int")
    out = windows.refurb_counters(df)
    assert _col(out, "DaysBeforeRefurb") == [5, 4, 3, 2, 1, 0, 0, 0, 0, 0]


def test_promo_run(spark):
    promo = [0, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([(1, d, p) for d, p in zip(_days(6), promo)], "Store int, Date date, Promo int")
    out = windows.promo_flags(df)
    assert _col(out, "PromoFirstDate") == [0, 1, 0, 0, 0, 1]
    assert _col(out, "PromoSecondDate") == [0, 0, 1, 0, 0, 0]


def test_open_repair_rules(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 5), (2, 1, 10.0, 0), (3, 1, None, 3)],
                               "k int, Open int, Sales double, Customers int")
    v = {r["k"]: r["Open"] for r in clean.open_rule_sales_or_customers(df).collect()}
    j = {r["k"]: r["Open"] for r in clean.open_rule_sales(df).collect()}
    assert v == {1: 0, 2: 0, 3: 1}
    assert j == {1: 0, 2: 1, 3: 1}
    # idempotent: a second pass changes nothing
    again = clean.open_rule_sales_or_customers(clean.open_rule_sales_or_customers(df))
    assert {r["k"]: r["Open"] for r in again.collect()} == v


def test_state_remap(spark):
    df = spark.createDataFrame([("HB,NI",), ("NI",), ("BE",)], "State string")
    got = [r[0] for r in df.select(S.remap_state(F.col("State"), "HB,NI", "NI")).collect()]
    assert got == ["NI", "NI", "BE"]


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (None, 4.0)], "k int, v double")
    from tillcast.operators import stats
    g = stats.group_mean(df, ["k"], "v", "m", decimals=None).collect()
    assert [(r["k"], r["m"]) for r in g] == [(1, 2.0)]  # NaN skipped, NULL key dropped
    flags = df.select(F.when(F.col("v") > 1, 1).otherwise(0).alias("f")).collect()
    assert [r["f"] for r in flags] == [0, 1, 1]  # NULL comparison falls to 0


def test_one_hot_plus_dropped_level_sums_to_one(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "t string")
    out = reshape.one_hot(df, "t", ["a", "b", "c"])
    rows = out.select((F.col("t_b") + F.col("t_c") + (F.col("t") == "a").cast("int")).alias("s")).collect()
    assert {r["s"] for r in rows} == {1}


def test_bucketize_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1500.0,), (1500.5,), (20000.0,), (20001.0,), (None,)], "d double")
    got = [r[0] for r in df.select(S.bucketize("d")).collect()]
    assert got == [0, 1, 2, 4, 5, None]


def test_positional_select_and_drop(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert clean.select_positions(df, keep=[1, 3]).columns == ["a", "c"]
    assert clean.select_positions(df, drop=[2, 4]).columns == ["a", "c"]
    assert clean.all_but(df, ["b"]) == ["a", "c", "d"]


def test_asof_step_series(spark):
    from tillcast.operators import joins
    days = spark.createDataFrame([(1, d) for d in _days(8)], "Store int, Date date")
    rel = spark.createDataFrame([(dt.date(2020, 1, 2), 10.0), (dt.date(2020, 1, 5), 20.0)],
                                "Released date, Actual double")
    out = joins.asof_attach(days, rel, "Released", ["Actual"], last_day=F.lit(dt.date(2020, 1, 8)))
    got = [r["Actual"] for r in out.orderBy("Date").collect()]
    assert got == [None, 10.0, 10.0, 10.0, 20.0, 20.0, 20.0, 20.0]


def test_asof_repeated_days_timestamps_and_rows_after_the_last_release(spark):
    from tillcast.operators import joins
    days = spark.createDataFrame([(1, d) for d in _days(8)], "Store int, Date date")
    at = dt.datetime
    rel = spark.createDataFrame([(at(2020, 1, 2, 7), 10.0), (at(2020, 1, 2, 9), 11.0), (at(2020, 1, 2, 9), 10.5),
                                 (at(2020, 1, 5, 23), 20.0), (None, 99.0)], "Released timestamp, Actual double")
    out = joins.asof_attach(days, rel, "Released", ["Actual"]).orderBy("Date").collect()
    assert [r["Actual"] for r in out] == [None, 11.0, 11.0, 11.0, 20.0, 20.0, 20.0, 20.0]
    stamped = days.withColumn("Date", F.col("Date").cast("timestamp") + F.expr("interval 5 hours"))
    again = joins.asof_attach(stamped, rel, "Released", ["Actual"]).orderBy("Date").collect()
    assert [r["Actual"] for r in again] == [r["Actual"] for r in out]
    assert joins.asof_attach(days, rel.filter("false"), "Released", ["Actual"]).count() == 8


def test_exact_mean_is_order_independent(spark):
    from tillcast.functions.metrics import exact_mean
    vals = [0.1, 0.2, 0.3, 1e6 + 0.01, 7.77] * 40
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    a = df.repartition(1).agg(exact_mean("x")).first()[0]
    b = df.repartition(13).agg(exact_mean("x")).first()[0]
    assert a == b == round(sum(vals), 2) / len(vals)
