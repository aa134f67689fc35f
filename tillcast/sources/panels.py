"""Store-by-day panels and side series derived from the driver's tables.

There is no retail panel in the test data, so the library's operators run on
panels that Spark derives from the TPC-H-like tables; every derivation is an
aggregation whose work grows with the input.  Each builder has a DuckDB twin
(``*_SQL`` CTE text) used only by the oracle queries.

Scale notes
-----------
* ``p1_dense``: orders join customer on the customer key (shuffle join; AQE
  splits a hot customer's orders), then a partial (map-side) aggregation to
  (nation, day) so the shuffle carries at most one row per key per task.
  The calendar is produced by ``explode(sequence(lo, hi))`` per store with
  ``lo``/``hi`` as scalar subqueries: no cross join.
* ``p2_sparse``: one row per order; (customer, day) repeats, so the order key
  is the tie-break that makes positional lags deterministic.
* Side series are keyed by (state, day) or day: one row per key, so their
  size is bounded by the calendar, whatever the fact size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import exact_mean
from .tables import read

# The cut-off that splits the dense panel into a training and a
# forecast period, and the store whose forecast rows have missing ``Open``.
TEST_START = "2001-06-01"
GAP_STORE = 7
# The competition-promo month lists used by the store table.
PROMO_INTERVALS = ("Jan,Apr,Jul,Oct", "Feb,May,Aug,Nov", "Mar,Jun,Sept,Dec")
# The levels of the store table's two codes.
STORE_TYPES = ("a", "b", "c", "d")
ASSORTMENTS = ("a", "b", "c")
# Fixed value: a compound state code, read from the file of its second part.
COMPOUND_STATE = "AS,MI"


def _holiday(date: Column) -> Column:
    m, d = F.month(date), F.dayofmonth(date)
    return (F.when(((m == 1) & (d == 1)) | ((m == 5) & (d == 1)) | ((m == 10) & (d == 3)), "a")
            .when((m == 4) & d.between(14, 17), "b")
            .when((m == 12) & d.isin(25, 26), "c")
            # day 15 carries the "mixed type" defect: a missing code
            .when(d == 15, F.lit(None).cast("string"))
            .otherwise("0"))


def _school(date: Column) -> Column:
    m, d = F.month(date), F.dayofmonth(date)
    return F.when(m.isin(7, 8) | ((m == 12) & (d >= 23)), 1).otherwise(0)


def orders_by_store_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return (j.groupBy(F.col("c_nationkey").alias("Store"), F.to_date("o_orderdate").alias("Date"))
             .agg(F.round(F.sum("o_totalprice"), 2).alias("Sales"),
                  F.count_distinct("o_custkey").cast("int").alias("Customers"),
                  F.max(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")).alias("Promo")))


def calendar_bounds(spark: SparkSession, sf_dir: str):
    """First and last order day as scalar subqueries (one merged scan of one column)."""
    o = read(spark, sf_dir, "orders", "o_orderdate")
    return (o.select(F.min(F.to_date("o_orderdate"))).scalar(),
            o.select(F.max(F.to_date("o_orderdate"))).scalar())


def p1_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (nation, day) between the first and last order day."""
    lo, hi = calendar_bounds(spark, sf_dir)
    days = (read(spark, sf_dir, "nation", "n_nationkey")
            .select(F.col("n_nationkey").cast("int").alias("Store"),
                    F.explode(F.sequence(lo, hi)).alias("Date")))
    agg = orders_by_store_day(spark, sf_dir)
    p = days.join(agg, ["Store", "Date"], "left")
    return p.select(
        "Store",
        F.extract(F.lit("DAYOFWEEK_ISO"), F.col("Date")).cast("int").alias("DayOfWeek"),
        "Date",
        F.coalesce("Sales", F.lit(0.0)).cast("double").alias("Sales"),
        F.coalesce("Customers", F.lit(0)).cast("int").alias("Customers"),
        F.when(F.col("Customers").isNull(), 0).otherwise(1).alias("Open"),
        F.coalesce("Promo", F.lit(0)).cast("int").alias("Promo"),
        _holiday(F.col("Date")).alias("StateHoliday"),
        _school(F.col("Date")).alias("SchoolHoliday"),
    )


def p1_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and forecast rows in one pass, tagged by ``type``.

    Forecast rows (from TEST_START) carry an ``Id``, no Sales/Customers and
    a few missing ``Open`` values; training rows have a NULL ``Id``.
    """
    p = p1_dense(spark, sf_dir)
    start = F.lit(TEST_START).cast("date")
    is_test = F.col("Date") >= start
    gap = is_test & (F.col("Store") == GAP_STORE) & (F.dayofmonth("Date") % 5 == 0)
    return p.select(
        F.when(is_test, (F.col("Store") * 1000 + F.datediff("Date", start) + 1).cast("int")).alias("Id"),
        "Store", "DayOfWeek", "Date",
        F.when(is_test, F.lit(None)).otherwise(F.col("Sales")).cast("double").alias("Sales"),
        F.when(is_test, F.lit(None)).otherwise(F.col("Customers")).cast("int").alias("Customers"),
        F.when(gap, F.lit(None)).otherwise(F.col("Open")).cast("int").alias("Open"),
        "Promo", "StateHoliday", "SchoolHoliday",
        F.when(is_test, "test").otherwise("train").alias("type"))


def p1_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_all(spark, sf_dir).filter(F.col("type") == "train").drop("Id", "type")


def p1_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast period: no Sales/Customers, an ``Id``, a few missing ``Open``."""
    return (p1_all(spark, sf_dir).filter(F.col("type") == "test")
            .select("Id", "Store", "DayOfWeek", "Date", "Open", "Promo", "StateHoliday", "SchoolHoliday"))


def store_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store attributes: one row per nation, distance from customers' balances."""
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    cust = (read(spark, sf_dir, "customer", "c_nationkey", "c_acctbal")
            .groupBy("c_nationkey").agg(F.max("c_acctbal").alias("maxbal")))
    k = F.col("n_nationkey")
    promo2 = (k % 2).cast("int")
    interval = (F.when(k % 3 == 0, PROMO_INTERVALS[0]).when(k % 3 == 1, PROMO_INTERVALS[1])
                .otherwise(PROMO_INTERVALS[2]))
    return (n.join(cust, n.n_nationkey == cust.c_nationkey, "left")
            .select(k.cast("int").alias("Store"),
                    F.expr("chr(97 + n_regionkey % 4)").alias("StoreType"),
                    F.expr("chr(97 + n_nationkey % 3)").alias("Assortment"),
                    F.when(k % 7 == 3, F.lit(None)).otherwise(F.col("maxbal")).cast("double")
                     .alias("CompetitionDistance"),
                    F.when(k % 5 == 1, F.lit(None)).otherwise(1 + k % 12).cast("int")
                     .alias("CompetitionOpenSinceMonth"),
                    F.when(k % 5 == 1, F.lit(None)).otherwise(1990 + k % 9).cast("int")
                     .alias("CompetitionOpenSinceYear"),
                    promo2.alias("Promo2"),
                    F.when(promo2 == 1, 1 + (k * 7) % 50).cast("int").alias("Promo2SinceWeek"),
                    F.when(promo2 == 1, 1996 + k % 4).cast("int").alias("Promo2SinceYear"),
                    F.when(promo2 == 1, interval).alias("PromoInterval")))


def state_code(region_name: Column) -> Column:
    return F.upper(F.substring(region_name, 1, 2))


def store_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region", "r_regionkey", "r_name")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_nationkey").cast("int").alias("Store"),
                     F.when(F.col("r_regionkey") == 4, COMPOUND_STATE)
                      .otherwise(state_code(F.col("r_name"))).alias("State")))


def p2_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; Store = customer, Seq = order key tie-break."""
    o = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice",
             "o_orderpriority", "o_orderstatus")
    return o.select(F.col("o_custkey").alias("Store"), F.to_date("o_orderdate").alias("Date"),
                    F.col("o_orderkey").alias("Seq"), F.col("o_totalprice").alias("Sales"),
                    F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("Promo"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("Open"))


def p3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "user_id", "ts", "value", "event_type")
    return (e.groupBy(F.col("user_id").alias("Store"), F.to_date("ts").alias("Date"))
             .agg(F.round(F.sum("value"), 2).alias("Sales"),
                  F.count(F.lit(1)).cast("int").alias("Customers"),
                  F.max((F.col("event_type") == "purchase").cast("int")).alias("Promo")))


def _shipments_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_discount", "l_tax",
              "l_returnflag", "l_shipdate")
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region", "r_regionkey", "r_name")
    # nation/region resolve to a state per supplier first, so the fact side
    # meets one dimension; Catalyst broadcasts the tiny sides from their
    # measured file sizes (no hint needed).
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", state_code(F.col("r_name")).alias("State"))
    sup = s.join(geo, s.s_nationkey == geo.n_nationkey).select("s_suppkey", "State")
    return li.join(sup, li.l_suppkey == sup.s_suppkey).withColumn("Date", F.to_date("l_shipdate"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1: per (state code, day) numeric series and a most-frequent string code.

    One pass over the shipments: a (state, day, code) partial aggregate, then
    a roll-up to (state, day) that also picks the mode (highest count, then
    the smallest code).
    """
    x = _shipments_by_state(spark, sf_dir)
    g = x.groupBy("State", "Date", "l_returnflag").agg(
        F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"),
        F.max("l_discount").alias("md"), F.sum("l_tax").alias("t"))
    return g.groupBy("State", "Date").agg(
        F.round(F.sum("q") / F.sum("n"), 4).alias("Mean_TemperatureC"),
        F.round(F.max("md") * 100, 4).alias("Max_Wind_SpeedKm_h"),
        F.round(F.sum("t"), 4).alias("Precipitationmm"),
        F.sum("n").cast("int").alias("Goog_trend"),
        F.min(F.struct(-F.col("n"), F.col("l_returnflag"))).getField("l_returnflag").alias("Events"))


def trend_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2: global daily series."""
    li = read(spark, sf_dir, "lineitem", "l_shipdate")
    return li.groupBy(F.to_date("l_shipdate").alias("Date")).agg(
        F.count(F.lit(1)).cast("int").alias("Goog_trend_ALL"))


def _location(status: Column) -> Column:
    return F.when(status == "F", "DEU").when(status == "O", "FRA").otherwise("ITA")


def indicators_long(spark: SparkSession, sf_dir: str, freq: str = "M") -> DataFrame:
    """X3: long indicator table (LOCATION, INDICATOR, FREQUENCY, TIME, Value)."""
    o = read(spark, sf_dir, "orders", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority")
    fmt = "yyyy-MM" if freq == "M" else "yyyy"
    g = o.groupBy(_location(F.col("o_orderstatus")).alias("LOCATION"),
                  F.date_format("o_orderdate", fmt).alias("TIME"))
    wide = g.agg(F.count(F.lit(1)).cast("double").alias("ORDERS"),
                 F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("URGENT"),
                 exact_mean("o_totalprice").alias("AVGPRICE"))
    return (wide.unpivot(["LOCATION", "TIME"], ["ORDERS", "URGENT", "AVGPRICE"], "INDICATOR", "Value")
                .select("LOCATION", "INDICATOR", F.lit(freq).alias("FREQUENCY"), "TIME", "Value"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular release series: days with pending urgent orders, newest first in files."""
    o = read(spark, sf_dir, "orders", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return (o.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"))
             .groupBy(F.to_date("o_orderdate").alias("Released"))
             .agg(F.count(F.lit(1)).cast("double").alias("Actual")))


def weekly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly totals, weeks Sunday..Saturday, as (week_start, week_end, value)."""
    o = read(spark, sf_dir, "orders", "o_orderdate")
    d = F.to_date("o_orderdate")
    start = F.date_sub(d, F.dayofweek(d) - 1)
    return (o.groupBy(start.alias("week_start"))
             .agg(F.count(F.lit(1)).cast("int").alias("value"))
             .withColumn("week_end", F.date_add("week_start", 6)))


def brand_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in importance table: revenue per brand."""
    li = read(spark, sf_dir, "lineitem", "l_partkey", "l_extendedprice")
    p = read(spark, sf_dir, "part", "p_partkey", "p_brand")
    return (li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("variable"))
              .agg(F.round(F.sum("l_extendedprice"), 2).alias("relative_importance")))


# --------------------------------------------------------------------------
# DuckDB twins (oracle only).  Each is a list of CTEs joined with commas.
# --------------------------------------------------------------------------

_HOLIDAY_SQL = """CASE WHEN (month(d.Date)=1 AND day(d.Date)=1) OR (month(d.Date)=5 AND day(d.Date)=1)
                          OR (month(d.Date)=10 AND day(d.Date)=3) THEN 'a'
                     WHEN month(d.Date)=4 AND day(d.Date) BETWEEN 14 AND 17 THEN 'b'
                     WHEN month(d.Date)=12 AND day(d.Date) IN (25,26) THEN 'c'
                     WHEN day(d.Date)=15 THEN NULL ELSE '0' END"""

P1_SQL = f"""
bounds AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS Date FROM bounds),
od AS (SELECT c.c_nationkey AS Store, CAST(o.o_orderdate AS DATE) AS Date,
              round(sum(o.o_totalprice), 2) AS Sales, count(DISTINCT o.o_custkey) AS Customers,
              max(CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) AS Promo
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2),
p1 AS (SELECT CAST(n.n_nationkey AS INTEGER) AS Store, CAST(isodow(d.Date) AS INTEGER) AS DayOfWeek,
              d.Date, CAST(coalesce(od.Sales, 0) AS DOUBLE) AS Sales,
              CAST(coalesce(od.Customers, 0) AS INTEGER) AS Customers,
              CASE WHEN od.Customers IS NULL THEN 0 ELSE 1 END AS Open,
              CAST(coalesce(od.Promo, 0) AS INTEGER) AS Promo,
              {_HOLIDAY_SQL} AS StateHoliday,
              CASE WHEN month(d.Date) IN (7,8) OR (month(d.Date)=12 AND day(d.Date)>=23) THEN 1 ELSE 0 END AS SchoolHoliday
       FROM nation n CROSS JOIN days d LEFT JOIN od ON od.Store = n.n_nationkey AND od.Date = d.Date),
train AS (SELECT * FROM p1 WHERE Date < DATE '{TEST_START}'),
test AS (SELECT CAST(Store * 1000 + date_diff('day', DATE '{TEST_START}', Date) + 1 AS INTEGER) AS Id,
                Store, DayOfWeek, Date,
                CAST(CASE WHEN Store = {GAP_STORE} AND day(Date) % 5 = 0 THEN NULL ELSE Open END AS INTEGER) AS Open,
                Promo, StateHoliday, SchoolHoliday
         FROM p1 WHERE Date >= DATE '{TEST_START}')"""

STORE_SQL = f"""
custbal AS (SELECT c_nationkey, max(c_acctbal) AS maxbal FROM customer GROUP BY 1),
store AS (SELECT CAST(n.n_nationkey AS INTEGER) AS Store, chr(CAST(97 + n.n_regionkey % 4 AS INTEGER)) AS StoreType,
                 chr(CAST(97 + n.n_nationkey % 3 AS INTEGER)) AS Assortment,
                 CAST(CASE WHEN n.n_nationkey % 7 = 3 THEN NULL ELSE cb.maxbal END AS DOUBLE) AS CompetitionDistance,
                 CAST(CASE WHEN n.n_nationkey % 5 = 1 THEN NULL ELSE 1 + n.n_nationkey % 12 END AS INTEGER) AS CompetitionOpenSinceMonth,
                 CAST(CASE WHEN n.n_nationkey % 5 = 1 THEN NULL ELSE 1990 + n.n_nationkey % 9 END AS INTEGER) AS CompetitionOpenSinceYear,
                 CAST(n.n_nationkey % 2 AS INTEGER) AS Promo2,
                 CAST(CASE WHEN n.n_nationkey % 2 = 1 THEN 1 + (n.n_nationkey * 7) % 50 END AS INTEGER) AS Promo2SinceWeek,
                 CAST(CASE WHEN n.n_nationkey % 2 = 1 THEN 1996 + n.n_nationkey % 4 END AS INTEGER) AS Promo2SinceYear,
                 CASE WHEN n.n_nationkey % 2 = 1 THEN
                      CASE n.n_nationkey % 3 WHEN 0 THEN '{PROMO_INTERVALS[0]}' WHEN 1 THEN '{PROMO_INTERVALS[1]}'
                           ELSE '{PROMO_INTERVALS[2]}' END END AS PromoInterval
          FROM nation n LEFT JOIN custbal cb ON n.n_nationkey = cb.c_nationkey),
store_states AS (SELECT CAST(n.n_nationkey AS INTEGER) AS Store,
                        CASE WHEN r.r_regionkey = 4 THEN '{COMPOUND_STATE}' ELSE upper(substr(r.r_name, 1, 2)) END AS State
                 FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

P2_SQL = """
p2 AS (SELECT o_custkey AS Store, CAST(o_orderdate AS DATE) AS Date, o_orderkey AS Seq, o_totalprice AS Sales,
              CAST(o_orderpriority IN ('1-URGENT','2-HIGH') AS INTEGER) AS Promo,
              CAST(o_orderstatus = 'F' AS INTEGER) AS Open FROM orders)"""

P3_SQL = """
p3 AS (SELECT user_id AS Store, CAST(ts AS DATE) AS Date, round(sum(value), 2) AS Sales,
              CAST(count(*) AS INTEGER) AS Customers,
              max(CAST(event_type = 'purchase' AS INTEGER)) AS Promo
       FROM events GROUP BY 1, 2)"""

WEATHER_SQL = """
ship AS (SELECT upper(substr(r.r_name, 1, 2)) AS State, CAST(l.l_shipdate AS DATE) AS Date, l.l_quantity,
                l.l_discount, l.l_tax, l.l_returnflag
         FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
              JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
wnum AS (SELECT State, Date, round(avg(l_quantity), 4) AS Mean_TemperatureC,
                round(max(l_discount) * 100, 4) AS Max_Wind_SpeedKm_h, round(sum(l_tax), 4) AS Precipitationmm,
                CAST(count(*) AS INTEGER) AS Goog_trend FROM ship GROUP BY 1, 2),
wev AS (SELECT State, Date, first(l_returnflag ORDER BY cnt DESC, l_returnflag) AS Events
        FROM (SELECT State, Date, l_returnflag, count(*) AS cnt FROM ship GROUP BY 1, 2, 3) GROUP BY 1, 2),
weather AS (SELECT wnum.*, wev.Events FROM wnum JOIN wev USING (State, Date)),
trend_all AS (SELECT CAST(l_shipdate AS DATE) AS Date, CAST(count(*) AS INTEGER) AS Goog_trend_ALL
              FROM lineitem GROUP BY 1)"""


def sql_with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)
