"""Group-mean base learners and the prepared panels the plans share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions.metrics import exact_mean
from ..sources import panels

# The base learners' key sets (store/promo mean, + month, + weekday).
BASE_LEARNERS = {
    "p1": ("Store", "Promo"),
    "p2": ("Store", "Promo", "month"),
    "p3": ("Store", "Promo", "DayOfWeek"),
}
# Four side learners of the blend grid beside the main one (p3).
SIDE_LEARNERS = {"p1": BASE_LEARNERS["p1"], "p2": BASE_LEARNERS["p2"], "p4": ("Store",), "p5": ("Store", "DayOfWeek")}
# Fixed value: the honest holdout starts here (fit before, score from).
HOLDOUT_START = "2000-06-01"


def fit_group_mean(train: DataFrame, keys: Sequence[str], target: str = "Sales", name: str = "pred") -> DataFrame:
    return train.dropna(subset=list(keys)).groupBy(*keys).agg(exact_mean(target).alias(name))


def sales_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with positive sales and a month column."""
    t = panels.p1_train(spark, sf_dir)
    return t.filter(F.col("Sales") > 0).withColumn("month", C.month("Date"))


def base_predictions(df: DataFrame, fit_on: DataFrame, target: str = "Sales",
                     learners: dict[str, Sequence[str]] = BASE_LEARNERS) -> DataFrame:
    """Add one column for each learner: group means fitted on ``fit_on``.

    Partial aggregates and joins: a store that holds many rows is neither
    sorted nor buffered in one task.
    """
    out = df
    for name, keys in learners.items():
        out = out.join(fit_group_mean(fit_on, keys, target, name), list(keys), "left")
    return out


def holdout_frame(spark: SparkSession, sf_dir: str, learners: dict[str, Sequence[str]] = BASE_LEARNERS) -> DataFrame:
    """Holdout rows (positive sales, from HOLDOUT_START) with honest predictions."""
    t = sales_train(spark, sf_dir)
    cut = F.lit(HOLDOUT_START).cast("date")
    return base_predictions(t.filter(F.col("Date") >= cut), t.filter(F.col("Date") < cut), learners=learners)


SIDES_SQL = """
m4 AS (SELECT Store, round(sum(Sales), 2) / count(Sales) AS p4 FROM fit GROUP BY ALL),
m5 AS (SELECT Store, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p5 FROM fit GROUP BY ALL),
h5 AS (SELECT hold.*, m4.p4, m5.p5 FROM hold LEFT JOIN m4 USING (Store) LEFT JOIN m5 USING (Store, DayOfWeek)
       WHERE Sales <> 0),
h AS (SELECT * FROM h5 WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AND p4 IS NOT NULL AND p5 IS NOT NULL)"""

HOLDOUT_SQL = f"""
st AS (SELECT *, CAST(month(Date) AS INTEGER) AS month FROM train WHERE Sales > 0),
fit AS (SELECT * FROM st WHERE Date < DATE '{HOLDOUT_START}'),
m1 AS (SELECT Store, Promo, round(sum(Sales), 2) / count(Sales) AS p1 FROM fit GROUP BY ALL),
m2 AS (SELECT Store, Promo, month, round(sum(Sales), 2) / count(Sales) AS p2 FROM fit GROUP BY ALL),
m3 AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p3 FROM fit GROUP BY ALL),
hold AS (SELECT st.*, m1.p1, m2.p2, m3.p3 FROM st
         LEFT JOIN m1 USING (Store, Promo) LEFT JOIN m2 USING (Store, Promo, month)
         LEFT JOIN m3 USING (Store, Promo, DayOfWeek)
         WHERE st.Date >= DATE '{HOLDOUT_START}')"""
