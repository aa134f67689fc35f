"""The feature table of the main munging script, as one lazy Spark plan.

Stages: impute test ``Open`` -> tag and union train/test -> calendar block ->
repair codes and ``Open`` -> states -> target means (fitted on training rows)
-> weather, trends, release series -> promo, closure and refurbishment
windows plus lag/lead banks -> split by tag on write.

Plan shape: the panel is exchanged once on ``Store``; every window stage
shares the (Store, Date) specification, so Spark sorts once and chains the
Window operators.  Side series are keyed by day or (state, day), bounded by
the calendar; AQE broadcasts them after measuring them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import scalars as S
from ..operators import clean, joins, stats, windows
from ..sources import panels

# lag/lead depths of the feature banks (columns and offsets).
OPEN_BANK = list(range(1, 15)) + [-k for k in range(1, 15)]
WEATHER_BANKS = {
    "Mean_TemperatureC": list(range(1, 15)) + [-1, -2, -3],
    "Max_Wind_SpeedKm_h": list(range(1, 8)) + [-1, -2, -3],
    "Precipitationmm": list(range(1, 8)) + [-1, -2, -3],
    "Events": list(range(1, 15)) + [-1, -2, -3],
}


def feature_table(spark: SparkSession, sf_dir: str, with_weather: bool = True, style: str = "suffix",
                  blocked: bool = False, fit_before: str | None = None) -> DataFrame:
    """All rows with all features; ``fit_before``: target means of training rows before that day only."""
    data = panels.p1_all(spark, sf_dir)                      # train + test, tagged, one pass
    data = clean.fill_open(data, 1)
    data = data.select("*", *C.calendar_columns("Date"))
    data = data.withColumn("StateHoliday", S.standard_holiday("StateHoliday"))
    data = clean.open_rule_sales(data)
    data = joins.join_on(data, panels.store_states(spark, sf_dir), "Store")
    if with_weather:
        # side series are keyed by (state, day) / day: calendar-bounded, joined
        # before the store exchange; AQE broadcasts them after measuring them
        w = panels.weather(spark, sf_dir).withColumnRenamed("State", "__key")
        data = (data.withColumn("__key", S.remap_state(F.col("State"), panels.COMPOUND_STATE, "MI"))
                    .join(w, ["__key", "Date"], "left").drop("__key"))
        data = joins.join_on(data, panels.trend_all(spark, sf_dir), "Date", "left")
        _, last = panels.calendar_bounds(spark, sf_dir)
        daily = joins.step_series_daily(panels.releases(spark, sf_dir), "Released", ["Actual"], last)
        data = joins.join_on(data, daily, "Date", "left")
    train_rows = F.col("type") == "train"
    if fit_before is not None:
        train_rows &= F.col("Date") < F.lit(fit_before).cast("date")
    if not blocked:
        # one exchange on Store; every later window only sorts locally
        data = data.repartition("Store")
        data = windows.group_means_over(data, stats.TARGET_MEANS, "Sales", fit=train_rows)
    else:
        # a store may be arbitrarily large: partial aggregates + joins (AQE
        # splits a hot key on the big side) instead of store-keyed windows
        data = stats.attach_target_means(data, fit_on=data.filter(train_rows))
    banks = {"Open": OPEN_BANK, **(WEATHER_BANKS if with_weather else {})}
    reach = max(abs(k) for offs in banks.values() for k in offs)

    def first_pass(_w, off):
        # promo runs, every lag/lead bank and the refurb flags: one Window operator
        cols = windows.promo_exprs(off)
        for col, offs in banks.items():
            cols += windows.lag_exprs(off, [col], offs, style)
        return cols + windows.refurb_flag_exprs(off)

    def counters(_w, off):
        return windows.refurb_counter_exprs(off)

    # two passes (counters read the flags), one numbering / exchange
    return windows.with_panel_windows(data, [first_pass, counters], reach=reach + 15, blocked=blocked)


def write_by_type(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per tag (type=train / type=test)."""
    df.write.mode("overwrite").partitionBy("type").format(fmt).save(path)
