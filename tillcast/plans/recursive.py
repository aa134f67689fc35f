"""Recursive multi-day forecasts (ML22).

Each forecast day feeds the next day's lag features.  The state needed per
step is one small array per store, so:

* ``moving_average_forecast`` runs the whole horizon inside one
  ``aggregate`` higher-order function per store row (JVM side, no loop, no
  growing lineage);
* ``compiled_forecast`` does the same with a fitted forest or boosted model,
  compiled to a table of nodes (``trees``);
* ``model_forecast`` drives any fitted Spark ML model day by day; the state
  table (one row per store) is joined by store key, carries the predictions,
  and its lineage is cut with a reliable checkpoint every few steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .trees import CompiledTrees


def last_values(df: DataFrame, value: str, n: int, store: str = "Store", order: Sequence[str] = ("Date",),
                name: str = "state") -> DataFrame:
    """Per store, the last ``n`` values oldest first (a bounded array per store).

    The rank filter is planned as a group limit before the shuffle, so each
    task sends at most ``n`` rows of a store, however many it holds.  Give
    ``order`` enough columns to tell a store's rows apart.
    """
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(store).orderBy(*[F.col(c).desc() for c in order])
    tail = (df.select(store, *order, value).withColumn("__k", F.row_number().over(w))
              .filter(F.col("__k") <= n))
    return tail.groupBy(store).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(-F.col("__k"), F.col(value).alias("v")))),
                    lambda s: s["v"]).alias(name))


def moving_average_forecast(state: DataFrame, horizon: int, window: int, store: str = "Store",
                            state_col: str = "state") -> DataFrame:
    """pred_d = mean of the last ``window`` values, earlier predictions included."""
    def step(acc, _i):
        vals = acc["vals"]
        total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
        nxt = total / F.size(vals)
        return F.struct(F.slice(F.concat(vals, F.array(nxt)), 2, window).alias("vals"),
                        F.concat(acc["preds"], F.array(nxt)).alias("preds"))

    init = F.struct(F.col(state_col).alias("vals"), F.array().cast("array<double>").alias("preds"))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step)
    out = state.filter(F.size(state_col) == window).select(store, run["preds"].alias("preds"))
    return out.select(store, F.posexplode("preds").alias("step0", "pred")).select(
        store, (F.col("step0") + 1).alias("step"), "pred")


def model_forecast(state: DataFrame, model: Transformer, lag_cols: Sequence[str], horizon: int,
                   store: str = "Store", state_col: str = "state", checkpoint_every: int = 5,
                   assemble=None, daily: DataFrame | None = None, inverse=lambda p: p) -> DataFrame:
    """Day-by-day scoring: lag features from the state array, predict, roll.

    ``daily`` (store, step, columns) gives each day's own features; a store is
    not scored on a step without a row.  ``inverse`` turns a prediction back
    into the value that the next days' lags hold.

    The state table has one row per store and carries the predictions so far,
    so each step scores the model once; it is checkpointed (reliably, into
    the shared checkpoint folder) every few steps and exploded at the end.
    """
    n = len(lag_cols)
    cur = cut_lineage(state.select(store, state_col).withColumn("preds", F.array().cast("array<struct<step:int,pred:double>>")))
    daily = None if daily is None else cut_lineage(daily)
    for step in range(1, horizon + 1):
        feats = cur.select("*", *[F.col(state_col)[n - 1 - i].alias(c) for i, c in enumerate(lag_cols)])
        asked = F.lit(True)
        if daily is not None:
            today = daily.filter(F.col("step") == step).withColumnRenamed("step", "__step")
            feats, asked = feats.join(today, store, "left"), F.col("__step").isNotNull()
        if assemble is not None:
            feats = assemble(feats)
        scored = model.transform(feats).withColumn("pred", F.when(asked, inverse(F.col("prediction"))))
        rolled = F.when(asked, F.slice(F.concat(state_col, F.array("pred")), 2, n)).otherwise(F.col(state_col))
        listed = F.when(asked, F.concat("preds", F.array(F.struct(F.lit(step).alias("step"), "pred")))).otherwise(F.col("preds"))
        cur = scored.select(store, rolled.alias(state_col), listed.alias("preds"))
        if step % checkpoint_every == 0:
            cur = cut_lineage(cur)
    return cur.select(store, F.explode("preds").alias("p")).select(store, "p.step", "p.pred")


def compiled_forecast(state: DataFrame, trees: CompiledTrees, features: Sequence[str], lag_cols: Sequence[str],
                      daily: DataFrame, store: str = "Store", state_col: str = "state", inverse=lambda p: p) -> DataFrame:
    """The whole horizon in one expression per store row: (store, step, pred), one job.

    ``features`` names the model's inputs in order; those in ``lag_cols`` come
    from the state (newest last), the others from ``daily`` (store, step,
    columns), whose rows, at most one per step, are gathered per store.
    """
    own = [c for c in features if c not in lag_cols]
    days = daily.groupBy(store).agg(F.sort_array(F.collect_list(F.struct(
        "step", *[F.col(c).cast("double").alias(c) for c in own]))).alias("days"))

    def step(acc, day):
        vals = acc["vals"]
        lag = {c: F.try_element_at(vals, F.lit(-(i + 1))) for i, c in enumerate(lag_cols)}
        x = F.array(*[lag[c] if c in lag else day[c] for c in features])
        nxt = inverse(F.aggregate(F.array(x), F.lit(0.0), lambda _, held: trees.predict(held)))  # the array is built once
        grown = F.transform(F.array(nxt), lambda p: F.struct(
            F.slice(F.concat(vals, F.array(p)), 2, len(lag_cols)).alias("vals"),
            F.concat(acc["preds"], F.array(F.struct(day["step"].alias("step"), p.alias("pred")))).alias("preds")))
        return grown[0]

    init = F.struct(F.col(state_col).alias("vals"), F.array().cast("array<struct<step:int,pred:double>>").alias("preds"))
    run = F.aggregate("days", init, step)
    out = state.join(days.withColumn("days", F.transform("days", lambda d: d.withField("step", d["step"].cast("int")))), store)
    return out.select(store, F.explode(run["preds"]).alias("p")).select(store, "p.step", "p.pred")
