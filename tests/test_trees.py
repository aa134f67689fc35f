"""Compiled trees: predictions, stages, patience and forecasts inside a row, against Spark ML's own scoring."""

import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tillcast.functions import metrics as M
from tillcast.plans import models, recursive, trees


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(1200).select("id", (F.rand(1) * 10).alias("a"), (F.col("id") % 11).cast("string").alias("c"), F.rand(3).alias("b"))
    df = df.withColumn("y", F.sin("a") + F.ascii("c") % 3 + F.rand(9) + 1)
    return models.cut_lineage(df)


def fitted(rows, learner):
    index = StringIndexer(inputCol="c", outputCol="ci", handleInvalid="keep")
    return Pipeline(stages=[index, models.assembler(["a", "ci", "b"]), learner]).fit(rows)


@pytest.mark.parametrize("learner", [
    lambda: GBTRegressor(labelCol="y", maxIter=40, maxDepth=3, stepSize=0.3, seed=2),
    lambda: RandomForestRegressor(labelCol="y", numTrees=7, maxDepth=6, seed=2),
    lambda: DecisionTreeRegressor(labelCol="y", maxDepth=4), lambda: DecisionTreeRegressor(labelCol="y", maxDepth=0)], ids=["boosted", "forest", "tree", "root"])
def test_compiled_predictions_equal_the_model(rows, learner):
    model = fitted(rows, learner())
    unseen = rows.limit(5).withColumn("c", F.lit("new level")).withColumn("a", F.lit(float("nan")))
    scored = model.transform(rows.unionByName(unseen))
    got = scored.select("prediction", trees.compile_trees(model).predict(trees.feature_array()).alias("p")).collect()
    assert len(got) == 1205 and all(r.p == pytest.approx(r.prediction, rel=1e-12) for r in got)


def test_stages_equal_a_plain_loop(rows):
    learner = GBTRegressor(labelCol="y", maxIter=70, maxDepth=2, stepSize=0.4, seed=3, subsamplingRate=0.5)
    train, watch = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    model = fitted(train, learner)
    assembled = model.stages[1].transform(model.stages[0].transform(watch))
    compiled = trees.compile_trees(model)
    mse = trees.stage_curve(assembled, compiled, "y", trees.feature_array(), M.mse).orderBy("stage").collect()
    assert [r.stage for r in mse] == list(range(1, 71))
    assert [r.metric for r in mse] == pytest.approx(model.stages[-1].evaluateEachIteration(assembled, "squared"))
    # relative error, stage by stage with cut models
    curve = models.cut_lineage(trees.stage_curve(assembled, compiled, "y", trees.feature_array(), M.rmspe))
    got = {r.stage: r.metric for r in curve.collect()}
    for n in (1, 2, 31, 32, 33, 64, 70):
        cut = assembled.withColumn("p", compiled.first(n).predict(trees.feature_array()))
        assert got[n] == pytest.approx(cut.agg(M.rmspe("p", "y")).first()[0])
    best = trees.best_stage(curve).first()
    assert best.best_stage == min(got, key=lambda s: (got[s], s)) and best.stopped_at == 70
    for patience in (1, 3, 10):
        leader, stop = 1, 70
        for s in range(1, 71):
            leader = s if got[s] < got[leader] else leader
            if s - leader >= patience:
                stop = s
                break
        r = trees.best_stage(curve, patience).first()
        assert (r.best_stage, r.stopped_at) == (leader, stop)
    cut, again = trees.cut_at_best(model, assembled, "y", trees.feature_array(), 3, M.rmspe)
    assert len(cut.roots) == trees.best_stage(again, 3).first().best_stage


def test_forecast_in_a_row_equals_day_by_day(spark):
    lags, own = ["lag1", "lag2", "lag3"], ["Promo"]
    data = spark.range(600).select(*[(F.rand(i) * 5).alias(c) for i, c in enumerate(lags)], (F.col("id") % 2).alias("Promo"))
    data = models.cut_lineage(data.withColumn("y", F.log1p(F.col("lag1") * 0.7 + F.col("lag3") * 0.2 + F.col("Promo"))))
    names = ["lag1", "Promo", "lag2", "lag3"]
    asm = models.assembler(names)
    for learner in (RandomForestRegressor(labelCol="y", numTrees=5, maxDepth=5, seed=1), GBTRegressor(labelCol="y", maxIter=5, maxDepth=3)):
        model = learner.fit(asm.transform(data))
        state = spark.createDataFrame([(s, [1.0 + s % 3, 2.0, float(s % 5)]) for s in range(40)], "Store INT, state ARRAY<DOUBLE>")
        days = spark.range(1, 13).crossJoin(spark.range(40).withColumnRenamed("id", "s")).select(
            F.col("s").cast("int").alias("Store"), F.col("id").cast("int").alias("step"), ((F.col("id") + F.col("s")) % 2).alias("Promo"))
        days = days.filter("not (Store = 7 and step > 4) and not (Store = 8 and step in (3, 4))")  # one store ends early, one has a gap
        back = lambda p: F.greatest(F.expm1(p), F.lit(0.0))
        slow = recursive.model_forecast(state, model, lags, 12, assemble=asm.transform, daily=days, inverse=back)
        fast = recursive.compiled_forecast(state, trees.compile_trees(model), names, lags, days, inverse=back)
        want = {(r.Store, r.step): r.pred for r in slow.collect()}
        got = {(r.Store, r.step): r.pred for r in fast.collect()}
        assert want.keys() == got.keys() and len(got) == 40 * 12 - 8 - 2
        assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in got)
