"""Fitted feature steps: values, folds, unseen levels, and equal scores after loading in another process."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tillcast.functions import metrics as M
from tillcast.operators import split
from tillcast.plans import models, steps

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def panel(spark):
    """1,500 stores with an effect of their own that nothing else tells."""
    df = spark.range(30_000).select((F.col("id") % 1500).cast("int").alias("Store"), F.floor(F.col("id") / 1500).cast("int").alias("day"))
    effect = F.pmod(F.xxhash64("Store"), F.lit(1000)) / 250.0
    kind = F.element_at(F.array(*map(F.lit, "abcd")), (F.col("Store") % 4 + 1).cast("int"))
    df = df.withColumns({"kind": kind, "promo": F.col("day") % 2, "logSales": 5 + effect + F.col("day") % 2 * 0.3 + F.rand(3) * 0.2})
    return models.cut_lineage(df.withColumn("fold", split.fold_of(F.concat_ws("|", "Store", "day"), 5)))


def test_means_of_other_folds_and_own_value_for_unseen_levels(spark, panel):
    small = panel.filter("Store < 30")
    once = small.limit(1).select(F.lit(9999).alias("Store"), *[c for c in small.columns if c != "Store"])  # a level in one fold only
    train = models.cut_lineage(small.unionByName(once))
    model = steps.TargetMeans(keys=["Store"], labelCol="logSales", outputCol="m", folds=5).fit(train)
    rows = train.collect()
    for r in model.transform(train).collect():
        others = [x.logSales for x in rows if x.Store == r.Store and x.fold != r.fold]
        if others:
            assert r.m == pytest.approx(sum(others) / len(others))
        else:
            assert r.Store == 9999 and r.m == model.getOrDefault("unseen")
    new = model.transform(train.drop("fold").unionByName(train.limit(1).drop("fold").withColumn("Store", F.lit(-1)))).collect()
    means = {s: [x.logSales for x in rows if x.Store == s] for s in {x.Store for x in rows}}
    for r in new:
        want = sum(means[r.Store]) / len(means[r.Store]) if r.Store in means else model.getOrDefault("unseen")
        assert r.m == pytest.approx(want)
    assert model.getOrDefault("unseen") < min(sum(v) / len(v) for v in means.values())


def test_forest_with_the_store_beats_one_without(panel):
    fit, late = panel.filter("day < 15"), panel.filter("day >= 15").drop("fold")
    scores = {}
    for name in ("without", "means", "levels"):
        feats, extra, bins = ["promo", "day"], [], 32
        if name == "means":
            extra, feats = [steps.TargetMeans(keys=["Store"], labelCol="logSales", outputCol="m")], [*feats, "m"]
        elif name == "levels":  # every store a category of the tree itself
            extra, bins = [models.category_indexer("Store")], 1600
            feats = [*feats, "Store_idx"]
        rf = RandomForestRegressor(labelCol="logSales", numTrees=5, maxDepth=6, maxBins=bins, seed=1, featureSubsetStrategy="all")
        model = Pipeline(stages=[*extra, models.assembler(feats), rf]).fit(fit)
        scores[name] = model.transform(late).agg(M.rmspe(F.expm1("prediction"), F.expm1("logSales"))).first()[0]
        unseen = model.transform(late.limit(3).withColumn("Store", F.lit(1_000_000)))
        assert unseen.filter("prediction is not null and not isnan(prediction)").count() == 3
    assert scores["means"] < 0.5 * scores["without"] and scores["levels"] < 0.5 * scores["without"], scores


def test_codes_dummies_and_scales(spark, panel):
    one = panel.filter("Store < 8")
    codes = steps.LevelCodes(inputCol="kind", outputCol="code").fit(one)
    odd = spark.createDataFrame([("a", 1.0), ("z", 2.0), (None, None)], "kind STRING, v DOUBLE")
    assert [r.code for r in codes.transform(odd).collect()] == [1, 5, None]
    d = steps.Dummies(inputCol="kind").fit(one).transform(odd)
    assert d.columns == ["kind", "v", "kind_b", "kind_c", "kind_d"] and [r.kind_b for r in d.collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        steps.Dummies(inputCol="Store", maxLevels=7).fit(one)
    values = spark.createDataFrame([(float(x),) for x in range(6)], "v DOUBLE")
    std = steps.Scaler(inputCols=["v"]).fit(values).transform(values).collect()
    assert [r.v_scaled for r in std] == pytest.approx([(x - 2.5) / 3.5 ** 0.5 for x in range(6)])
    mm = steps.Scaler(inputCols=["v"], kind="minmax", suffix="_n").fit(values).transform(values).collect()
    assert [r.v_n for r in mm] == pytest.approx([0, .2, .4, .6, .8, 1])
    flat = values.withColumn("v", F.lit(3.0))
    assert steps.Scaler(inputCols=["v"]).fit(flat).transform(flat).filter("v_scaled is not null").count() == 0


def test_loaded_pipeline_scores_alike_in_another_process(spark, panel, tmp_path):
    train = panel.filter("Store < 60")
    feats = ["promo", "m", "code", "kind_b", "kind_c", "kind_d", "day_scaled"]
    model = Pipeline(stages=[
        steps.TargetMeans(keys=["Store", "promo"], labelCol="logSales", outputCol="m", smoothing=3.0),
        steps.LevelCodes(inputCol="kind", outputCol="code"), steps.Dummies(inputCol="kind"), steps.Scaler(inputCols=["day"]),
        models.assembler(feats), RandomForestRegressor(labelCol="logSales", numTrees=3, maxDepth=4, seed=1)]).fit(train)
    new = train.drop("fold", "logSales").limit(200).unionByName(train.limit(2).select(
        F.lit(-5).alias("Store"), "day", F.lit("zz").alias("kind"), "promo"))
    new = models.cut_lineage(new)
    want = {(r.Store, r.day): r.prediction for r in model.transform(new).collect()}
    model.write().save(str(tmp_path / "model"))
    new.write.parquet(str(tmp_path / "rows"))
    assert {(r.Store, r.day): r.prediction for r in PipelineModel.load(str(tmp_path / "model")).transform(new).collect()} == want
    code = ("import sys, json; sys.path.insert(0, sys.argv[2]); from tillcast.session import get_session; from pyspark.ml import PipelineModel\n"
            "spark = get_session('local[2]', 2); out = PipelineModel.load(sys.argv[1] + '/model').transform(spark.read.parquet(sys.argv[1] + '/rows'))\n"
            "print('GOT', json.dumps([[r.Store, r.day, r.prediction] for r in out.collect()]))")
    said = subprocess.run([sys.executable, "-c", code, str(tmp_path), ROOT], capture_output=True, text=True, timeout=200)
    got = json.loads(said.stdout.split("GOT ", 1)[1])
    assert {(s, d): p for s, d, p in got} == want
