"""Fitted tree ensembles as tables of nodes: staged scores and scores inside a row (ML9, AG15, UF5, ML22).

``compile_trees`` reads a fitted forest or boosted model into flat arrays, one
entry per node: feature, threshold (or the categories that go left), the two
children, the value.  A prediction walks those arrays with ``aggregate``, so
its plan has the same few operators for any number of trees, and it needs nothing
but an array of feature values.  That makes two things possible:

* **stages**: the score after each tree of a boosted model is a running sum, so
  one pass over a watch set gives the metric of every stage (``stage_curve``), the
  stage where patience ends the training (``best_stage``), and a model cut there
  (``CompiledTrees.first``);
* **recursion inside a row**: a whole horizon runs in one expression per store,
  where each day's prediction is a lag of the next (``recursive.compiled_forecast``).

The arrays are literals of the plan; a model has as many nodes as it was given,
whatever the data's size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..session import ensure_checkpoint_dir

CHUNK = 32  # stages that are summed one by one; chunks are then shifted by their totals


def _literal(values: list, kind: str) -> Column:
    """One literal array (folded when the plan is optimised)."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


@dataclass(frozen=True)
class CompiledTrees:
    """Trees of an ensemble in flat arrays; a leaf has feature -1."""

    feature: list[int]
    threshold: list[float]
    left_levels: list[list[float] | None]  # the categories that go left, for a split on categories
    left: list[int]
    right: list[int]
    value: list[float]
    roots: list[int]
    depth: int
    weights: list[float]

    def first(self, n: int) -> CompiledTrees:
        """The model of the first ``n`` trees (their weights unchanged)."""
        return replace(self, roots=self.roots[:n], weights=self.weights[:n])

    def contributions(self, x: Column) -> Column:
        """What each tree adds to the prediction for the feature array ``x``, in order."""
        feature, left, right = (_literal(v, "int") for v in (self.feature, self.left, self.right))
        threshold, value = _literal(self.threshold, "double"), _literal(self.value, "double")
        below = lambda n: F.get(x, F.get(feature, n)) <= F.get(threshold, n)
        if any(v is not None for v in self.left_levels):
            levels = _literal(self.left_levels, "array<double>")
            numeric = below
            below = lambda n: F.when(F.get(levels, n).isNull(), numeric(n)).otherwise(
                F.array_contains(F.get(levels, n), F.get(x, F.get(feature, n))))

        def step(n: Column, _: Column) -> Column:
            return F.when(F.get(feature, n) < 0, n).when(below(n), F.get(left, n)).otherwise(F.get(right, n))

        levels_down = F.sequence(F.lit(1), F.lit(self.depth)) if self.depth else F.array().cast("array<int>")
        leaf = lambda root: F.aggregate(levels_down, root, step)
        return F.zip_with(_literal(self.roots, "int"), _literal(self.weights, "double"),
                          lambda root, w: F.get(value, leaf(root)) * w)

    def predict(self, x: Column) -> Column:
        return F.aggregate(self.contributions(x), F.lit(0.0), lambda a, v: a + v)

    def staged(self, x: Column) -> Column:
        """Array of the predictions of the first 1, 2, ... trees."""
        def running(values: Column) -> Column:
            return F.aggregate(values, F.array().cast("array<double>"), lambda a, v: F.concat(
                a, F.array(v + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))

        def chunks(each: Column) -> Column:
            starts = F.sequence(F.lit(1), F.lit(max(len(self.roots), 1)), F.lit(CHUNK))
            return F.transform(starts, lambda i: running(F.slice(each, i, F.lit(CHUNK))))

        def shifted(parts: Column) -> Column:
            ends = running(F.transform(parts, lambda c: F.element_at(c, -1)))
            return _let(ends, lambda e: F.flatten(F.transform(parts, lambda c, j: F.transform(
                c, lambda v: v + F.coalesce(F.get(e, j - 1), F.lit(0.0))))))
        return _let(self.contributions(x), lambda each: _let(chunks(each), shifted))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def feature_array(assembled: str = "features") -> Column:
    return vector_to_array(F.col(assembled))


def compile_trees(model: Transformer) -> CompiledTrees:
    """Flat arrays of a fitted tree, forest or boosted model (or of a pipeline that ends in one).

    The model is saved in the shared checkpoint folder in Spark's own format, a
    table with a row per node, and read back from there.
    """
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    rows = saved.orderBy("tree", "id").collect()  # the model's own nodes
    roots, starts = [], {}
    for i, r in enumerate(rows):
        if r.tree not in starts:
            starts[r.tree] = i
            roots.append(i)
    level = [0] * len(rows)
    for i, r in enumerate(rows):  # children come after their parent
        for child in (r.leftChild, r.rightChild):
            if child >= 0:
                level[starts[r.tree] + child] = level[i] + 1
    weights = [float(w) for w in getattr(model, "treeWeights", [1.0])]
    if not hasattr(model, "treeWeights") or "Forest" in type(model).__name__:
        weights = [1.0 / len(roots)] * len(roots)  # a forest is the mean of its trees
    shift = lambda r, child: starts[r.tree] + child if child >= 0 else -1
    numeric = lambda r: r.split.featureIndex >= 0 and r.split.numCategories < 0
    return CompiledTrees(
        feature=[r.split.featureIndex for r in rows],
        threshold=[float(r.split.leftCategoriesOrThreshold[0]) if numeric(r) else 0.0 for r in rows],
        left_levels=[list(r.split.leftCategoriesOrThreshold) if r.split.numCategories >= 0 and r.split.featureIndex >= 0 else None
                     for r in rows],
        left=[shift(r, r.leftChild) for r in rows], right=[shift(r, r.rightChild) for r in rows],
        value=[float(r.prediction) for r in rows], roots=roots, depth=max(level, default=0), weights=weights)


def stage_curve(scored: DataFrame, trees: CompiledTrees, label: str, features: Column,
                metric: Callable[[Column, Column], Column] = M.log_space_rmspe) -> DataFrame:
    """(stage, metric): ``metric(prediction, label)`` after each tree, all stages from one pass."""
    rows = scored.select(F.col(label).alias("__y"), F.posexplode(trees.staged(features)).alias("__i", "__p"))
    return rows.groupBy((F.col("__i") + 1).alias("stage")).agg(metric(F.col("__p"), F.col("__y")).alias("metric"))


def best_stage(curve: DataFrame, patience: int | None = None) -> DataFrame:
    """One row: best_stage, best_metric (least metric, the earliest if it repeats) and stopped_at.

    With ``patience`` the training ends at the first stage that lies so many
    stages after the best one so far; later stages do not count.
    """
    so_far = Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)  # a row a tree
    seen = curve.withColumn("best", F.min(F.struct("metric", "stage")).over(so_far))
    if patience is not None:
        stop = F.min(F.when(F.col("stage") - F.col("best.stage") >= patience, F.col("stage"))).over(
            Window.orderBy("stage").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        seen = seen.withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("stage") <= F.col("stop")))
    last = seen.agg(F.max(F.struct("stage", "best")).alias("last"))
    return last.select(F.col("last.best.stage").alias("best_stage"), F.col("last.best.metric").alias("best_metric"),
                       F.col("last.stage").alias("stopped_at"))


def cut_at_best(model: Transformer, watch: DataFrame, label: str, features: Column, patience: int | None = None,
                metric: Callable[[Column, Column], Column] = M.log_space_rmspe) -> tuple[CompiledTrees, DataFrame]:
    """The model's first trees, as many as the watch set (already assembled) asks for, and the curve."""
    trees = compile_trees(model)
    curve = stage_curve(watch, trees, label, features, metric)
    return trees.first(best_stage(curve, patience).first().best_stage or len(trees.roots)), curve
