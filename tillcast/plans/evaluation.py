"""Evaluators for Spark ML tuning: RMSPE as a first-class metric.

The reference passes RMSPE to its booster as a custom metric callback; here
it is an ``Evaluator`` (usable by ``CrossValidator`` / ``TrainValidationSplit``)
whose evaluation is one aggregate over the scored DataFrame.
"""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M


class RMSPEEvaluator(Evaluator):
    """Root mean squared percentage error (zero targets weigh 0, as the metric's weights do)."""

    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    logSpace = Param(Params._dummy(), "logSpace", "columns hold log1p values", TypeConverters.toBoolean)

    def __init__(self, predictionCol: str = "prediction", labelCol: str = "label", logSpace: bool = False):
        super().__init__()
        self._setDefault(predictionCol="prediction", labelCol="label", logSpace=False)
        self._set(predictionCol=predictionCol, labelCol=labelCol, logSpace=logSpace)

    def _evaluate(self, dataset: DataFrame) -> float:
        p, y = self.getOrDefault(self.predictionCol), self.getOrDefault(self.labelCol)
        metric = M.log_space_rmspe(p, y) if self.getOrDefault(self.logSpace) else M.weighted_rmspe(p, y)
        return float(dataset.agg(metric).first()[0])

    def isLargerBetter(self) -> bool:
        return False


def regression_metrics(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """MSE, RMSE, MAE, R2 and the number of rows, from one pass over the scores."""
    p, y = F.col(prediction), F.col(label)
    return scored.agg(M.mse(p, y).alias("mse"), F.sqrt(M.mse(p, y)).alias("rmse"), F.avg(F.abs(p - y)).alias("mae"),
                      M.r2(p, y).alias("r2"), F.count(F.lit(1)).alias("n"))
