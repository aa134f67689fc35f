"""Feature steps that are fitted, kept with the model and loaded with it (PF6, RS1, RS2, RS3, RS8, RS9, IO10).

Each step is an ``Estimator`` whose ``Model`` carries all that scoring needs, so a
saved ``PipelineModel`` scores new rows without the training rows:

* ``TargetMeans``: a category of any number of levels becomes the mean target of
  its level.  Training rows name their fold and get the mean of the *other* folds;
  rows without a fold (new ones) get the mean of all training rows.  A level
  without a mean gets a value of its own, below all means, also in training.
* ``LevelCodes``: level -> code from 1, in level order; unseen levels share the next code.
* ``Dummies``: indicator columns of the levels seen in training, so that columns
  a scoring table lacks are there as 0.
* ``Scaler``: standardised (sample sd) or min-max scaled columns.

State that grows with the levels is a table, fitted by partial aggregates, joined
by key and saved as Parquet beside the parameters; nothing of it passes the driver.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import numbered
from ..session import cut_lineage


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        instance.table = self.sparkSession.read.parquet(f"{path}/table")
        return instance


class _TableModel(Model, MLReadable, MLWritable):
    """A model whose state is a table."""

    table: DataFrame | None = None

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def _fitted(self, estimator: Params, table: DataFrame):
        estimator._copyValues(self)
        self.table = table
        return self


class _MeansParams(Params):
    keys = Param(Params._dummy(), "keys", "columns that make a level", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column to make", TypeConverters.toString)
    foldCol = Param(Params._dummy(), "foldCol", "fold of a training row, null or absent for new rows", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "number of folds", TypeConverters.toInt)
    smoothing = Param(Params._dummy(), "smoothing", "rows of the overall mean added to each level", TypeConverters.toFloat)
    unseen = Param(Params._dummy(), "unseen", "value of a level without a mean", TypeConverters.toFloat)

    def _set_all(self, kwargs):
        self._setDefault(foldCol="fold", folds=5, smoothing=0.0, unseen=0.0)
        return self._set(**kwargs)


class TargetMeans(Estimator, _MeansParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, keys=None, labelCol=None, outputCol=None, foldCol="fold", folds=5, smoothing=0.0):
        super().__init__()
        self._set_all(self._input_kwargs)

    def _fit(self, df: DataFrame) -> TargetMeansModel:
        keys, label, folds = self.getOrDefault(self.keys), self.getOrDefault(self.labelCol), self.getOrDefault(self.folds)
        m, fold = self.getOrDefault(self.smoothing), self.getOrDefault(self.foldCol)
        if fold not in df.columns:
            df = df.withColumn(fold, F.lit(None).cast("int"))
        rows = df.filter(F.col(label).isNotNull())
        each = [f"s{i}" for i in range(folds)] + [f"n{i}" for i in range(folds)]
        mine = [F.when(F.col(fold) == i, F.col(label).cast("double")) for i in range(folds)]
        sums = rows.groupBy(*keys).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"),
                                       *[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(mine)],
                                       *[F.count(x).alias(f"n{i}") for i, x in enumerate(mine)])
        prior = rows.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
        # a level's means: of all rows (fold null) and without each fold
        whole = F.struct(F.lit(None).cast("int").alias("__fold"), F.col("s").alias("s"), F.col("n").alias("n"))
        others = [F.struct(F.lit(i).alias("__fold"), (F.col("s") - F.col(f"s{i}")).alias("s"), (F.col("n") - F.col(f"n{i}")).alias("n"))
                  for i in range(folds)]
        long = sums.withColumn("__m", F.explode(F.array(whole, *others))).drop("s", "n", *each)
        mean = F.when(F.col("__m.n") > 0, (F.col("__m.s") + m * prior) / (F.col("__m.n") + m))
        table = cut_lineage(long.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__m.__fold", mean.alias("__mean")))
        low, high = table.agg(F.min("__mean"), F.max("__mean")).first()
        below = 0.0 if low is None else low - max(high - low, abs(low), 1.0)
        model = TargetMeansModel()._fitted(self, table)
        return model._set(unseen=below)


class TargetMeansModel(_TableModel, _MeansParams):
    def __init__(self):
        super().__init__()
        self._set_all({})

    def _transform(self, df: DataFrame) -> DataFrame:
        keys, out, fold = self.getOrDefault(self.keys), self.getOrDefault(self.outputCol), self.getOrDefault(self.foldCol)
        of = F.col(fold).cast("int") if fold in df.columns else F.lit(None).cast("int")
        same = F.col("__of").eqNullSafe(F.col("__fold"))
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
        got = df.withColumn("__of", of).join(self.table, same, "left")
        value = F.coalesce("__mean", F.lit(self.getOrDefault(self.unseen)))
        return got.withColumn(out, value).select(*[c for c in df.columns if c != out], out)


class _CodeParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "column of levels", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column to make", TypeConverters.toString)
    unseen = Param(Params._dummy(), "unseen", "code of an unseen level", TypeConverters.toInt)


class LevelCodes(Estimator, _CodeParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LevelCodesModel:
        col = self.getOrDefault(self.inputCol)
        levels = df.select(F.col(col).alias("__level")).filter(F.col("__level").isNotNull()).distinct()
        table = cut_lineage(numbered(levels, "__level", name="__code").withColumn("__code", (F.col("__code") + 1).cast("int")))
        return LevelCodesModel()._fitted(self, table)._set(unseen=table.count() + 1)


class LevelCodesModel(_TableModel, _CodeParams):
    def _transform(self, df: DataFrame) -> DataFrame:
        col, out = self.getOrDefault(self.inputCol), self.getOrDefault(self.outputCol)
        got = df.join(self.table, F.col(col) == F.col("__level"), "left")
        code = F.when(F.col(col).isNotNull(), F.coalesce("__code", F.lit(self.getOrDefault(self.unseen))))
        return got.withColumn(out, code).select(*[c for c in df.columns if c != out], out)


class _DummyParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "column of levels", TypeConverters.toString)
    prefix = Param(Params._dummy(), "prefix", "of the columns made", TypeConverters.toString)
    dropFirst = Param(Params._dummy(), "dropFirst", "no column for the first level", TypeConverters.toBoolean)
    maxLevels = Param(Params._dummy(), "maxLevels", "most levels that become columns", TypeConverters.toInt)
    levels = Param(Params._dummy(), "levels", "levels seen in training, as text", TypeConverters.toListString)


class Dummies(Estimator, _DummyParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol=None, prefix=None, dropFirst=True, maxLevels=1000):
        super().__init__()
        self._setDefault(dropFirst=True, maxLevels=1000)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> DummiesModel:
        col, most = self.getOrDefault(self.inputCol), self.getOrDefault(self.maxLevels)
        found = df.select(F.col(col).cast("string").alias("v")).filter("v is not null").distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{col} has more than {most} levels; use TargetMeans or LevelCodes")
        return self._copyValues(DummiesModel())._set(levels=sorted(r.v for r in found))


class DummiesModel(Model, _DummyParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(dropFirst=True, maxLevels=1000)

    def _transform(self, df: DataFrame) -> DataFrame:
        col = self.getOrDefault(self.inputCol)
        prefix = self.getOrDefault(self.prefix) if self.isDefined(self.prefix) else col
        kept = self.getOrDefault(self.levels)[1 if self.getOrDefault(self.dropFirst) else 0:]
        is_level = lambda v: F.coalesce(F.col(col).cast("string") == v, F.lit(False)).cast("int")
        return df.withColumns({f"{prefix}_{v}": is_level(v) for v in kept}) if kept else df


class _ScaleParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale", TypeConverters.toListString)
    suffix = Param(Params._dummy(), "suffix", "of the columns made", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "standard or minmax", TypeConverters.toString)
    shift = Param(Params._dummy(), "shift", "taken off each column", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "divides each column", TypeConverters.toListFloat)


class Scaler(Estimator, _ScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, suffix="_scaled", kind="standard"):
        super().__init__()
        self._setDefault(suffix="_scaled", kind="standard")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ScalerModel:
        cols, standard = self.getOrDefault(self.inputCols), self.getOrDefault(self.kind) == "standard"
        shift = [(F.avg if standard else F.min)(c).cast("double") for c in cols]
        scale = [(F.stddev_samp(c) if standard else F.max(c) - F.min(c)).cast("double") for c in cols]
        got = [float(x) if x is not None else 0.0 for x in df.agg(*shift, *scale).first()]
        return self._copyValues(ScalerModel())._set(shift=got[:len(cols)], scale=got[len(cols):])


class ScalerModel(Model, _ScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    """Columns without spread become null."""

    def __init__(self):
        super().__init__()
        self._setDefault(suffix="_scaled", kind="standard")

    def _transform(self, df: DataFrame) -> DataFrame:
        state = zip(self.getOrDefault(self.inputCols), self.getOrDefault(self.shift), self.getOrDefault(self.scale))
        suffix = self.getOrDefault(self.suffix)
        return df.withColumns({c + suffix: F.try_divide(F.col(c) - F.lit(a), F.lit(b)) for c, a, b in state})
