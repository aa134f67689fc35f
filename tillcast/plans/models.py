"""Spark ML jobs: tree ensembles on log sales, importances, subsets, stacking,
seed averaging and k-fold out-of-fold scoring (ML6-ML10, ML14-ML16, ML18,
ML20, ML21).

Trees are trained by Spark ML (level-wise, distributed histogram
aggregation); inputs are assembled once and cached for multi-model runs.
Category ids with many levels (stores) enter as target means (Sales_*_avg)
rather than raw ids, which also keeps ``maxBins`` small at scale.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import scalars as S
from ..operators import split, stats
from ..session import cut_lineage
from ..sources import panels
from . import features
from .forecast import HOLDOUT_START

# Parameters of the reference's runs, by trees, depth and step size
# (its forests of depth 40 and 50 are left out: Spark's trees end at depth 30).
FOREST_PRESETS = {"rf_100_30": dict(trees=100, depth=30), "rf_200_30": dict(trees=200, depth=30)}
GBT_PRESETS = {"gbm_15_05_50": dict(iters=50, depth=15, step=0.05),
               "gbm_15_05_200": dict(iters=200, depth=15, step=0.05),
               "gbm_20_05_300": dict(iters=300, depth=20, step=0.05),
               "gbm_20_03_800": dict(iters=800, depth=20, step=0.03),
               "gbm_12_05_800": dict(iters=800, depth=12, step=0.05),
               "xgb_2_8_900": dict(iters=900, depth=8, step=0.2),
               "xgb_2_8_700": dict(iters=700, depth=8, step=0.2),
               "xgb_5_10_60": dict(iters=60, depth=10, step=0.5)}

NUMERIC_FEATURES = ["DayOfWeek", "Promo", "SchoolHoliday", "year", "month", "day", "day_of_year", "weeknum",
                    "StoreType_o", "Assortment_o", "CompetitionDistance", "Promo2", "PromoInterval_c",
                    "Sales_all_avg", "Sales_month_avg", "Sales_day_avg"]
LABEL = "logSales"


def model_frame(spark: SparkSession, sf_dir: str, include_test: bool = False,
                fit_before: str | None = HOLDOUT_START) -> DataFrame:
    """Open training days with features; target means fitted before ``fit_before`` (None: on all of them)."""
    tr = panels.p1_train(spark, sf_dir)
    st = panels.store_table(spark, sf_dir)
    base = tr.filter(F.col("Sales") > 0)
    if include_test:
        base = base.unionByName(panels.p1_test(spark, sf_dir).fillna({"Open": 1}), allowMissingColumns=True)
    df = base.select("*", *C.calendar_columns("Date")).join(st, "Store")
    df = df.select("*", S.letter_ordinal("StoreType").alias("StoreType_o"),
                   S.letter_ordinal("Assortment").alias("Assortment_o"),
                   S.promo_interval_code("PromoInterval").alias("PromoInterval_c"),
                   S.log1p_target("Sales").alias(LABEL))
    fit = F.col("Sales").isNotNull()
    if fit_before is not None:
        fit &= F.col("Date") < F.lit(fit_before).cast("date")
    df = stats.attach_target_means(df, fit_on=df.filter(fit))  # partial aggregates: safe for a hot store
    return df.fillna({"CompetitionDistance": 75000.0})


# Columns of the plain feature builder, in the reference's order.
PLAIN_FEATURES = ["Store", "CompetitionDistance", "CompetitionOpenSinceMonth", "CompetitionOpenSinceYear", "Open",
                  "Promo", "Promo2", "Promo2SinceWeek", "Promo2SinceYear", "SchoolHoliday", "StateHoliday", "DayOfWeek",
                  "month", "day", "year", "StoreType", "Assortment"]


def build_features(df: DataFrame) -> tuple[list[str], DataFrame]:
    """Plain features of a panel joined with its stores: (names, frame with them), as one projection.

    Missing values become 0 (a missing ``Open`` too, since zeros come first in
    the reference); letter codes become ordinals; dates become parts.
    """
    parts = {"month": C.month, "day": C.day, "year": C.year}
    letters = {"StateHoliday": S.code_map("StateHoliday", {k: v for k, v in S.LETTER_ORDINALS.items() if k != "d"}, 0),
               "StoreType": S.letter_ordinal("StoreType"), "Assortment": S.letter_ordinal("Assortment")}
    numbers = [c for c in PLAIN_FEATURES if c not in parts and c not in letters]
    df = df.fillna(0, subset=numbers)
    made = {c: f("Date").cast("double") for c, f in parts.items()} | {c: e.cast("double") for c, e in letters.items()}
    made["SchoolHoliday"] = F.col("SchoolHoliday").cast("double")
    return list(PLAIN_FEATURES), df.withColumns(made)


# Columns of the feature table that are no features: keys, targets, tags, and what is known only afterwards.
NOT_FEATURES = ["Id", "Date", "Sales", "Customers", "type", LABEL, "fold", "Store"]
MAX_LEVELS = 1000  # of a text column that becomes codes
MISSING = -9999.0  # below all values: a tree can split it off


def feature_frame(spark: SparkSession, sf_dir: str, fit_before: str | None = HOLDOUT_START,
                  include_test: bool = False) -> tuple[DataFrame, list[str]]:
    """(open days of the whole feature table with store attributes and log sales, names of all its features).

    Lag and lead banks, weather, promotion and refurbishment flags all reach
    the models; text columns (states, weather events and their lags) become
    codes in level order, 0 for missing or unseen; other missing values become
    ``MISSING``.  ``Store`` itself is left to
    ``steps.TargetMeans`` or ``category_indexer``.
    """
    table = features.feature_table(spark, sf_dir, fit_before=fit_before)
    table = table.join(panels.store_table(spark, sf_dir), "Store", "left")
    kept = (F.col("type") == "train") & (F.col("Sales") > 0)
    table = table.filter(kept | (F.col("type") == "test") if include_test else kept)
    table = cut_lineage(table.withColumn(LABEL, S.log1p_target("Sales")))  # read for the levels, then by the fits
    texts = [f.name for f in table.schema.fields if f.dataType.simpleString() == "string" and f.name != "type"]
    stems = sorted({c.split("_l")[0] for c in texts})  # a bank shares the levels of its column
    sources = [c for c in stems if c in texts]
    found = table.agg(*[F.slice(F.sort_array(F.collect_set(c)), 1, MAX_LEVELS).alias(c) for c in sources]).first().asDict()
    code = lambda c: F.coalesce(F.array_position(F.lit(found[c.split("_l")[0]]), F.col(c)), F.lit(0)).cast("int")
    table = table.withColumns({c: code(c) if found[c.split("_l")[0]] else F.lit(0) for c in texts})
    names = [c for c in table.columns if c not in NOT_FEATURES]
    return table.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in names}), names


def preset(name: str, names: Sequence[str], seed: int = 7) -> Pipeline:
    """One of the reference's own runs (``GBT_PRESETS``, ``FOREST_PRESETS``) over the given features."""
    if name in FOREST_PRESETS:
        return forest(names, seed=seed, **FOREST_PRESETS[name])
    return boosted(names, seed=seed, **GBT_PRESETS[name])


ROWS_PER_TASK = 10_000  # of a fit: fewer make each level of each tree a round of tiny tasks


def training_input(df: DataFrame, keys: Sequence[str] = ("Store", "Date"), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows spread evenly (by a hash of store and day) and stored once for iterative fits.

    As many partitions as the rows ask for.  The frame is kept in the shared
    checkpoint folder, so it needs no cache to release and a lost executor does
    not rebuild the features.
    """
    stored = cut_lineage(df)
    n = max(1, -(-stored.count() // rows_per_task))
    # a stated number, which adaptive execution does not merge: each fitting pass runs on all of them
    return cut_lineage(stored.repartition(n, *keys))


def fit_many(frame: DataFrame, fits: dict[str, Pipeline], at_once: int = 4) -> dict[str, PipelineModel]:
    """Independent fits over one stored frame, ``at_once`` of them side by side.

    A tree fit is a sequence of short jobs that leaves most of a cluster idle;
    fits that do not depend on one another fill it, as in cross-validation.
    """
    spark = frame.sparkSession
    with ThreadPool(max(1, min(at_once, len(fits)))) as pool:
        run = inheritable_thread_target(spark)(lambda item: (item[0], item[1].fit(frame)))
        return dict(pool.map(run, list(fits.items()), chunksize=1))


def binned(frame: DataFrame, names: Sequence[str], bins: int = 32) -> tuple[Bucketizer, DataFrame]:
    """(step that replaces features by quantile bins ``{name}_b``, training frame with them, stored).

    The cuts of all features come from one aggregation; fits on any subset then
    share the stored bins, and the step goes into each model's pipeline for scoring.
    """
    q = [i / bins for i in range(1, bins)]
    row = frame.agg(*[F.percentile_approx(F.col(c).cast("double"), q, 10_000).alias(f"q{i}") for i, c in enumerate(names)]).first()
    edge = float("inf")
    cuts = [[-edge, *sorted(set(x or [0.0])), edge] for x in row]
    step = Bucketizer(splitsArray=cuts, inputCols=list(names), outputCols=[f"{c}_b" for c in names], handleInvalid="keep")
    numeric = frame.select("*").withColumns({c: F.col(c).cast("double") for c in names})
    return step, training_input(step.transform(numeric))


def assembler(names: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol=out, handleInvalid="keep")


def forest(names: Sequence[str], trees: int = 20, depth: int = 10, seed: int = 7, max_bins: int = 32,
           categories: Sequence[str] = ()):
    """A forest; ``categories`` are split as sets of levels (``max_bins`` must exceed the levels of each)."""
    rf = RandomForestRegressor(labelCol=LABEL, featuresCol="features", numTrees=trees, maxDepth=depth,
                               subsamplingRate=0.632, featureSubsetStrategy="onethird", maxBins=max_bins, seed=seed)
    index = [category_indexer(c) for c in categories]
    return Pipeline(stages=[*index, assembler([*names, *[i.getOutputCol() for i in index]]), rf])


def boosted(features: Sequence[str], iters: int = 20, depth: int = 6, step: float = 0.1, sample: float = 0.5,
            col_sample: str = "0.5", seed: int = 7, validation_col: str | None = None, tol: float = 0.01):
    kw = dict(labelCol=LABEL, featuresCol="features", maxIter=iters, maxDepth=depth, stepSize=step,
              subsamplingRate=sample, featureSubsetStrategy=col_sample, seed=seed)
    if validation_col:
        kw.update(validationIndicatorCol=validation_col, validationTol=tol)
    return Pipeline(stages=[assembler(features), GBTRegressor(**kw)])


def predict_sales(model: PipelineModel, df: DataFrame, keys: Sequence[str], name: str = "pred") -> DataFrame:
    """Back-transform to sales, clamp at zero; rows keep their keys."""
    p = model.transform(df)
    return p.select(*keys, F.expm1(S.clamp_at_zero(F.col("prediction"))).alias(name))


def importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Importance table (variable, relative, scaled, percentage) of a fitted model."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                                 "variable string, relative_importance double")
    return stats.importance_table(rows)


def top_features(imp: DataFrame, n: int) -> list[str]:
    """Names of the n most important features (a model's own inputs: bounded)."""
    return [r[0] for r in imp.orderBy(F.desc("relative_importance"), "variable").limit(n).collect()]


def strided(names: Sequence[str], keep_top: int = 2, step: int = 4, start: int = 3) -> list[str]:
    return list(names[:keep_top]) + [names[i - 1] for i in range(start, len(names) + 1, step)]


def two_fold_stack(df: DataFrame, fold_a, fold_b, fit_fn, score_fn, name: str = "trainAB") -> DataFrame:
    """Model on A scores B, model on B scores A; the union is an out-of-fold feature."""
    a, b = df.filter(fold_a), df.filter(fold_b)
    return score_fn(fit_fn(a), b, name).unionByName(score_fn(fit_fn(b), a, name))


def kfold_oof(df: DataFrame, k: int, key: str, fit_fn, score_fn) -> DataFrame:
    """Out-of-fold scores: fold membership is a hash of the key (stable on reruns)."""
    folded = df.withColumn("fold", split.fold_of(F.col(key), k))  # no join: a pure function of the key
    parts = [score_fn(fit_fn(folded.filter(F.col("fold") != f)), folded.filter(F.col("fold") == f))
             for f in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oof_frequency_probs(df: DataFrame, key: str, feature: str, label: str, k: int = 3) -> DataFrame:
    """Out-of-fold class probabilities of a frequency learner P(label | feature).

    Rows of fold f are scored with counts from the other folds (Laplace
    smoothed over the label levels): totals minus the fold's own counts, so
    every fold is scored from one pass of aggregates, never a refit loop.
    The count tables are bounded by k x levels(feature) x levels(label).
    """
    d = df.select(key, feature, label, split.fold_of(F.col(key), k).alias("fold"))
    n_labels = d.select(F.count_distinct(label)).scalar()
    by_fold = d.groupBy("fold", feature, label).agg(F.count(F.lit(1)).alias("c_f"))
    tot = d.groupBy(feature, label).agg(F.count(F.lit(1)).alias("c_all"))
    nf = d.groupBy("fold", feature).agg(F.count(F.lit(1)).alias("n_f"))
    n_all = d.groupBy(feature).agg(F.count(F.lit(1)).alias("n_all"))
    scored = (d.join(by_fold, ["fold", feature, label]).join(tot, [feature, label])
               .join(nf, ["fold", feature]).join(n_all, feature))
    p = (F.col("c_all") - F.col("c_f") + 1) / (F.col("n_all") - F.col("n_f") + n_labels)
    return scored.select(key, "fold", p.alias("p_true"))


def category_indexer(col: str, out: str | None = None) -> StringIndexer:
    """Levels seen at fit; unseen levels at scoring get their own index."""
    return StringIndexer(inputCol=col, outputCol=out or f"{col}_idx", handleInvalid="keep",
                         stringOrderType="alphabetAsc")
