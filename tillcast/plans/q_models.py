"""Registered split, regression, ensemble and model queries (ML*, RS3, RS7, PF18).

Group-mean learners stand in wherever an operator needs an exact oracle;
Spark ML tree models are registered without SQL (rows-only check) and return
keyed rows with rounded predictions.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import metrics as M
from ..operators import split, stats
from ..sources import panels
from ..sources.panels import P1_SQL, STORE_SQL, WEATHER_SQL, sql_with
from ..sources.tables import read
from . import blend, features, models, ols, recursive, trees
from .forecast import (BASE_LEARNERS, HOLDOUT_SQL, HOLDOUT_START, SIDE_LEARNERS, SIDES_SQL, fit_group_mean,
                       holdout_frame, sales_train)

_P1 = sql_with(P1_SQL)
_HOLD = sql_with(P1_SQL, HOLDOUT_SQL)
_HEX = "CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


def _key(spark_cols=True):
    if spark_cols:
        return F.concat_ws("|", F.col("Store").cast("string"), F.col("Date").cast("string"))
    return "CAST(Store AS VARCHAR) || '|' || CAST(Date AS VARCHAR)"


# ------------------------------------------------------------------ splits

@register("ml1_time_holdout", _P1 + f"""
SELECT CASE WHEN Date < DATE '{HOLDOUT_START}' THEN 'fit' ELSE 'valid' END AS part,
       CAST(count(*) AS BIGINT) AS n_rows, CAST(min(Date) AS DATE) AS first_day, CAST(max(Date) AS DATE) AS last_day
FROM train WHERE Sales > 0 GROUP BY 1""")
def ml1(spark, sf):
    t = panels.p1_train(spark, sf).filter(F.col("Sales") > 0)
    fit, valid = split.time_holdout(t, HOLDOUT_START)
    def summ(df, name):
        return df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).cast("long").alias("n_rows"),
                      F.min("Date").alias("first_day"), F.max("Date").alias("last_day"))
    return summ(fit, "fit").unionByName(summ(valid, "valid"))


@register("ml2_fraction_holdout", _P1 + f"""
SELECT Store, Date FROM train
WHERE {_HEX.format(x="'0|' || " + _key(False))} / 4294967296.0 < 0.0125""")
def ml2(spark, sf):
    t = panels.p1_train(spark, sf)
    _, held = split.fraction_holdout(t, 0.0125, _key())
    return held.select("Store", "Date")


@register("ml3_fixed_size_holdout", _P1 + f"""
SELECT Store, Date FROM train ORDER BY md5('0|' || {_key(False)}) LIMIT 10000""")
def ml3(spark, sf):
    t = panels.p1_train(spark, sf).select("Store", "Date")
    _, held = split.fixed_size_holdout(t, 10_000, _key())
    return held


@register("ml4_store_folds", """
SELECT CAST(n_nationkey AS INTEGER) AS Store,
       CAST(CAST(('0x' || substr(md5(CAST(n_nationkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10 AS INTEGER) AS fold
FROM nation""")
def ml4(spark, sf):
    stores = read(spark, sf, "nation", "n_nationkey").select(F.col("n_nationkey").cast("int").alias("Store"))
    return split.store_folds(stores, 10)


@register("ml5_parity_split", _P1 + """
SELECT CAST(dayofyear(Date) % 2 AS INTEGER) AS parity, CAST(count(*) AS BIGINT) AS n_rows FROM train GROUP BY 1""")
def ml5(spark, sf):
    even, odd = split.parity_split(panels.p1_train(spark, sf))
    return (even.agg(F.lit(0).alias("parity"), F.count(F.lit(1)).cast("long").alias("n_rows"))
            .unionByName(odd.agg(F.lit(1).alias("parity"), F.count(F.lit(1)).cast("long").alias("n_rows"))))


# ------------------------------------------------------ per-store regression

_OLS_SQL = _P1 + """,
o AS (SELECT *, ln(Sales) AS y FROM train WHERE Sales > 0),
fit AS (SELECT * FROM o WHERE Date < DATE '2000-06-01'),
m AS (SELECT Store, CASE WHEN regr_sxx(y, Customers) > 0 THEN regr_slope(y, Customers) END AS slope,
             CASE WHEN regr_sxx(y, Customers) > 0 THEN regr_intercept(y, Customers) END AS intercept FROM fit GROUP BY Store),
sc AS (SELECT o.Store, o.Date, o.Sales, exp(m.intercept + m.slope * o.Customers) AS pred
       FROM o JOIN m USING (Store) WHERE o.Date >= DATE '2000-06-01' AND month(o.Date) IN (8, 9))"""


def _ols_scored(spark, sf):
    o = panels.p1_train(spark, sf).filter(F.col("Sales") > 0).withColumn("y", F.ln("Sales"))
    cut = F.lit("2000-06-01").cast("date")
    m = ols.fit_one_feature(o.filter(F.col("Date") < cut), "Customers", "y")
    sc = (o.filter((F.col("Date") >= cut) & F.month("Date").isin(8, 9)).join(m, "Store")
           .select("Store", "Date", "Sales", F.exp(F.col("intercept") + F.col("slope") * F.col("Customers")).alias("pred")))
    return m, sc


@register("ml11_per_store_ols_one_feature", _OLS_SQL + """
SELECT Store, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM m""")
def ml11(spark, sf):
    m, _ = _ols_scored(spark, sf)
    return m.select("Store", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@register("ml11_per_store_ols_moments")
def ml11b(spark, sf):
    """Several regressors per store: moment sums in one groupBy, pinv solve per store row."""
    o = panels.p1_train(spark, sf).filter(F.col("Sales") > 0).withColumn("y", F.ln("Sales"))
    feats = ["Customers", "Promo", "SchoolHoliday", "DayOfWeek"]
    fitted = ols.fit_per_store(o, feats, "y")
    return fitted.select("Store", "n", F.transform("coef", lambda c: F.round(c, 6)).alias("coef"))


@register("ml12_score_per_store", _OLS_SQL + "\nSELECT Store, Date, round(pred, 2) AS pred FROM sc")
def ml12(spark, sf):
    _, sc = _ols_scored(spark, sf)
    return sc.select("Store", "Date", F.round("pred", 2).alias("pred"))


@register("ml13_per_store_error", _OLS_SQL + """,
per AS (SELECT Store, sum(power((pred - Sales) / Sales, 2)) AS sse, count(*) AS n FROM sc GROUP BY Store)
SELECT round(sqrt(sum(sse) / sum(n)), 6) AS rmspe, CAST(count(*) AS BIGINT) AS stores FROM per""")
def ml13(spark, sf):
    _, sc = _ols_scored(spark, sf)
    per = sc.groupBy("Store").agg(F.sum(M.sq_rel_error("pred", "Sales")).alias("sse"),
                                  F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.sqrt(F.sum("sse") / F.sum("n")), 6).alias("rmspe"),
                   F.count(F.lit(1)).cast("long").alias("stores"))


# ---------------------------------------------------------------- blends

@register("ml17_weighted_blend", _HOLD + """
SELECT Store, Date, (p1 * 1.0 + p2 * 2.0 + p3 * 6.0) / 9.0 AS blend FROM hold""")
def ml17(spark, sf):
    h = holdout_frame(spark, sf)
    return h.select("Store", "Date", blend.weighted_blend(["p1", "p2", "p3"], [1, 2, 6]).alias("blend"))


_SIDES = ["p1", "p2", "p4", "p5"]
_GRID_ERR = "round(sqrt(greatest(avg(power(({mix} - Sales) / Sales, 2)), 0)), 6) AS rmspe"


@register("ml19_blend_weight_grid", sql_with(P1_SQL, HOLDOUT_SQL, SIDES_SQL) + """,
grid AS (SELECT i, j, k, l FROM range(0, 11) a(i), range(0, 11) b(j), range(0, 11) c(k), range(0, 11) d(l) WHERE i + j + k + l <= 10),
w AS (SELECT (i - 5) / 10.0 AS w_p1, (j - 5) / 10.0 AS w_p2, (k - 5) / 10.0 AS w_p4, (l - 5) / 10.0 AS w_p5,
             (30 - i - j - k - l) / 10.0 AS w_p3 FROM grid)
SELECT w_p1, w_p2, w_p4, w_p5, w_p3, """ + _GRID_ERR.format(
    mix="w_p1 * p1 + w_p2 * p2 + w_p4 * p4 + w_p5 * p5 + w_p3 * p3") + """
FROM w, h GROUP BY ALL""")
def ml19(spark, sf):
    """1,001 weightings of four side models and the main one."""
    h = holdout_frame(spark, sf, SIDE_LEARNERS | {"p3": BASE_LEARNERS["p3"]})
    return blend.grid_search(h, _SIDES, "p3", "Sales", 10).withColumn("rmspe", F.round("rmspe", 6))


@register("ml19_signed_weight_grid", sql_with(P1_SQL, HOLDOUT_SQL, SIDES_SQL) + """,
e AS (SELECT p1 / Sales - 1 AS a, p2 / Sales - 1 AS b, p4 / Sales - 1 AS c, p5 / Sales - 1 AS d, p3 / Sales - 1 AS m FROM h),
g AS (SELECT avg(a*a) aa, avg(a*b) ab, avg(a*c) ac, avg(a*d) ad, avg(a*m) am, avg(b*b) bb, avg(b*c) bc, avg(b*d) bd,
             avg(b*m) bm, avg(c*c) cc, avg(c*d) cd, avg(c*m) cm, avg(d*d) dd, avg(d*m) dm, avg(m*m) mm FROM e),
grid AS (SELECT i, j, k, l, 1 - i - j - k - l AS n FROM range(-6, 7) a(i), range(-6, 7) b(j), range(-6, 7) c(k), range(-6, 7) d(l)
         WHERE abs(1 - i - j - k - l) <= 6)
SELECT CAST(i AS INTEGER) AS w_p1, CAST(j AS INTEGER) AS w_p2, CAST(k AS INTEGER) AS w_p4, CAST(l AS INTEGER) AS w_p5,
       CAST(n AS INTEGER) AS w_p3,
       round(sqrt(greatest(i*i*aa + j*j*bb + k*k*cc + l*l*dd + n*n*mm + 2*(i*j*ab + i*k*ac + i*l*ad + i*n*am + j*k*bc + j*l*bd
             + j*n*bm + k*l*cd + k*n*cm + l*n*dm), 0)), 5) AS rmspe FROM grid, g""")
def ml19b(spark, sf):
    """All signed whole weightings between -6 and 6 that sum to 1."""
    h = holdout_frame(spark, sf, SIDE_LEARNERS | {"p3": BASE_LEARNERS["p3"]})
    return blend.signed_grid_search(h, _SIDES, "p3", "Sales", 6).withColumn("rmspe", F.round("rmspe", 5))


@register("ml20_two_fold_stack_group_means", _P1 + f""",
st AS (SELECT *, CAST(dayofyear(Date) % 2 AS INTEGER) AS parity FROM train WHERE Sales > 0),
fa AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p FROM st WHERE parity = 0 AND Date < DATE '{HOLDOUT_START}' GROUP BY ALL),
fb AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p FROM st WHERE parity = 1 AND Date < DATE '{HOLDOUT_START}' GROUP BY ALL),
fl AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p FROM st WHERE Date < DATE '{HOLDOUT_START}' GROUP BY ALL)
SELECT s.Store, s.Date, CASE WHEN s.Date >= DATE '{HOLDOUT_START}' THEN fl.p WHEN s.parity = 0 THEN fb.p ELSE fa.p END AS trainAB
FROM st s LEFT JOIN fa USING (Store, Promo, DayOfWeek) LEFT JOIN fb USING (Store, Promo, DayOfWeek)
          LEFT JOIN fl USING (Store, Promo, DayOfWeek)""")
def ml20(spark, sf):
    t = sales_train(spark, sf).withColumn("parity", (F.dayofyear("Date") % 2).cast("int"))
    keys = ["Store", "Promo", "DayOfWeek"]
    cut = F.lit(HOLDOUT_START).cast("date")
    fit_part, later = t.filter(F.col("Date") < cut), t.filter(F.col("Date") >= cut)

    def fit_fn(df):
        return fit_group_mean(df, keys, "Sales", "p")

    def score_fn(model, df, name):
        return df.join(model, keys, "left").select("Store", "Date", F.col("p").alias(name))

    oof = models.two_fold_stack(fit_part, F.col("parity") == 0, F.col("parity") == 1, fit_fn, score_fn)
    full = score_fn(fit_fn(fit_part), later, "trainAB")
    return oof.unionByName(full)


_STACK_SQL = _P1 + f""",
st AS (SELECT *, CAST(dayofyear(Date) % 2 AS INTEGER) AS parity FROM train WHERE Sales > 0),
fa AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p FROM st WHERE parity = 0 AND Date < DATE '{HOLDOUT_START}' GROUP BY ALL),
fb AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p FROM st WHERE parity = 1 AND Date < DATE '{HOLDOUT_START}' GROUP BY ALL),
fl AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS p FROM st WHERE Date < DATE '{HOLDOUT_START}' GROUP BY ALL),
ab AS (SELECT s.*, CASE WHEN s.Date >= DATE '{HOLDOUT_START}' THEN fl.p WHEN s.parity = 0 THEN fb.p ELSE fa.p END AS trainAB
       FROM st s LEFT JOIN fa USING (Store, Promo, DayOfWeek) LEFT JOIN fb USING (Store, Promo, DayOfWeek)
                 LEFT JOIN fl USING (Store, Promo, DayOfWeek)),
lg AS (SELECT *, ln(Sales) AS y, ln(trainAB) AS x FROM ab WHERE trainAB > 0),
lv AS (SELECT Store, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM lg
       WHERE Date < DATE '{HOLDOUT_START}' GROUP BY Store HAVING regr_sxx(y, x) > 0)
SELECT lg.Store, lg.Date, round(exp(intercept + slope * x), 2) AS pred
FROM lg JOIN lv USING (Store) WHERE Date >= DATE '{HOLDOUT_START}'"""


@register("ml20_second_level_regression", _STACK_SQL)
def ml20c(spark, sf):
    """Second level: a regression per store on the out-of-fold feature, scored where the full model gave it."""
    t = sales_train(spark, sf).select("Store", "Date", "Sales")
    lg = t.join(ml20(spark, sf), ["Store", "Date"]).filter(F.col("trainAB") > 0).select(
        "Store", "Date", F.ln("Sales").alias("y"), F.ln("trainAB").alias("x"))
    cut = F.lit(HOLDOUT_START).cast("date")
    final = ols.fit_one_feature(lg.filter(F.col("Date") < cut), "x", "y").filter(F.col("slope").isNotNull())
    scored = lg.filter(F.col("Date") >= cut).join(final, "Store")
    return scored.select("Store", "Date", F.round(F.exp(F.col("intercept") + F.col("slope") * F.col("x")), 2).alias("pred"))


_LAGS, _HORIZON = 21, 48  # as in the reference's day-by-day forecast
_SUM = " + ".join(f"vals[{i}]" for i in range(1, _LAGS + 1))
_REC_SQL = _P1 + f""",
h AS (SELECT Store, Sales, row_number() OVER (PARTITION BY Store ORDER BY Date DESC) AS k FROM train),
s0 AS (SELECT Store, list(Sales ORDER BY k DESC) AS vals FROM h WHERE k <= {_LAGS} GROUP BY Store),
rec AS (SELECT Store, 0 AS step, vals, CAST(NULL AS DOUBLE) AS pred FROM s0
        UNION ALL
        SELECT Store, step + 1, list_append(vals[2:{_LAGS}], ({_SUM}) / {_LAGS}), ({_SUM}) / {_LAGS}
        FROM rec WHERE step < {_HORIZON})
SELECT Store, step, round(pred, 4) AS pred FROM rec WHERE step > 0"""


@register("ml22_recursive_moving_average", _REC_SQL.replace("WITH ", "WITH RECURSIVE ", 1))
def ml22(spark, sf):
    state = recursive.last_values(panels.p1_train(spark, sf), "Sales", _LAGS)
    out = recursive.moving_average_forecast(state, _HORIZON, _LAGS)
    return out.select("Store", F.col("step").cast("int").alias("step"), F.round("pred", 4).alias("pred"))


_OWN = ["Promo", "DayOfWeek", "Open"]


def _recursive_input(spark, sf):
    """(rows with 21 lags and log sales, last 21 values of each store, forecast days by step, lag names)."""
    from ..operators import windows
    lags = [f"Sales_lag{k}" for k in range(1, _LAGS + 1)]
    t = panels.p1_train(spark, sf).select("Store", "Date", "Sales", *_OWN)
    rows = windows.shift_cols(t, ["Sales"], list(range(1, _LAGS + 1))).dropna().withColumn("y", F.log1p("Sales"))
    first = F.lit(panels.TEST_START).cast("date")
    days = panels.p1_test(spark, sf).fillna({"Open": 1}).select(
        "Store", (F.datediff("Date", first) + 1).alias("step"), *_OWN).filter(F.col("step") <= _HORIZON)
    return rows, recursive.last_values(t, "Sales", _LAGS), days, lags


def _back(p):
    return F.greatest(F.expm1(p), F.lit(0.0))


@register("ml22_recursive_model_forecast")
def ml22b(spark, sf):
    """Linear model of log sales on 21 lags and the day's own promo, weekday and opening, rolled forward 48 days."""
    rows, state, days, lags = _recursive_input(spark, sf)
    asm = models.assembler(lags + _OWN)
    model = LinearRegression(featuresCol="features", labelCol="y", regParam=0.0).fit(asm.transform(rows))
    out = recursive.model_forecast(state, model, lags, _HORIZON, assemble=asm.transform, daily=days, inverse=_back)
    return out.select("Store", F.col("step").cast("int").alias("step"), F.round("pred", 2).alias("pred"))


@register("ml22_recursive_forest_forecast")
def ml22c(spark, sf):
    """The same days by a forest, compiled to a table of nodes: the whole horizon in one expression per store."""
    from pyspark.ml.regression import RandomForestRegressor
    rows, state, days, lags = _recursive_input(spark, sf)
    names = lags + _OWN
    rf = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=50, maxDepth=8, seed=7)
    model = rf.fit(models.training_input(models.assembler(names).transform(rows)))
    out = recursive.compiled_forecast(state, trees.compile_trees(model), names, lags, days, inverse=_back)
    return out.select("Store", "step", F.round("pred", 2).alias("pred"))


# ------------------------------------------------------------- Spark ML

def _train_valid(spark, sf):
    """Training and holdout rows of the whole feature table, and the names of its features."""
    df, names = models.feature_frame(spark, sf)
    cut = F.lit(HOLDOUT_START).cast("date")
    return models.training_input(df.filter(F.col("Date") < cut)), df.filter(F.col("Date") >= cut), names


def _scored(model, df, name="pred"):
    p = models.predict_sales(model, df, ["Store", "Date", "Sales"], name)
    return p.select("Store", "Date", F.round(name, 2).alias(name))


@register("ml6_random_forest")
def ml6(spark, sf):
    """All features, and the store as a category of the trees themselves."""
    fit, valid, names = _train_valid(spark, sf)
    levels = fit.select("Store").distinct().count()
    m = models.forest(names, trees=20, depth=12, max_bins=max(32, levels + 2), categories=["Store"]).fit(fit)
    return _scored(m, valid)


@register("ml6_store_category_gain")
def ml6b(spark, sf):
    """Error on the holdout of a forest with the store, as out-of-fold target means, and of one without it."""
    from pyspark.ml import Pipeline

    from . import steps
    fit, valid, names = _train_valid(spark, sf)
    fit = models.cut_lineage(fit.withColumn("fold", split.fold_of(_key(), 5)))
    plain = [n for n in names if not n.startswith("Sales_")]  # the ready-made means would tell the store
    means = steps.TargetMeans(keys=["Store"], labelCol=models.LABEL, outputCol="Store_mean", smoothing=10.0)
    fitted = models.fit_many(fit, {
        "without": models.forest(plain, trees=20, depth=8),
        "with": Pipeline(stages=[means, models.forest([*plain, "Store_mean"], trees=20, depth=8)])})
    errors = [m.transform(valid).agg(F.lit(name).alias("store"), F.count(F.lit(1)).alias("n"), F.round(
        F.sqrt(M.mse("prediction", models.LABEL)), 5).alias("rmse_log")) for name, m in sorted(fitted.items())]
    return errors[0].unionByName(errors[1])


@register("ml7_gradient_boosting")
def ml7(spark, sf):
    """A preset as the reference runs it: 50 trees of depth 15, rate 0.05, half of rows and columns a tree."""
    fit, valid, names = _train_valid(spark, sf)
    return _scored(models.preset("gbm_15_05_50", names).fit(fit), valid)


@register("ml8_boosting_xgb_style")
def ml8(spark, sf):
    """Another preset as dealt: 60 rounds of depth 10, rate 0.5, with 0.7 of rows and columns."""
    fit, valid, names = _train_valid(spark, sf)
    m = models.boosted(names, sample=0.7, col_sample="0.7", **models.GBT_PRESETS["xgb_5_10_60"]).fit(fit)
    return _scored(m, valid)


@register("ml9_early_stopping")
def ml9(spark, sf):
    """200 rounds watched by relative error: the error after each round, and where patience of 50 ends and cuts."""
    df, names = models.feature_frame(spark, sf)
    watched = split.hash_unit(_key()) < 0.0125
    m = models.boosted(names, iters=200, depth=4, step=0.1).fit(models.training_input(df.filter(~watched)))
    watch = models.cut_lineage(m.stages[0].transform(df.filter(watched)))
    curve = models.cut_lineage(trees.stage_curve(watch, trees.compile_trees(m), models.LABEL, trees.feature_array()))
    best = trees.best_stage(curve, patience=50)
    return curve.select(
        F.col("stage").cast("int").alias("stage"), F.round("metric", 6).alias("rmspe"),
        (F.col("stage") == best.select("best_stage").scalar()).alias("kept"),
        (F.col("stage") <= best.select("stopped_at").scalar()).alias("trained"))


@register("ml10_importance_table")
def ml10(spark, sf):
    fit, _, names = _train_valid(spark, sf)
    m = models.boosted(names, iters=20, depth=6).fit(fit)
    imp = models.importance(spark, m, names)
    return imp.select("variable", *[F.round(c, 6).alias(c) for c in
                                    ("relative_importance", "scaled_importance", "percentage")])


@register("ml14_batch_predict_submission")
def ml14(spark, sf):
    frame, names = models.feature_frame(spark, sf, include_test=True)
    known = frame.filter((F.col("type") == "train") & (F.col("Date") < F.lit(HOLDOUT_START).cast("date")))
    m = models.boosted(names, iters=20, depth=6).fit(models.training_input(known))
    p = models.predict_sales(m, frame.filter(F.col("type") == "test"), ["Id", "Open"], "Sales")
    return p.select("Id", F.when(F.col("Open") == 0, 0.0).otherwise(F.round("Sales", 2)).alias("Sales"))


@register("ml15_refit_on_all_rows")
def ml15(spark, sf):
    """Target means and model fitted again on all training rows, then the forecast rows scored."""
    frame, names = models.feature_frame(spark, sf, include_test=True, fit_before=None)
    m = models.boosted(names, iters=20, depth=6).fit(models.training_input(frame.filter(F.col("type") == "train")))
    p = models.predict_sales(m, frame.filter(F.col("type") == "test"), ["Id"], "Sales")
    return p.select("Id", F.round("Sales", 2).alias("Sales"))


_TOP = 80  # ranked features that the subsets draw from, as in the reference


@register("ml16_feature_subset_models")
def ml16(spark, sf):
    """Four strided subsets of the 80 best features (two best and every fourth) and their alternating halves.

    Features are binned and stored once; the six fits run side by side over the bins.
    """
    fit, valid, names = _train_valid(spark, sf)
    binning, bins = models.binned(fit, names)
    full = models.boosted([f"{n}_b" for n in names], iters=10, depth=6).fit(bins)
    ranked = models.top_features(models.importance(spark, full, names), _TOP)
    subsets = {s: models.strided(ranked, start=3 + i) for i, s in enumerate("abcd")} | {"e": ranked[::2], "f": ranked[1::2]}
    fitted = models.fit_many(bins, {s: models.boosted([f"{n}_b" for n in feats], iters=10, depth=6) for s, feats in subsets.items()},
                             at_once=6)
    scored = models.cut_lineage(binning.transform(valid))
    out = None
    for name, m in sorted(fitted.items()):
        p = _scored(m, scored, "pred").withColumn("subset", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


@register("ml18_seed_average")
def ml18(spark, sf):
    """Mean of two boosted runs that differ in their seed, fitted side by side."""
    fit, valid, names = _train_valid(spark, sf)
    fitted = models.fit_many(fit, {n: models.boosted(names, iters=20, depth=6, seed=seed) for seed, n in ((1, "p_a"), (2, "p_b"))})
    runs = [_scored(m, valid, name) for name, m in sorted(fitted.items())]
    j = runs[0].join(runs[1], ["Store", "Date"])
    return j.select("Store", "Date", F.round((F.col("p_a") + F.col("p_b")) / 2, 2).alias("pred"))


@register("ml20_two_fold_stack_models")
def ml20b(spark, sf):
    """Boosted first level by halves, its out-of-fold scores a feature of the boosted second level."""
    fit, valid, feats = _train_valid(spark, sf)
    fit = fit.withColumn("parity", (F.col("day_of_year") % 2).cast("int"))
    keys = ["Store", "Date"]

    def fit_fn(df):
        return models.boosted(feats, iters=5, depth=4).fit(df)

    def score_fn(model, df, name):
        return models.predict_sales(model, df, keys, name)

    oof = models.two_fold_stack(fit, F.col("parity") == 0, F.col("parity") == 1, fit_fn, score_fn)
    second = models.training_input(fit.join(oof, keys).withColumn("trainAB", F.log1p("trainAB")))
    final = models.boosted([*feats, "trainAB"], iters=5, depth=4).fit(second)
    later = valid.join(score_fn(fit_fn(fit), valid, "trainAB"), keys).withColumn("trainAB", F.log1p("trainAB"))
    return _scored(final, later)


@register("ml21_kfold_oof_logloss")
def ml21(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    c = read(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    idx = StringIndexer(inputCol="c_mktsegment", outputCol="label", stringOrderType="alphabetAsc").fit(c)
    data = models.assembler(["c_acctbal", "c_nationkey"]).transform(idx.transform(c))
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=20)

    def fit_fn(df):
        return lr.fit(df)

    def score_fn(model, df):
        p = model.transform(df).select("c_custkey", "label", vector_to_array("probability").alias("prob"))
        return p.select("c_custkey", F.element_at("prob", F.col("label").cast("int") + 1).alias("p_true"))

    oof = models.kfold_oof(data, 3, "c_custkey", fit_fn, score_fn)
    return oof.agg(F.round(M.log_loss("p_true"), 4).alias("log_loss"), F.count(F.lit(1)).cast("long").alias("n"))


@register("ml21_kfold_oof_frequency_logloss", """
WITH d AS (SELECT c_custkey, c_nationkey, c_mktsegment,
                  CAST(CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS INTEGER) AS fold
           FROM customer),
s AS (SELECT count(DISTINCT c_mktsegment) AS n_labels FROM d),
cf AS (SELECT fold, c_nationkey, c_mktsegment, count(*) AS c_f FROM d GROUP BY ALL),
ca AS (SELECT c_nationkey, c_mktsegment, count(*) AS c_all FROM d GROUP BY ALL),
nf AS (SELECT fold, c_nationkey, count(*) AS n_f FROM d GROUP BY ALL),
na AS (SELECT c_nationkey, count(*) AS n_all FROM d GROUP BY ALL),
p AS (SELECT (ca.c_all - cf.c_f + 1) / (na.n_all - nf.n_f + s.n_labels) AS p_true
      FROM d JOIN cf USING (fold, c_nationkey, c_mktsegment) JOIN ca USING (c_nationkey, c_mktsegment)
             JOIN nf USING (fold, c_nationkey) JOIN na USING (c_nationkey), s)
SELECT round(avg(-ln(p_true)), 6) AS log_loss, CAST(count(*) AS BIGINT) AS n FROM p""")
def ml21b(spark, sf):
    c = read(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    p = models.oof_frequency_probs(c, "c_custkey", "c_nationkey", "c_mktsegment", 3)
    return p.agg(F.round(F.avg(-F.ln("p_true")), 6).alias("log_loss"), F.count(F.lit(1)).cast("long").alias("n"))


@register("ag15_rmspe_evaluator")
def ag15b(spark, sf):
    """RMSPE (log space) of a boosted model through the Evaluator interface."""
    from .evaluation import RMSPEEvaluator
    fit, valid, names = _train_valid(spark, sf)
    m = models.boosted(names, iters=8, depth=5).fit(fit)
    scored = m.transform(valid)
    v = RMSPEEvaluator(predictionCol="prediction", labelCol=models.LABEL, logSpace=True).evaluate(scored)
    return scored.agg(F.count(F.lit(1)).cast("long").alias("n")).withColumn("rmspe", F.round(F.lit(v), 4))


@register("ag16_regression_evaluator")
def ag16b(spark, sf):
    """MSE / R2 of a boosted model on log sales via RegressionEvaluator."""
    from .evaluation import regression_metrics
    fit, valid, names = _train_valid(spark, sf)
    m = models.boosted(names, iters=8, depth=5).fit(fit)
    met = regression_metrics(m.transform(valid), models.LABEL)
    return met.select("n", *[F.round(c, 5).alias(c) for c in met.columns if c != "n"])


@register("ag15_rmspe_evaluator_means", _HOLD + """
SELECT round(sqrt(avg(CASE WHEN Sales = 0 THEN 0 ELSE power((Sales - p3) / Sales, 2) END)), 6) AS rmspe, CAST(count(*) AS BIGINT) AS n
FROM hold WHERE p3 IS NOT NULL""")
def ag15c(spark, sf):
    """The evaluator over predictions that SQL can make too."""
    from .evaluation import RMSPEEvaluator
    h = models.cut_lineage(holdout_frame(spark, sf).filter("p3 is not null"))
    v = RMSPEEvaluator(predictionCol="p3", labelCol="Sales").evaluate(h)
    return h.agg(F.round(F.lit(v), 6).alias("rmspe"), F.count(F.lit(1)).alias("n"))


@register("ag16_regression_metrics_means", _HOLD + """
SELECT round(avg(power(p3 - Sales, 2)), 2) AS mse, round(sqrt(avg(power(p3 - Sales, 2))), 4) AS rmse, round(avg(abs(p3 - Sales)), 4) AS mae,
       round(1 - sum(power(p3 - Sales, 2)) / (count(*) * var_pop(Sales)), 6) AS r2, CAST(count(*) AS BIGINT) AS n
FROM hold WHERE p3 IS NOT NULL""")
def ag16c(spark, sf):
    from .evaluation import regression_metrics
    met = regression_metrics(holdout_frame(spark, sf).filter("p3 is not null"), "Sales", "p3")
    return met.select(*[F.round(c, d).alias(c) for c, d in (("mse", 2), ("rmse", 4), ("mae", 4), ("r2", 6))], "n")


@register("rs3_out_of_fold_store_means", _P1 + f""",
f AS (SELECT Store, Date, Promo, ln(1 + Sales) AS y, CAST(CAST(('0x' || substr(md5({_key(False)}), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold
      FROM train WHERE Sales > 0),
w AS (SELECT *, sum(y) OVER k - sum(y) OVER kf AS s, count(*) OVER k - count(*) OVER kf AS n FROM f
      WINDOW k AS (PARTITION BY Store, Promo), kf AS (PARTITION BY Store, Promo, fold)),
a AS (SELECT Store, Promo, avg(y) AS m FROM f GROUP BY ALL)
SELECT Store, Date, 'train' AS part, round(s / n, 8) AS store_mean FROM w WHERE n > 0
UNION ALL SELECT t.Store, t.Date, 'new', round(m, 8) FROM test t JOIN a USING (Store, Promo)""")
def rs3b(spark, sf):
    """Stores and promotions as mean log sales: training rows from the other folds, new rows from all."""
    from . import steps
    t = panels.p1_train(spark, sf).filter(F.col("Sales") > 0).select("Store", "Date", "Promo", F.log1p("Sales").alias("y"))
    t = t.withColumn("fold", split.fold_of(_key(), 5))
    m = steps.TargetMeans(keys=["Store", "Promo"], labelCol="y", outputCol="store_mean", folds=5).fit(t)
    new = panels.p1_test(spark, sf).select("Store", "Date", "Promo")
    cols = lambda df, part: m.transform(df).filter(F.col("store_mean") > m.getOrDefault("unseen")).select(
        "Store", "Date", F.lit(part).alias("part"), F.round("store_mean", 8).alias("store_mean"))
    return cols(t, "train").unionByName(cols(new, "new"))


@register("rs3_category_indexer_unseen", _P1 + """,
lv AS (SELECT StateHoliday, dense_rank() OVER (ORDER BY StateHoliday) - 1 AS i
       FROM (SELECT DISTINCT StateHoliday FROM train WHERE StateHoliday IS NOT NULL AND StateHoliday <> 'c'))
SELECT Id, CAST(coalesce(i, (SELECT count(*) FROM lv)) AS DOUBLE) AS StateHoliday_idx
FROM (SELECT Id, coalesce(StateHoliday, '0') AS StateHoliday FROM test) LEFT JOIN lv USING (StateHoliday)""")
def rs3(spark, sf):
    """Levels of the training rows but one, so that the forecast rows hold an unseen level."""
    tr, te = panels.p1_train(spark, sf), panels.p1_test(spark, sf)
    ind = models.category_indexer("StateHoliday").fit(tr.filter(F.col("StateHoliday") != "c"))
    return ind.transform(te.fillna({"StateHoliday": "0"})).select("Id", "StateHoliday_idx")


_FRAME_SQL = sql_with(P1_SQL, STORE_SQL) + f""",
st AS (SELECT *, CAST(month(Date) AS INTEGER) AS month FROM train WHERE Sales > 0),
fit AS (SELECT * FROM st WHERE Date < DATE '{HOLDOUT_START}'),
m1 AS (SELECT Store, Promo, round(sum(Sales), 2) / count(Sales) AS Sales_all_avg FROM fit GROUP BY ALL),
m2 AS (SELECT Store, Promo, month, round(sum(Sales), 2) / count(Sales) AS Sales_month_avg FROM fit GROUP BY ALL),
m3 AS (SELECT Store, Promo, DayOfWeek, round(sum(Sales), 2) / count(Sales) AS Sales_day_avg FROM fit GROUP BY ALL),
fr AS (SELECT st.Store, st.Date, DayOfWeek, Promo, SchoolHoliday, year(st.Date) AS year, st.month, day(st.Date) AS day,
              dayofyear(st.Date) AS day_of_year, ceil(dayofyear(st.Date) / 7.0) AS weeknum,
              CASE StoreType WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'd' THEN 4 END AS StoreType_o,
              CASE Assortment WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'd' THEN 4 END AS Assortment_o,
              coalesce(CompetitionDistance, 75000.0) AS CompetitionDistance, Promo2,
              CASE PromoInterval WHEN 'Jan,Apr,Jul,Oct' THEN 1 WHEN 'Feb,May,Aug,Nov' THEN 2
                                 WHEN 'Mar,Jun,Sept,Dec' THEN 3 ELSE 0 END AS PromoInterval_c,
              Sales_all_avg, Sales_month_avg, Sales_day_avg
       FROM st JOIN store USING (Store) LEFT JOIN m1 USING (Store, Promo) LEFT JOIN m2 USING (Store, Promo, month)
               LEFT JOIN m3 USING (Store, Promo, DayOfWeek))"""


@register("rs7_feature_vector_assembly", _FRAME_SQL + "\nSELECT Store, Date, " + ", ".join(
    f"CAST(coalesce({c}, 'nan') AS DOUBLE) AS f{i}" if c.startswith("Sales_") else f"CAST({c} AS DOUBLE) AS f{i}"
    for i, c in enumerate(models.NUMERIC_FEATURES)) + " FROM fr")
def rs7(spark, sf):
    """Every element of the assembled vector (missing values are kept as NaN)."""
    v = models.assembler(models.NUMERIC_FEATURES).transform(models.model_frame(spark, sf))
    v = v.select("Store", "Date", vector_to_array("features").alias("v"))
    return v.select("Store", "Date", *[F.get("v", F.lit(i)).alias(f"f{i}") for i in range(len(models.NUMERIC_FEATURES))])


@register("pf18_attach_predictions_by_key", _OLS_SQL + """
SELECT o.Store, o.Date, o.Sales, round(sc.pred, 2) AS pred FROM o LEFT JOIN sc USING (Store, Date)""")
def pf18(spark, sf):
    """Predictions joined to the rows by key (the reference binds them by position)."""
    _, scored = _ols_scored(spark, sf)
    rows = panels.p1_train(spark, sf).filter(F.col("Sales") > 0).select("Store", "Date", "Sales")
    return rows.join(scored.drop("Sales"), ["Store", "Date"], "left").select(
        "Store", "Date", "Sales", F.round("pred", 2).alias("pred"))


@register("ml11_per_store_ols_two_features", _P1 + """,
o AS (SELECT Store, ln(Sales) AS y, CAST(Customers AS DOUBLE) AS a, CAST(DayOfWeek AS DOUBLE) AS b FROM train WHERE Sales > 0),
m AS (SELECT Store, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb,
             covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM o GROUP BY Store),
c AS (SELECT Store, n, my, ma, mb, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca,
             (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m)
SELECT Store, n, round(my - ca * ma - cb * mb, 4) AS intercept, round(ca, 4) AS customers, round(cb, 4) AS weekday FROM c""")
def ml11c(spark, sf):
    o = panels.p1_train(spark, sf).filter(F.col("Sales") > 0).withColumn("y", F.ln("Sales"))
    fitted = ols.fit_per_store(o, ["Customers", "DayOfWeek"], "y")
    return fitted.select("Store", "n", *[F.round(F.get("coef", F.lit(i)), 4).alias(c)
                                         for i, c in enumerate(("intercept", "customers", "weekday"))])


@register("uf3_build_features", sql_with(P1_SQL, STORE_SQL) + """
SELECT Id, t.Store, Date, coalesce(CompetitionDistance, 0.0) AS CompetitionDistance,
       coalesce(CompetitionOpenSinceMonth, 0) AS CompetitionOpenSinceMonth,
       coalesce(CompetitionOpenSinceYear, 0) AS CompetitionOpenSinceYear, coalesce(Open, 0) AS Open, Promo, Promo2,
       coalesce(Promo2SinceWeek, 0) AS Promo2SinceWeek, coalesce(Promo2SinceYear, 0) AS Promo2SinceYear,
       CAST(SchoolHoliday AS DOUBLE) AS SchoolHoliday,
       CAST(CASE StateHoliday WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 ELSE 0 END AS DOUBLE) AS StateHoliday,
       DayOfWeek, CAST(month(Date) AS DOUBLE) AS month, CAST(day(Date) AS DOUBLE) AS day, CAST(year(Date) AS DOUBLE) AS year,
       CAST(CASE StoreType WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 WHEN 'd' THEN 4 END AS DOUBLE) AS StoreType,
       CAST(CASE Assortment WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'c' THEN 3 END AS DOUBLE) AS Assortment
FROM test t JOIN store USING (Store)""")
def uf3(spark, sf):
    rows = panels.p1_test(spark, sf).join(panels.store_table(spark, sf), "Store")
    names, out = models.build_features(rows)
    return out.select("Id", "Date", *names)


_FE_WINDOW = "OVER (PARTITION BY Store ORDER BY Date)"


def _fe_sql():
    """The feature table column by column, with explicit lag and lead chains."""
    def shift(col, k):
        return f"{'lag' if k > 0 else 'lead'}({col}, {abs(k)}) {_FE_WINDOW}"
    banks = {"Open": features.OPEN_BANK, **features.WEATHER_BANKS}
    bank_cols = ", ".join(f"{shift(c, k)} AS {c}_{'lag' if k > 0 else 'lead'}{abs(k)}" for c, ks in banks.items() for k in ks)
    before = " AND ".join(f"{shift('Open', -k)} = 0" for k in range(1, 6))
    after = " AND ".join(f"{shift('Open', k)} = 0" for k in range(1, 6))
    days_before = " ".join(f"WHEN {shift('DayBeforeRefurb', -k)} = 1 THEN {k + 1}" for k in range(14, 0, -1))
    days_after = " ".join(f"WHEN {shift('DayAfterRefurb', k)} = 1 THEN {k + 1}" for k in range(14, 0, -1))
    means = ", ".join(f"round(sum(Sales) FILTER (type = 'train') OVER (PARTITION BY {', '.join(ks)}), 2) / "
                      f"nullif(count(Sales) FILTER (type = 'train') OVER (PARTITION BY {', '.join(ks)}), 0) AS {name}"
                      for ks, name in stats.TARGET_MEANS)
    return sql_with(P1_SQL, STORE_SQL, WEATHER_SQL) + f""",
rel AS (SELECT CAST(o_orderdate AS DATE) AS Released, CAST(count(*) AS DOUBLE) AS Actual FROM orders
        WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1),
un AS (SELECT NULL::INTEGER AS Id, Store, DayOfWeek, Date, Sales, Customers, Open, Promo, StateHoliday, SchoolHoliday, 'train' AS type FROM train
       UNION ALL SELECT Id, Store, DayOfWeek, Date, NULL, NULL, coalesce(Open, 1), Promo, StateHoliday, SchoolHoliday, 'test' FROM test),
cal AS (SELECT Id, Store, DayOfWeek, Date, Sales, Customers, CASE WHEN Sales = 0 THEN 0 ELSE Open END AS Open, Promo,
               coalesce(StateHoliday, '0') AS StateHoliday, SchoolHoliday, type, CAST(year(Date) AS INTEGER) AS year,
               CAST(month(Date) AS INTEGER) AS month, CAST(day(Date) AS INTEGER) AS day, CAST(dayofyear(Date) AS INTEGER) AS day_of_year,
               CAST(quarter(Date) AS INTEGER) AS quarter, CAST(day(Date) = 1 AS INTEGER) AS is_month_start,
               CAST(Date = last_day(Date) AS INTEGER) AS is_month_end,
               CAST(Date = date_trunc('quarter', Date) AS INTEGER) AS is_quarter_start,
               CAST(Date = CAST(date_trunc('quarter', Date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS INTEGER) AS is_quarter_end,
               CAST(ceil(dayofyear(Date) / 7.0) AS INTEGER) AS weeknum FROM un),
j AS (SELECT cal.*, s.State, w.Mean_TemperatureC, w.Max_Wind_SpeedKm_h, w.Precipitationmm, w.Goog_trend, w.Events,
             ta.Goog_trend_ALL
      FROM cal JOIN store_states s USING (Store)
           LEFT JOIN weather w ON w.State = CASE WHEN s.State = 'AS,MI' THEN 'MI' ELSE s.State END AND w.Date = cal.Date
           LEFT JOIN trend_all ta ON ta.Date = cal.Date),
ja AS (SELECT j.*, r.Actual FROM j ASOF LEFT JOIN rel r ON j.Date >= r.Released),
f1 AS (SELECT *, {means}, CASE WHEN Promo = 1 AND lag(Promo, 1) {_FE_WINDOW} = 0 THEN 1 ELSE 0 END AS PromoFirstDate,
              {bank_cols}, CASE WHEN Open = 1 AND {before} THEN 1 ELSE 0 END AS DayBeforeRefurb,
              CASE WHEN Open = 1 AND {after} THEN 1 ELSE 0 END AS DayAfterRefurb FROM ja)
SELECT *, CASE WHEN Promo = 1 AND lag(PromoFirstDate, 1) {_FE_WINDOW} = 1 THEN 1 ELSE 0 END AS PromoSecondDate,
       CAST(CASE {days_before} WHEN DayBeforeRefurb = 1 THEN 1 ELSE 0 END AS INTEGER) AS DaysBeforeRefurb,
       CAST(CASE {days_after} WHEN DayAfterRefurb = 1 THEN 1 ELSE 0 END AS INTEGER) AS DaysAfterRefurb FROM f1"""


@register("fe_feature_table", _fe_sql())
def fe(spark, sf):
    """The whole feature table, every column checked in one piece."""
    return features.feature_table(spark, sf)
