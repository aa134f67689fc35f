"""Scale helpers: training input, exact sums, checkpoints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.operators import stats
from tillcast.plans import models
from tillcast.session import cut_lineage, ensure_checkpoint_dir


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_input_is_spread_and_stored(spark):
    df = spark.range(0, 5000, numPartitions=1).withColumn("Store", F.lit(1)).withColumn("Date", F.col("id"))
    before = spark._jsc.sc().getPersistentRDDs().size()
    got = models.training_input(df, rows_per_task=1000)
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 5000 and max(sizes) < 2000  # one store, many tasks
    assert spark._jsc.sc().getPersistentRDDs().size() == before


def test_unset_checkpoint_dir_is_an_error_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_exact_mean_of_huge_sums(spark):
    from tillcast.functions.metrics import exact_mean
    df = spark.range(0, 400_000).select((F.col("id") * 7919 % 100_003 / 100 + 3e9 + (F.col("id") % 7) * 1e9).alias("x"))
    got = {df.repartition(n).agg(exact_mean("x")).first()[0] for n in (1, 7, 16)}
    assert len(got) == 1 and got.pop() * 400_000 > 1e15


def test_checkpoint_dir_comes_from_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    got = ensure_checkpoint_dir(spark)
    assert got
    if configured:
        assert configured.rstrip("/").split("/")[-1] in got
    df = cut_lineage(spark.range(0, 10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and "LogicalRDD" in df._jdf.queryExecution().analyzed().toString()


def test_quantiles_by_few_groups_leave_rows_in_place(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=3000).round(3)
    rows = spark.createDataFrame([("hot" if i % 3 else None, float(x)) for i, x in enumerate(v)], "g STRING, v DOUBLE")
    met, plans = stats._met, []

    def seen(*args):
        out = met(*args)
        plans.append(_plan(out))
        return out

    monkeypatch.setattr(stats, "_met", seen)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.g: r.q for r in stats.exact_quantiles(rows, ["g"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for g, of in (("hot", v[np.arange(3000) % 3 > 0]), (None, v[::3])):
        assert np.allclose(found[g], np.quantile(of, stats.QUARTILES))
    assert plans and not any("SortMergeJoin" in p for p in plans)
