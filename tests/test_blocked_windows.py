"""The skew-safe blocked path must equal the per-store path exactly."""

from pyspark.sql import functions as F

from tillcast.operators import windows
from tillcast.sources import panels


def _same(a, b, keys):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    def key(t):
        return tuple((x is None, str(x)) for x in t)
    ra = sorted((tuple(r) for r in a.select(*cols).collect()), key=key)
    rb = sorted((tuple(r) for r in b.select(*cols).collect()), key=key)
    assert ra == rb


def test_blocked_lags_dense(spark, sf_small):
    p = panels.p1_dense(spark, sf_small).select("Store", "Date", "Open", "Sales").filter(F.col("Store") < 4)
    offs = [1, 2, 14, -1, -14]
    plain = windows.shift_cols(p, ["Open", "Sales"], offs)
    blocked = windows.shift_cols(p, ["Open", "Sales"], offs, blocked=True, block_rows=40)
    _same(plain, blocked, ["Store", "Date"])


def test_blocked_refurb_dense(spark, sf_small):
    p = panels.p1_dense(spark, sf_small).select("Store", "Date", "Open").filter(F.col("Store") < 3)
    plain = windows.refurb_features(p)
    blocked = windows.refurb_features(p, blocked=True, block_rows=64)
    _same(plain, blocked, ["Store", "Date"])


def test_blocked_sparse_with_tiebreak(spark, sf_small):
    p = panels.p2_sparse(spark, sf_small).select("Store", "Date", "Seq", "Sales")
    plain = windows.shift_cols(p, ["Sales"], [1, 3, -2], order=["Date", "Seq"])
    blocked = windows.shift_cols(p, ["Sales"], [1, 3, -2], order=["Date", "Seq"], blocked=True, block_rows=6)
    _same(plain, blocked, ["Store", "Seq"])


def test_hot_store_spans_tasks(spark):
    """One store with most rows: blocked windows never need it in one group."""
    df = spark.range(0, 3000).select((F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 7 + 1)).alias("Store"),
                                     F.col("id").alias("Seq"), (F.col("id") % 3 == 0).cast("int").alias("Open"))
    plain = windows.shift_cols(df, ["Open"], [1, -1, 5], order="Seq")
    blocked = windows.shift_cols(df, ["Open"], [1, -1, 5], order="Seq", blocked=True, block_rows=100)
    _same(plain, blocked, ["Store", "Seq"])


def test_blocked_feature_table_equals_plain(spark, sf_small):
    from tillcast.plans import features
    plain = features.feature_table(spark, sf_small).filter(F.col("Store") < 3)
    blocked = features.feature_table(spark, sf_small, blocked=True).filter(F.col("Store") < 3)
    _same(plain, blocked, ["Store", "Date"])


def test_large_hot_store_loses_no_row(spark):
    """Half a million rows in many tasks, a third of them in one store, coalescing on and off."""
    df = (spark.range(0, 500_000, numPartitions=8)
          .select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997 + 1).alias("Store"),
                  F.xxhash64("id").alias("Seq"), F.col("id").alias("V"))).withColumn("pad", F.repeat(F.lit("x"), 40))
    plain = windows.shift_cols(df, ["V"], [1, -7], order="Seq")
    want = plain.agg(F.count("*"), F.sum(F.xxhash64("Store", "Seq", "V", "V_lag1", "V_lead7").cast("decimal(38,0)"))).first()
    assert want[0] == 500_000
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            blocked = windows.shift_cols(df, ["V"], [1, -7], order="Seq", blocked=True)
            got = blocked.agg(F.count("*"), F.sum(F.xxhash64("Store", "Seq", "V", "V_lag1", "V_lead7")
                                                  .cast("decimal(38,0)"))).first()
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert got == want
