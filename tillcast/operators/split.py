"""Honest splits (ML1-ML5): by time, by store, by parity, by hash.

Hash-based splits use ``md5`` of the key so membership is a pure function of
the row (re-running a lost task gives the same split) and is reproducible in
other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_unit(key: Column) -> Column:
    """Deterministic value in [0, 1) from the key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0


def time_holdout(df: DataFrame, cutoff: str, date: str = "Date") -> tuple[DataFrame, DataFrame]:
    d = F.col(date)
    c = F.lit(cutoff).cast("date")
    return df.filter(d < c), df.filter(d >= c)


def fraction_holdout(df: DataFrame, fraction: float, key: Column, salt: str = "0") -> tuple[DataFrame, DataFrame]:
    u = hash_unit(F.concat_ws("|", F.lit(salt), key.cast("string")))
    return df.filter(u >= fraction), df.filter(u < fraction)


def fixed_size_holdout(df: DataFrame, n: int, key: Column, salt: str = "0") -> tuple[DataFrame, DataFrame]:
    """n rows with the smallest hash values (a limit is the feature)."""
    h = F.md5(F.concat_ws("|", F.lit(salt), key.cast("string")))
    tagged = df.withColumn("__h", h)
    held = tagged.orderBy("__h").limit(n)
    rest = tagged.join(held.select("__h"), "__h", "left_anti")
    return rest.drop("__h"), held.drop("__h")


def fold_of(key: Column, k: int) -> Column:
    """Fold id in 0..k-1 from an md5 of the key (same value in any engine)."""
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(k)).cast("int")


def store_folds(stores: DataFrame, k: int, store: str = "Store") -> DataFrame:
    """All rows of a store share one fold in 0..k-1."""
    h = F.conv(F.substring(F.md5(F.col(store).cast("string")), 1, 8), 16, 10).cast("long")
    return stores.select(store, F.pmod(h, F.lit(k)).cast("int").alias("fold"))


def parity_split(df: DataFrame, doy: Column | None = None) -> tuple[DataFrame, DataFrame]:
    doy = doy if doy is not None else F.dayofyear("Date")
    return df.filter(doy % 2 == 0), df.filter(doy % 2 == 1)
