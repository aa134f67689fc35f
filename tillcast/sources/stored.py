"""Panels kept bucketed by store: later windows and store joins need no exchange (IO8, WN3).

``store_panel`` deals a panel once into buckets of its store, each one sorted
file; a window per store or a join on the store reads a bucket per task.
Meant for panels whose stores are bounded by the calendar (a row per store and
day); where a store may hold any share of the rows, use ``blocked=True`` windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Lets a scan of one sorted file per bucket report its order, so that windows skip their sort too.
ORDER_CONF = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def store_panel(df: DataFrame, table: str, buckets: int, store: str = "Store", order: Sequence[str] = ("Date",),
                path: str | None = None) -> DataFrame:
    """Write ``df`` as a bucketed table (in the warehouse, or at ``path``) and return the stored panel."""
    dealt = df.repartition(buckets, store)  # one task, and so one file, per bucket
    writer = dealt.write.bucketBy(buckets, store).sortBy(store, *order).mode("overwrite").format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return read_panel(df.sparkSession, table)


def read_panel(spark: SparkSession, table: str) -> DataFrame:
    spark.conf.set(ORDER_CONF, "true")
    return spark.table(table)


def read_rows_of(spark: SparkSession, table: str, store_values: Sequence, store: str = "Store") -> DataFrame:
    """Rows of a few stores; only their buckets are read."""
    return read_panel(spark, table).filter(f"{store} in ({', '.join(map(repr, store_values))})")
