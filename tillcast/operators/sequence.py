"""Global row numbers and running aggregates for tables and groups of any size.

``row_number()`` over an unpartitioned window puts all rows into one task, and a
running sum over ``partitionBy(key)`` puts all rows of a key there.  Here the rows
are range-partitioned and sorted, so that the tasks, in id order, hold one sorted
sequence; what a row needs from earlier tasks is one value per task (and key).
The ranged frame is materialised once in the shared checkpoint folder: range
boundaries come from sampling, so a second evaluation (for the per-task values)
could cut the sequence elsewhere.

Rows that tie in the asked order are told apart by a hash of the whole row, so a
value shared by many rows spans tasks too.  Rows equal in every column stay
together: count them first (as ``exact_quantiles`` does) where a third of a table
may be one and the same row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _row_hash(df: DataFrame) -> list[Column]:
    kinds = [f for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return [F.xxhash64(*[F.col(f.name) for f in kinds])] if kinds else []


def numbered(df: DataFrame, *order: str | Column, name: str = "__g") -> DataFrame:
    """``df`` with ``name``: its rows' places (from 0) in the given order; ties by a hash of the row."""
    order = [*order, *_row_hash(df)]
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__pid", F.spark_partition_id())
                         .withColumn("__mid", F.monotonically_increasing_id()))
    per_task = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_task.select("__pid", F.coalesce(earlier, F.lit(0)).alias("__start"))  # one row a task
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (ranged.join(F.broadcast(starts), "__pid").withColumn(name, F.col("__start") + local)
            .drop("__pid", "__mid", "__start"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, str],
            aggregate: Callable[[Column | str], Column] = F.sum, through: bool = False) -> DataFrame:
    """``df`` with one column per entry of ``values`` (new name -> column): ``aggregate`` over the
    rows of the same key that come earlier in ``order`` (``through``: this row included); null for none.

    ``aggregate``: sum, bit_xor, max or min.  ``order`` should tell the rows of a key
    apart.  No task holds more than one range of rows, whatever share of the table a key has;
    null keys are a key like any other.
    """
    names = [f"__run_k{i}" for i in range(len(keys))]
    cut = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    ranged = cut_lineage((df.repartitionByRange(*cut) if cut else df).withColumn("__run_pid", F.spark_partition_id()))
    last = 0 if through else -1
    inside = Window.partitionBy("__run_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    rows = ranged.withColumns({f"__v_{n}": aggregate(c).over(inside) for n, c in values.items()})
    per_task = ranged.groupBy("__run_pid", *[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        *[aggregate(c).alias(f"__t_{n}") for n, c in values.items()])
    before = Window.partitionBy(*names).orderBy("__run_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    carried = per_task.select(F.col("__run_pid").alias("__run_at"), *names,
                              *[aggregate(f"__t_{n}").over(before).alias(f"__c_{n}") for n in values])
    carried = carried.filter(" or ".join(f"__c_{n} is not null" for n in values))
    same = F.col("__run_pid") == F.col("__run_at")
    for k, n in zip(keys, names):
        same &= F.col(k).eqNullSafe(F.col(n))
    rows = rows.join(carried, same, "left")

    def joined(n: str) -> Column:
        own, earlier = F.col(f"__v_{n}"), F.col(f"__c_{n}")
        return F.when(own.isNull(), earlier).when(earlier.isNull(), own).otherwise(_merge(aggregate, earlier, own))
    return rows.withColumns({n: joined(n) for n in values}).select(*df.columns, *values)


def _merge(aggregate: Callable, a: Column, b: Column) -> Column:
    if aggregate is F.sum:
        return a + b
    if aggregate is F.bit_xor:
        return a.bitwiseXOR(b)
    if aggregate in (F.max, F.min):
        return F.greatest(a, b) if aggregate is F.max else F.least(a, b)
    raise ValueError("running() merges sum, bit_xor, max and min")
