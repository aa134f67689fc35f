"""The next row in key order, for tables of any size: one shuffle of the wide rows.

A global ``lead`` would put all rows into one task.  Here rows are dealt into
ordered buckets: quantiles of the key (a bounded sketch), each cut evenly until
a bucket is expected to hold ``BUCKET_ROWS`` rows.  ``lead`` runs inside the
buckets; the last row of a bucket takes the first row of the next one, which is
found from a table with one key per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKET_ROWS = 1000
QUANTILES = 1024
BROADCAST_HEADS = 200_000  # bucket heads (a key each) that may be broadcast; beyond it they are shuffled


def _bucket(key: Column, bounds: list[int], parts: int) -> Column:
    """Ordered bucket of a key: its quantile, then an even cut of that quantile; null keys come last."""
    if not bounds:
        return F.lit(0).cast("bigint")
    rough = bounds[::32]
    lit = lambda xs: F.from_json(F.lit(str(xs)), "array<bigint>")  # noqa: E731  one literal after folding
    first = F.greatest(F.size(F.filter(lit(rough), lambda b: b <= key)) - 1, F.lit(0)) * 32
    fine = F.transform(F.array(first), lambda i: i - 1 + F.size(F.filter(
        F.slice(lit(bounds), i + 1, 32), lambda b: b <= key)))[0]
    at = F.greatest(fine, F.lit(0))

    def cut(i: Column) -> Column:
        low = F.get(lit(bounds), i).cast("double")
        high = F.coalesce(F.get(lit(bounds), i + 1).cast("double"), low + 1)
        inside = F.floor((key.cast("double") - low) / (high - low) * parts)
        return i * parts + F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1))

    place = F.transform(F.array(at), cut)[0]
    return F.when(key.isNull(), F.lit(len(bounds) * parts)).otherwise(place).cast("bigint")


def with_next(df: DataFrame, key: str, order: list[str], payload: list[str], prefix: str = "next_",
              bucket_rows: int = BUCKET_ROWS, derive=lambda rows: rows) -> DataFrame:
    """``derive(df)`` plus ``payload`` of the row that follows in order of ``key`` (an integer), then ``order``.

    Null keys come last; the last row is followed by the first one; a single
    row follows itself.  ``derive`` adds columns row by row; ``payload`` may
    name them.
    """
    keys = df.select(F.col(key).alias("k"))
    n = keys.count()
    probes = min(QUANTILES, max(1, n // bucket_rows))
    found = keys.agg(F.percentile_approx("k", [i / probes for i in range(probes)], 10 * QUANTILES).alias("q")).first().q
    bounds = sorted(set(found or []))
    parts = max(1, n // (bucket_rows * max(1, len(bounds))))
    heads = cut_lineage(keys.withColumn("_own", _bucket(F.col("k"), bounds, parts)).groupBy("_own").agg(
        F.min("k").alias("_head")))  # one row a bucket
    before = F.lag("_own").over(Window.orderBy("_own"))
    last = heads.agg(F.max("_own")).first()[0]
    heads = heads.select("_head", "_own", F.coalesce(before, F.lit(last)).alias("_before"))
    small = n // bucket_rows <= BROADCAST_HEADS
    first = df.withColumn("_own", _bucket(F.col(key), bounds, parts)).join(F.broadcast(heads) if small else heads, "_own")
    first = derive(first.filter(F.col(key).eqNullSafe(F.col("_head"))))
    names = [key, *order, *payload]
    first = first.groupBy("_before").agg(F.min(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])).alias("_h"))
    first = first.select(F.col("_before").alias("_bucket"), *[
        F.col("_h")[f"c{names.index(c)}"].alias(f"_h_{c}") for c in payload])
    # derived columns are made after the shuffle, which carries only the table's own
    rows = derive(df.withColumn("_bucket", _bucket(F.col(key), bounds, parts)).repartition("_bucket"))
    w = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_last(), *order)
    rows = rows.withColumns({"_more": F.lead(F.lit(True)).over(w), **{f"_l_{c}": F.lead(c).over(w) for c in payload}})
    rows = rows.join(first, "_bucket", "left")
    out = rows.withColumns({prefix + c: F.when(F.col("_more"), F.col(f"_l_{c}")).otherwise(F.col(f"_h_{c}"))
                            for c in payload})
    return out.drop("_bucket", "_more", *[f"_l_{c}" for c in payload], *[f"_h_{c}" for c in payload])
