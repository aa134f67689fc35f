"""Byte-limited shards by extendible hashing (operator 8).

Rows are hashed to 60 bits.  A bucket is a hash prefix; it is split on one more
bit only while its rows are over the byte limit, so buckets differ in depth and
each one is a shard.  Sizes are summed over a histogram of prefixes a few bits
deeper than the average shard needs; buckets that are still over the limit there
get a deeper histogram of their own rows only.  The directory (histogram cell to
shard) has some dozens of cells per shard, whatever the number of rows, and is
joined, not collected.

Rows that agree in all 60 bits (one key that holds many rows) cannot be split by
hashing.  Their bucket gets overflow pages: rows are dealt over as many runs as
the limit asks for, and each run is cut by its running size.  Only a row that is
itself over the limit exceeds it, alone on its page.

Edge cases: null and empty texts weigh 0 bytes; null ids hash as empty text;
repeated rows are sharded one by one; an empty table gives no rows; extra
columns pass through, but for those with the names of result columns, which are
replaced (names that start with an underscore are used inside).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import documents
from .registry import register

HASH_BITS = 60
SHARD_BYTES = 16 << 20
EXTRA_BITS = 4  # histogram bits beyond those of shards of equal size


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 (keys as text; null as empty)."""
    text = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")


def _directory(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Depth of the shard of each cell (a prefix of ``high`` bits): the least one, from ``low``, that fits.

    Null where not even the cell itself fits.
    """
    at = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    at = at.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = at.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total")).filter(F.col("total") <= limit)
    found = at.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(found, "cell", "left")


def shards(rows: DataFrame, key: Column, size: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """``rows`` plus row_bytes, shard_id, shard_bits and page.

    ``shard_id`` is the hash prefix with a 1 in front (unique over all depths);
    ``page`` is 0 but for buckets of one hash over the limit.
    """
    made = {"row_bytes", "shard_id", "shard_bits", "page"}
    kept = [c for c in rows.columns if c.lower() not in made]
    # the row rides as one struct, so its names never meet those used here; _tie is its place in the input
    rows = rows.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), hash_bits(key).alias("_h"), size.cast("bigint").alias("row_bytes"),
                       F.monotonically_increasing_id().alias("_tie"))
    sizes = cut_lineage(rows.groupBy("_h").agg(F.sum("row_bytes").alias("b")))  # no texts
    total = sizes.agg(F.sum("b")).first()[0] or 0
    step = min(HASH_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit)))) + EXTRA_BITS)
    low, high, left, parts = 0, step, sizes, []
    while True:
        cell = F.shiftright("_h", HASH_BITS - high)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("b").alias("bytes"))
        found = cut_lineage(_directory(cells, low, high, limit).withColumn("bits", F.lit(high)))
        parts.append(found.filter("depth IS NOT NULL"))
        over = found.filter("depth IS NULL").select("cell")
        if high == HASH_BITS or over.isEmpty():
            break
        left = cut_lineage(left.join(over, F.shiftright("_h", HASH_BITS - high) == F.col("cell"), "left_semi"))
        low, high = high + 1, min(HASH_BITS, high + step)
    out = rows.withColumn("shard_bits", F.lit(None).cast("int"))
    for found in parts:  # one, unless some bucket needed a deeper histogram
        bits = found.select("bits").first()
        if bits is None:
            continue
        here = found.select(F.col("cell").alias("_cell"), F.col("depth").alias("_depth"))
        out = (out.join(here, F.shiftright("_h", HASH_BITS - bits[0]) == F.col("_cell"), "left")
               .withColumn("shard_bits", F.coalesce("shard_bits", "_depth")).drop("_cell", "_depth"))
    out = _paged(out, over if high == HASH_BITS else None, sizes, limit)
    shard = F.expr(f"shiftleft(1L, shard_bits) | shiftright(_h, {HASH_BITS} - shard_bits)")
    return out.select("_row.*", "row_bytes", shard.alias("shard_id"), "shard_bits", "page")


def _paged(out: DataFrame, over: DataFrame | None, sizes: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of the buckets (whole hashes) in ``over``; page 0 elsewhere."""
    if over is None or over.isEmpty():
        return out.withColumn("page", F.lit(0).cast("bigint"))
    runs = sizes.join(over, F.col("_h") == F.col("cell"), "left_semi").select(
        F.col("_h").alias("_o"), F.ceil(F.col("b") * 1.25 / limit).cast("bigint").alias("_runs"))
    out = out.join(runs, F.col("_h") == F.col("_o"), "left")
    fit = out.filter("_o IS NULL").withColumn("page", F.lit(0).cast("bigint"))
    hot = out.filter("_o IS NOT NULL").withColumn("_run", F.pmod(F.xxhash64("_tie"), "_runs"))
    w = Window.partitionBy("_h", "_run")
    before = F.sum("row_bytes").over(w.orderBy("row_bytes").rowsBetween(Window.unboundedPreceding, -1))
    # a page takes rows from one slot of its room; its last row may reach over by the largest row that fits
    largest = F.max(F.when(F.col("row_bytes") <= limit, F.col("row_bytes"))).over(w)
    room = F.greatest(F.lit(limit) - F.coalesce(largest, F.lit(0)), F.lit(1))
    hot = hot.withColumn("_at", F.floor(F.coalesce(before, F.lit(0)) / room))
    hot = hot.withColumn("page", 1 + F.col("_run") + F.col("_runs") * F.when(
        F.col("row_bytes") > limit, 1 + 2 * F.row_number().over(w.orderBy("row_bytes"))).otherwise(2 * F.col("_at")))
    hot = hot.withColumn("shard_bits", F.lit(HASH_BITS)).drop("_run", "_at")
    return fit.unionByName(hot).drop("_o", "_runs")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard and page; a shard is written by one task, which its limit bounds."""
    sharded.repartition("shard_id", "page").write.partitionBy("shard_id", "page").parquet(path)


QUERY_BYTES = 64 << 10  # of the registered query: small enough that the smallest tables split


@register("op8_extendible_hash_shards", sql=f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS row_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
lv AS (SELECT d.*, b.b FROM d, range(0, {HASH_BITS + 1}) AS b(b)),
fits AS (
  SELECT b, h >> ({HASH_BITS} - b)::INT AS p FROM lv GROUP BY 1, 2 HAVING sum(row_bytes) <= {QUERY_BYTES}),
leaf AS (
  SELECT doc_id, row_bytes, h, min(lv.b) AS bits
  FROM lv JOIN fits ON lv.b = fits.b AND lv.h >> ({HASH_BITS} - lv.b)::INT = fits.p
  GROUP BY doc_id, row_bytes, h)
SELECT doc_id, row_bytes, CAST(bits AS INTEGER) AS shard_bits,
       (1::BIGINT << bits::INT) | (h >> ({HASH_BITS} - bits)::INT) AS shard_id, CAST(0 AS BIGINT) AS page
FROM leaf""")
def op8(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = shards(docs, F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)), QUERY_BYTES)
    return out.select("doc_id", "row_bytes", "shard_bits", "shard_id", "page")
