"""Mixing sources to target weights by a low-discrepancy schedule (operator 11).

Sizes are words.  Sources, in code-point order with null last, get the weights of
a repeating cycle and share ``SHARE`` times all words; a target stops at
``PASSES`` times its source's size and the excess is shared again by weight.

The mix is a sequence of slots.  Slot i takes the i-th van der Corput point (the
bits of i reversed); the source whose stretch of the cumulative targets holds the
point fills the slot.  A slot's rank is the number of earlier slots of its source.
It needs no window: a stretch is a union of dyadic intervals, and the points of
the first i slots inside one of them are counted by one division.  A source whose
points come a few slots short (a low-discrepancy sequence is never more than a
few short) gets the missing ranks as extra slots, evenly placed.

Each source's documents are shuffled (by a hash of their ids) into one stream of
words, gone through up to ``PASSES`` times, and cut into blocks of ``BLOCK``
words; the last block ends where the target does.  The block of a rank fills the
slot of that rank, so the words taken of a source are its target, rounded, and a
document is taken at most ``PASSES`` times whole.

Nothing is collected but two sums per round of sharing.  A hot source is a
stretch of the sorted stream over many tasks (``sequence.running``), and blocks
meet slots by (source, rank), so no task holds a source.

Edge cases: null or empty text has size 0 and is taken 0; a null source is a
source of its own, the last one; repeated rows are documents of their own; null
ids sort as empty text; a table without words gets targets of 0; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import numbered, running
from ..session import cut_lineage
from .common import documents
from .registry import register

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix for each word of the table
PASSES = 2  # times a document may be taken
BLOCK = 4096  # words in a block
BITS = 40  # of a point
WORD = "[^\\x20\\x09-\\x0D]+"


def _shift(name: str, x: Column, by: Column | int) -> Column:
    return F.call_function(name, x, by if isinstance(by, Column) else F.lit(by))


def reversed_bits(x: Column) -> Column:
    """The lowest ``BITS`` bits of ``x`` in reverse: a van der Corput point in units of 2 ** -BITS."""
    return F.conv(F.reverse(F.lpad(F.bin(x), BITS, "0")), 2, 10).cast("bigint")


def _dyadic(bound: Column) -> Column:
    """[0, bound) as dyadic intervals: a point is inside one if its index is ``low`` modulo 2 ** ``level``."""
    def one(j: Column) -> Column:
        start = _shift("shiftleft", _shift("shiftright", bound, j + 1), j + 1)
        return F.struct((F.lit(BITS) - j).alias("level"), reversed_bits(start).alias("low"),
                        _shift("shiftright", bound, j).bitwiseAND(F.lit(1).cast("bigint")).alias("held"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(BITS)), one), lambda p: p["held"] == 1)


def _points(n: Column, intervals: Column) -> Column:
    """How many of the first ``n`` points lie in the intervals."""
    def add(acc: Column, p: Column) -> Column:
        return acc + _shift("shiftright", n + _shift("shiftleft", F.lit(1).cast("bigint"), p["level"]) - 1 - p["low"], p["level"])
    return F.aggregate(intervals, F.lit(0).cast("bigint"), add)


def targets(sized: DataFrame, source: str = "source", size: str = "size", weights: Sequence[int] = WEIGHTS,
            share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source: source, source_size, weight, target (double), s (its number in code-point order)."""
    per = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("source_size"))
    table = numbered(per, F.col("source").asc_nulls_last(), name="s")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    table = cut_lineage(table.withColumn("weight", F.get(cycle, (F.col("s") % len(weights)).cast("int"))))
    most = F.col("source_size") * passes
    total = table.agg(F.sum("source_size")).first()[0] or 0
    left, weight = share * total, None
    while True:  # each round finds sources whose share is over their limit; a few rounds in practice
        part = F.col("weight") * F.lit(float(left)) / F.lit(float(weight or 1))
        over = F.lit(False) if weight is None else part > most
        got = table.agg(F.sum(F.when(over, most).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        now = (share * total - (got[0] or 0), got[1] or 0)
        if now == (left, weight):
            return table.withColumn("target", F.when(over, most.cast("double")).otherwise(part))
        left, weight = now
        if weight == 0:
            return table.withColumn("target", most.cast("double"))


def schedule(spark: SparkSession, table: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: s, rank, at (order in the mix; extra slots lie between), drawn (by a point), from ``targets``."""
    need = table.withColumn("goal", F.floor(F.col("target") + 0.5).cast("bigint"))
    total = need.agg(F.sum("goal"), F.max("s")).first()
    words, sources = total[0] or 0, (total[1] or 0) + 1
    slots = -(-words // block)
    need = running(need, [], ["s"], {"before": "goal"}).withColumn("before", F.coalesce("before", F.lit(0)))
    edge = lambda x: F.floor(x / F.lit(float(max(words, 1))) * (1 << BITS)).cast("bigint")
    need = need.select("s", F.ceil(F.col("goal") / block).cast("bigint").alias("blocks"), edge(F.col("before")).alias("low"),
                       edge(F.col("before") + F.col("goal")).alias("high"))
    need = cut_lineage(need.withColumns({"low_parts": _dyadic(F.col("low")), "high_parts": _dyadic(F.col("high"))}))
    counted = lambda n: _points(n, F.col("high_parts")) - _points(n, F.col("low_parts"))

    cell_bits = min(BITS, sources.bit_length() + 2)  # at most some 9 cells a source
    cells = need.filter("high > low").withColumn("cell", F.explode(F.sequence(
        _shift("shiftright", F.col("low"), BITS - cell_bits), _shift("shiftright", F.col("high") - 1, BITS - cell_bits))))
    points = spark.range(slots).select(F.col("id").alias("slot"), reversed_bits(F.col("id")).alias("point"))
    points = points.withColumn("cell", _shift("shiftright", F.col("point"), BITS - cell_bits))
    drawn = points.join(cells, "cell").filter("point >= low and point < high")
    drawn = drawn.select("s", counted(F.col("slot")).alias("rank"), F.col("slot").cast("double").alias("at"),
                         F.lit(True).alias("drawn"), "blocks")
    short = need.withColumn("got", counted(F.lit(slots).cast("bigint"))).filter("got < blocks")
    extra = short.withColumn("rank", F.explode(F.sequence("got", F.col("blocks") - 1)))
    extra = extra.select("s", "rank", ((F.col("rank") + 0.5) / F.col("blocks") * slots).alias("at"),
                         F.lit(False).alias("drawn"), "blocks")
    return drawn.unionByName(extra).filter("rank < blocks").drop("blocks")


def placed(sized: DataFrame, table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents in their source's shuffled stream: one row each, with ``start``, the words before it."""
    rows = sized.groupBy(F.col(id_col).alias("doc_id"), "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({"key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
                             "words": F.col("size") * F.col("copies")})
    rows = running(rows, ["source"], ["key", "doc_id", "size"], {"start": "words"})
    number = table.select(F.col("source").alias("of"), "s", "source_size", "target")
    rows = rows.join(number, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    start = F.coalesce(F.col("start"), F.lit(0)) + F.col("copy") * F.col("size")
    return rows.select("doc_id", "source", "size", "copy", "s", "source_size", "target", start.alias("start"))


def pieces(rows: DataFrame, slots: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """The mix: columns of ``rows`` plus rank, at, first (word of the document) and length of each piece taken."""
    goal = F.floor(F.col("target") + 0.5).cast("bigint")
    again = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    again = again.withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size"))
    again = again.withColumn("end", F.least(F.col("begin") + F.col("size"), goal)).filter("end > begin")
    cut = again.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    met = cut.join(slots, ["s", "rank"])
    first = F.greatest(F.col("begin"), F.col("rank") * block)
    length = F.least(F.col("end"), (F.col("rank") + 1) * block) - first
    return met.select(*rows.columns, "rank", "at", (first - F.col("begin")).alias("first"), length.alias("length"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n.alias("size"))


def mix(docs: DataFrame, block: int = BLOCK, **names: str) -> DataFrame:
    """Pieces of the mix in the order of ``at``: doc_id, source, size, copy, rank, at, first, length."""
    sized = cut_lineage(sizes(docs, **names))  # the texts are read once
    table = targets(sized)
    return pieces(placed(sized, table), schedule(docs.sparkSession, table, block), block).drop("s", "start")


def taken(docs: DataFrame, block: int = BLOCK, **names: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words of the mix)."""
    sized = cut_lineage(sizes(docs, **names))
    table = targets(sized)
    rows = cut_lineage(placed(sized, table))
    parts = pieces(rows, schedule(docs.sparkSession, table, block), block).select(*rows.columns, "length")
    both = parts.unionByName(rows.withColumn("length", F.lit(0).cast("bigint")))
    keys = ["doc_id", "source", "copy", "size", "source_size", "target"]
    return both.groupBy(*keys).agg(F.sum("length").alias("taken")).drop("source", "copy")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source),
ordered AS (  -- sources that stop at their limit come first: limit over weight ascending
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS i FROM per),
sums AS (
  SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER w, 0) AS remaining,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
  FROM ordered WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT min(i) AS i FROM sums WHERE weight * remaining / weights <= 2 * source_size),
goals AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.i < f.i THEN (2 * s.source_size)::DOUBLE
              ELSE s.weight * r.remaining::DOUBLE / r.weights::DOUBLE END AS target
  FROM sums s, free f JOIN sums r ON r.i = f.i),
placed AS (
  SELECT z.doc_id, z.size, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS goal,
         coalesce(sum(z.size) OVER (PARTITION BY z.source
           ORDER BY md5(coalesce(z.doc_id::VARCHAR, '')), z.doc_id, z.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_
  FROM sized z JOIN goals g ON z.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(begin_ + size, goal) - begin_)
        + greatest(0, least(begin_ + source_size + size, goal) - begin_ - source_size))::BIGINT AS taken
FROM placed
"""


@register("op11_low_discrepancy_mix", SQL)
def op11(spark, sf_dir):
    return taken(documents(spark, sf_dir))
