"""Prefix trie of conversations by burst tries (operator 13).

A conversation is a sequence of turns; every sequence of first turns that some
conversation starts with is a node.  A turn's id is a 128-bit hash of role and
text; a prefix's id is the xor of its turns' ids, each hashed with its place, so
the ids of all prefixes are running xors, also over a conversation of any length.

- A **container** holds the suffixes of the conversations under one trie head.  It
  is oversized if they have more than ``CONTAINER`` turns together; then it bursts
  by next turn id: its prefix becomes a head, and each next turn a container of its
  own.  ``burst`` starts at the root and looks at ``STEP`` levels at a time (twice
  as many in each round), only at conversations whose containers are still
  oversized, until none is.
- The **remaining containers** are dealt to shards, sorted by their suffixes, and
  swept once (``_sweep``): a suffix that shares d turns with the one before it
  closes the open nodes below depth d.  A sweep holds one container.
- The heads form a small tree of their own.  Sums over subtrees climb it by
  pointer jumping: in round k each head adds its sum to the one 2 ** k levels up,
  so a chain of n heads takes log2 n rounds.
- A node's list of ended conversations may hold any share of the table (copies);
  it is cut into ordered pieces that are joined in parallel and hashed one after
  the other, so no task holds a list.

Edge cases: null role or text is empty; null turns come first, equal turns in the
order of the hashes of role and text; repeated rows are turns of their own; rows
without a conversation id are no conversation; the root is always there if any
conversation is; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import running
from ..session import cut_lineage
from .registry import register

CONTAINER = 4096  # turns in a container
STEP = 16  # levels that the first round of bursts looks at
ENDS = 4096  # conversation ids in a piece of a list
_NODE = ("conv_id BIGINT, depth BIGINT, parent_conv_id BIGINT, n_convs BIGINT, n_children BIGINT, n_leaves BIGINT, "
         "saved_tokens BIGINT, ends_sha256 STRING")
NONE_ENDED = hashlib.sha256(b"").hexdigest()


def turn_rows(table: DataFrame) -> DataFrame:
    """conv_id, at (place from 1 in its conversation), a, b (the turn's id), chars: one row per turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = table.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("second half"), text, role).alias("b"), F.char_length(text).cast("bigint").alias("chars"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    rows = running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "a", "b"], {"before": "copies"})
    first = F.coalesce("before", F.lit(0)) + 1
    return rows.select("conv_id", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("at"), "a", "b", "chars")


def rebuilt(rows: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Rebuilt conversations, one row per turn, and the root of each at place 0 (without a turn).

    Conversation c starts with the first h turns of conversation c - c % ``group``
    and goes on with its own turns after the first h; h: crc32 of c in decimal
    modulo ``most``.  Columns: conv_id, at, a, b, chars, n (turns of the conversation).
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("bigint")
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    opening = rows.filter((F.col("at") < most) & (F.col("conv_id") % group == 0)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "a", "b", "chars"))).alias("opening"))  # fewer than ``most`` turns
    convs = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    convs = convs.join(opening.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.coalesce(F.filter("opening", lambda t: t["at"] <= F.col("h")), F.array().cast("array<struct<at:bigint,a:bigint,b:bigint,chars:bigint>>"))
    convs = convs.select("conv_id", "h", taken.alias("opening"),
                         (F.size(taken) + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("bigint").alias("n"))
    root = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("at", "a", "b", "chars")])
    start = convs.select("conv_id", "n", F.explode(F.concat(F.array(root), "opening")).alias("t")).select("conv_id", "t.*", "n")
    rest = rows.join(convs.select("conv_id", "h", "n", F.size("opening").alias("shift")), "conv_id").filter(F.col("at") > F.col("h"))
    return start.unionByName(rest.select("conv_id", (F.col("at") - F.col("h") + F.col("shift")).alias("at"), "a", "b", "chars", "n"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Rows of ``rebuilt`` with the ids of their prefix (pa, pb) and of the prefix before it (qa, qb)."""
    at = F.col("at")
    rows = rows.withColumns({"fa": F.when(at > 0, F.xxhash64(at, "a", "b")).otherwise(0),
                             "fb": F.when(at > 0, F.xxhash64(F.lit("second half"), at, "b", "a")).otherwise(0)})
    rows = running(rows, ["conv_id"], ["at"], {"pa": "fa", "pb": "fb"}, F.bit_xor, through=True)
    return rows.select("conv_id", "at", "n", "chars", "pa", "pb", F.col("pa").bitwiseXOR(F.col("fa")).alias("qa"),
                       F.col("pb").bitwiseXOR(F.col("fb")).alias("qb"))


def burst(rows: DataFrame, container: int = CONTAINER, step: int = STEP) -> DataFrame:
    """Heads: pa, pb, qa, qb, depth, conv_id, n_convs, chars of each prefix whose container is oversized, and of the root."""
    rooted = rows.filter("at = 0").groupBy("pa", "pb", "qa", "qb").agg(
        F.lit(0).cast("bigint").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.lit(0).cast("bigint").alias("chars"))
    found, low, alive = cut_lineage(rooted), 0, rows
    while True:
        level = alive.filter((F.col("at") > low) & (F.col("at") <= low + step))
        heads = cut_lineage(level.groupBy("pa", "pb", "qa", "qb").agg(
            F.min("at").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.min("chars").alias("chars"), F.sum(F.col("n") - F.col("at") + 1).alias("turns")
        ).filter(F.col("turns") > container).drop("turns"))
        found = found.unionByName(heads)
        low += step
        open_ = heads.filter(F.col("depth") == low)
        if open_.isEmpty():
            return found
        still = alive.filter(F.col("at") == low).join(open_.select("pa", "pb"), ["pa", "pb"], "left_semi").select("conv_id")
        alive = cut_lineage(alive.filter(F.col("at") > low).join(still, "conv_id", "left_semi"))
        step *= 2


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def _sweep(suffixes: list[tuple[int, int, list, list]]) -> Iterator[tuple]:
    """Nodes of one container: suffixes (conv_id, depth of the first node, ids of the prefixes, chars), sorted by ids."""
    nodes, open_ = [], []  # a node: [conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends, chars, id]

    def close(keep: int) -> None:
        while len(open_) > keep:
            x = open_.pop()
            x[5] = x[5] or 1
            x[6] += (x[3] - 1) * x[8]
            if open_:
                up = open_[-1]
                up[4], up[5], up[6] = up[4] + 1, up[5] + x[5], up[6] + x[6]

    for conv, depth, ids, chars in suffixes:
        alike = next((d for d, x in enumerate(open_) if d == len(ids) or x[9] != ids[d]), len(open_))
        close(alike)
        for d in range(alike, len(ids)):
            x = [conv, depth + d, open_[-1] if open_ else None, 0, 0, 0, 0, [], chars[d], ids[d]]
            open_.append(x)
            nodes.append(x)
        for x in open_:
            x[0], x[3] = min(x[0], conv), x[3] + 1
        open_[-1][7].append(conv)
    close(0)
    for x in nodes:
        yield x[0], x[1], x[2] and x[2][0], x[3], x[4], x[5], x[6], _digest(x[7])


def swept(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes of all containers; qa, qb: the head above a container's first node, null for the others."""
    held = rows.join(heads.select("pa", "pb"), ["pa", "pb"], "left_semi").groupBy("conv_id").agg(F.max("at").alias("head"))
    rest = rows.join(held, "conv_id").filter(F.col("at") > F.col("head"))
    one = F.struct("at", "pa", "pb", "chars", "qa", "qb")
    suffix = rest.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("s"))  # at most a container's turns
    first = F.col("s")[0]
    suffix = suffix.select("conv_id", first["at"].alias("depth"), first["qa"].alias("qa"), first["qb"].alias("qb"), F.transform(
        "s", lambda t: F.struct(t["pa"].alias("a"), t["pb"].alias("b"))).alias("ids"), F.transform("s", lambda t: t["chars"]).alias("chars"))
    top = F.col("ids")[0]
    suffix = suffix.repartition(top["a"], top["b"]).sortWithinPartitions("ids", "conv_id")
    schema = _NODE + ", qa BIGINT, qb BIGINT"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, top, up, out = [], None, None, []

        def flush() -> None:
            for i, node in enumerate(_sweep(held)):
                out.append((*node, *(up if i == 0 else (None, None))))

        def batch_of(found: list) -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64())
                                               for c, n in zip(cols, names)], names=names)

        for batch in batches:
            for conv, depth, qa, qb, ids, chars in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                ids = [(x["a"], x["b"]) for x in ids]
                if ids[0] != top:
                    flush()
                    held, top, up = [], ids[0], (qa, qb)
                held.append((conv, depth, ids, chars))
            yield batch_of(out)
            out = []
        flush()
        yield batch_of(out)

    return suffix.select("conv_id", "depth", "qa", "qb", "ids", "chars").mapInArrow(run, schema)


def ended(rows: DataFrame, heads: DataFrame, piece: int = ENDS) -> DataFrame:
    """pa, pb, ends_sha256 of the heads where conversations end."""
    last = rows.filter("at = n").join(heads.select("pa", "pb"), ["pa", "pb"], "left_semi").select("pa", "pb", "conv_id")
    last = running(last.withColumn("one", F.lit(1)), ["pa", "pb"], ["conv_id"], {"before": "one"})
    last = last.withColumn("piece", F.floor(F.coalesce("before", F.lit(0)) / piece))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = last.groupBy("pa", "pb", "piece").agg(joined.alias("ids"))
    parts = parts.repartition("pa", "pb").sortWithinPartitions("pa", "pb", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def batch_of(found: list) -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                              names=["pa", "pb", "ends_sha256"])

        for batch in batches:
            out = []
            for a, b, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)]):
                if (a, b) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(ids.encode())
            yield batch_of(out)
        yield batch_of([(*key, state.hexdigest())] if key is not None else [])

    return parts.select("pa", "pb", "piece", "ids").mapInArrow(run, "pa BIGINT, pb BIGINT, ends_sha256 STRING")


def climbed(heads: DataFrame) -> DataFrame:
    """Heads with ``n_leaves`` and ``saved_tokens`` summed over the heads of their subtrees, by pointer jumping."""
    depth = heads.agg(F.max("depth")).first()[0] or 0
    jump = F.struct(F.col("qa").alias("a"), F.col("qb").alias("b"))
    heads = cut_lineage(heads.withColumn("up", F.when(F.col("depth") > 0, jump)))
    for _ in range(int(depth).bit_length()):
        sent = heads.filter("up is not null").groupBy(F.col("up.a").alias("pa"), F.col("up.b").alias("pb")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        above = heads.select(F.col("pa").alias("ua"), F.col("pb").alias("ub"), F.col("up").alias("next"))
        onward = F.when((F.col("up.a") == F.col("ua")) & (F.col("up.b") == F.col("ub")), F.col("next"))
        heads = cut_lineage(
            heads.join(sent, ["pa", "pb"], "left")
            .join(above, (F.col("up.a") == F.col("ua")) & (F.col("up.b") == F.col("ub")), "left")
            .withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)),
                          "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)), "up": onward})
            .drop("more_leaves", "more_saved", "ua", "ub", "next"))
    return heads.drop("up")


def trie(sequences: DataFrame, container: int = CONTAINER, step: int = STEP) -> DataFrame:
    """One row per node of the prefix trie of ``sequences`` (as ``rebuilt`` returns them)."""
    rows = cut_lineage(prefixes(sequences))
    heads = cut_lineage(burst(rows, container, step))
    nodes = cut_lineage(swept(rows, heads))
    below = nodes.filter("qa is not null").groupBy(F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = heads.filter("depth > 0").groupBy(F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count(F.lit(1)).alias("inner"))
    tops = heads.join(below, ["pa", "pb"], "left").join(inner, ["pa", "pb"], "left")
    children = F.coalesce("containers", F.lit(0)) + F.coalesce("inner", F.lit(0))
    tops = tops.select("pa", "pb", "qa", "qb", "depth", "conv_id", "n_convs", children.alias("n_children"),
                       F.when(children == 0, 1).otherwise(F.coalesce("leaves", F.lit(0))).cast("bigint").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
    tops = climbed(tops).join(ended(rows, heads), ["pa", "pb"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NONE_ENDED)))
    names = [x.split()[0] for x in _NODE.split(", ")]
    name = heads.select(F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv_id").alias("above"))
    outer = tops.withColumns({"qa": F.when(F.col("depth") > 0, F.col("qa")), "qb": F.when(F.col("depth") > 0, F.col("qb"))})
    outer = outer.join(name, ["qa", "qb"], "left").withColumn("parent_conv_id", F.col("above")).select(*names)
    first = nodes.filter("qa is not null").join(name, ["qa", "qb"]).withColumn("parent_conv_id", F.col("above")).select(*names)
    return outer.unionByName(first).unionByName(nodes.filter("qa is null").select(*names))


SQL = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
               lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, o.pos + 10, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth,
         md5(len(role)::VARCHAR || ':' || role || text) AS turn, len(text) AS chars FROM turns),
paths AS (
  SELECT conv_id, 0 AS depth, [] ::VARCHAR[] AS path, 0 AS chars FROM convs
  UNION ALL
  SELECT conv_id, depth, list(turn) OVER (PARTITION BY conv_id ORDER BY depth) AS path, chars FROM placed),
lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
nodes AS (
  SELECT p.path, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.chars) AS chars,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = l.n), '')) AS ends_sha256
  FROM paths p JOIN lengths l USING (conv_id) GROUP BY p.path),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
sums AS (
  SELECT path[1:up] AS path, sum((n_children = 0)::INTEGER) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (path) LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]
"""


@register("op13_burst_trie", SQL)
def op13(spark, sf_dir):
    return trie(rebuilt(turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
