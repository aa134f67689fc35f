"""Ranked lexical search for many queries at once, sharing what they have in common (operator 12).

Items (the queries) are dealt into blocks of about ``BLOCK_TERMS`` terms; a block
is searched in one pass over all documents.  Within a block shared term sets are
mined (``sharing_dag``):

1. terms that the very same items ask for form one class;
2. each item is a list of classes, the most asked for first; lists that begin
   alike share a path of a prefix tree, and a tree node that two or more items
   pass is the sum of its parent and one class;
3. an item is the deepest shared node of its list, plus the classes after it.

Scores add up over terms, so for each document the accumulators of classes and
nodes are computed once, in order along this graph, and each item adds up the few
it refers to (``additions`` compares the sums needed with and without sharing).
Documents are evaluated in slices as integer matrices; a task keeps ``k`` rows per
item, and what tasks keep is merged in two steps, so that no group of rows grows
with the number of tasks.

Statistics cover all documents: a first pass counts, for every document, its
terms and the occurrences of the block's terms; those postings are stored once,
and the number of documents, their length and the document frequencies are sums
over them.  Only a block's terms, their frequencies and the graph are broadcast;
their size is bounded by ``BLOCK_TERMS`` and the longest item.

Edge cases: null or empty text has no terms and counts nowhere; a text is read in
windows of ``WINDOW`` bytes that end between terms; rows of one item id are one
item with all their terms, a null id is one too; an item without terms, or with
terms that no document holds, has no rows; repeated documents each take a rank;
ties go to the smaller document id, null last; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import running
from ..session import cut_lineage
from .common import documents, slices
from .registry import register

K = 50
BLOCK_TERMS = 200_000  # terms of the items of a block, about
CELLS = 4_000_000  # of the matrices that are evaluated at once
WINDOW = 1 << 20  # bytes of a text whose terms are held at once
MERGED = 256  # tasks whose rows are merged first
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # the same over UTF-8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(text: str) -> Counter:
    """Occurrences of each term (UTF-8, A-Z in lower case) of a whole text."""
    data, found, at = text.encode("utf-8", "surrogatepass").lower(), Counter(), 0  # bytes.lower() changes A-Z only
    while at < len(data):
        end = min(at + WINDOW, len(data))
        if end < len(data):
            cut = _TERM.match(data, end - 1)  # a term that crosses the window's end belongs to it whole
            end = cut.end() if cut else end
        found.update(_TERM.findall(data, at, end))
        at = end
    return found


@dataclass
class Dag:
    """How the scores of a block's items share sums.  Values are classes first, then nodes."""

    classes: list[list[int]]  # terms of each class
    nodes: list[tuple[int, int]]  # (value it extends, class it adds), each after the values it needs
    items: list[list[int]]  # values that add up to each item

    def additions(self) -> tuple[int, int]:
        """Sums for one document: (each item on its own, along the graph)."""
        inside = [len(c) for c in self.classes]
        terms = lambda v: inside[v] if v < len(inside) else sum(map(terms, self.nodes[v - len(inside)]))
        plain = sum(sum(map(terms, values)) - 1 for values in self.items)
        return plain, sum(n - 1 for n in inside) + len(self.nodes) + sum(len(v) - 1 for v in self.items)


def sharing_dag(items: list[set[int]]) -> Dag:
    """Shared term sets of items (sets of term numbers, none empty), as a graph of sums."""
    asked = defaultdict(list)
    for i, terms in enumerate(items):
        for t in terms:
            asked[t].append(i)
    members = defaultdict(list)
    for t in sorted(asked):
        members[tuple(asked[t])].append(t)
    order = sorted(members, key=lambda who: (-len(who), who))  # the most asked for first
    lists = [[] for _ in items]
    for c, who in enumerate(order):
        for i in who:
            lists[i].append(c)
    # prefix tree: lists in order, so that those which begin alike are neighbours
    ranked = sorted(range(len(lists)), key=lambda i: lists[i])
    shared = [0] * len(lists)  # classes that a list's start has in common with another list
    for a, b in zip(ranked, ranked[1:]):
        alike = next((d for d, (x, y) in enumerate(zip(lists[a], lists[b])) if x != y), min(len(lists[a]), len(lists[b])))
        shared[a], shared[b] = max(shared[a], alike), max(shared[b], alike)
    nodes: list[tuple[int, int]] = []
    out: list[list[int]] = [[] for _ in lists]
    below: dict[tuple[int, int], int] = {}  # (value, class) -> node
    for i in ranked:
        value = lists[i][0]
        for c in lists[i][1:shared[i]]:
            if (value, c) not in below:
                below[value, c] = len(order) + len(nodes)
                nodes.append((value, c))
            value = below[value, c]
        out[i] = [value, *lists[i][max(shared[i], 1):]]
    return Dag([members[who] for who in order], nodes, out)


class Evaluator:
    """Scores of all items of a block for slices of documents, along the graph; keeps the best ``k`` per item."""

    def __init__(self, dag: Dag, weights: list[int], k: int):
        self.k, self.weights = k, np.asarray(weights, np.int64)
        self.n_terms, self.n_classes = len(weights), len(dag.classes)
        self.by_class = np.array([t for c in dag.classes for t in c], np.int64)
        self.class_at = np.cumsum([0] + [len(c) for c in dag.classes[:-1]])
        depth, levels = {}, defaultdict(list)
        for v, (parent, _) in enumerate(dag.nodes, self.n_classes):
            depth[v] = depth.get(parent, 0) + 1
            levels[depth[v]].append(v)
        self.levels = [(np.array(vs), np.array([dag.nodes[v - self.n_classes] for v in vs]).T) for _, vs in sorted(levels.items())]
        self.refs = np.array([v for values in dag.items for v in values], np.int64)
        self.item_at = np.cumsum([0] + [len(v) for v in dag.items[:-1]])
        self.values = self.n_classes + len(dag.nodes)
        self.rows_at_once = max(1, CELLS // (self.n_terms + self.values + len(self.refs)))
        self.best = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, null id, id
        self.least = np.ones(len(dag.items), np.int64)  # a score must reach it

    def add(self, ids: np.ndarray, no_id: np.ndarray, m: np.ndarray, terms: np.ndarray, tf: np.ndarray, row: np.ndarray) -> None:
        """``terms``, ``tf``, ``row``: postings of the slice; ``m``: length factor of each document."""
        x = np.zeros((self.n_terms, len(ids)), np.int64)
        x[terms, row] = self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
        v = np.zeros((self.values, len(ids)), np.int64)
        v[:self.n_classes] = np.add.reduceat(x[self.by_class], self.class_at, axis=0)
        for at, (parent, extra) in self.levels:
            v[at] = v[parent] + v[extra]
        scores = np.add.reduceat(v[self.refs], self.item_at, axis=0)
        item, doc = np.nonzero(scores >= self.least[:, None])
        new = [item, scores[item, doc], no_id[doc], ids[doc]]
        pool = [np.concatenate(p) for p in zip(self.best, new)]
        order = np.lexsort((pool[3], pool[2], -pool[1], pool[0]))
        item = pool[0][order]
        first = np.r_[0, np.flatnonzero(np.diff(item)) + 1] if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        order = order[place < self.k]
        self.best = [p[order] for p in pool]
        full = place == self.k - 1
        self.least[item[full]] = pool[1][np.lexsort((pool[3], pool[2], -pool[1], pool[0]))[full]]


def postings(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms of the text), term, tf (arrays: the given terms in the text); documents with terms only."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            for part in slices(batch):
                ids, ns, ts, fs = [], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = term_counts(text) if text else None
                    if found:
                        held = [(number[t], c) for t, c in found.items() if t in number]
                        ids.append(i)
                        ns.append(found.total())
                        ts.append([t for t, _ in held])
                        fs.append([c for _, c in held])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(ts, pa.list_(pa.int32())),
                                                  pa.array(fs, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id BIGINT, n BIGINT, term ARRAY<INT>, tf ARRAY<BIGINT>")


def _search_block(docs: DataFrame, names: list, wanted: list[set[bytes]], k: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, doc_id, score), the best ``k`` of each task; item: place in ``names``."""
    terms = sorted(set().union(*wanted))
    number = {t: i for i, t in enumerate(terms)}
    rows = cut_lineage(postings(docs, number, id_col, text_col))
    n_docs, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(rows.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect())  # a row a query term
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))]
    plan = docs.sparkSession.sparkContext.broadcast((sharing_dag([{number[t] for t in w} for w in wanted]), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ev = Evaluator(*plan.value, k)
        for batch in batches:
            for part in slices(batch, ev.rows_at_once):
                col = {c: part.column(i) for i, c in enumerate(part.schema.names)}
                n = col["n"].to_numpy()
                if int(n.max(initial=0)) * 50 * n_docs < 1 << 63:
                    m = 50 + 50 * n * n_docs // length
                else:
                    m = np.array([50 + 50 * int(x) * n_docs // length for x in n], np.int64)
                held = np.diff(col["term"].offsets.to_numpy())
                ev.add(col["doc_id"].fill_null(0).to_numpy(), col["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                       m, col["term"].flatten().to_numpy(), col["tf"].flatten().to_numpy(), np.repeat(np.arange(len(n)), held))
        item, score, none, ids = ev.best
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=none.astype(bool)),
                                          pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item INT, doc_id BIGINT, score BIGINT")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, item_col: str = "item_id",
           query_col: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    text = F.translate(F.col(query_col), UPPER, LOWER)
    asked = items.select(F.col(item_col).alias("item_id"), F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("t"))
    asked = cut_lineage(asked.distinct())
    per = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    per = running(per, [], [F.col("item_id").asc_nulls_first()], {"before": "n"})
    per = cut_lineage(per.withColumn("block", F.floor(F.coalesce("before", F.lit(0)) / block_terms)))
    found = None
    for number in range((per.agg(F.max("block")).first()[0] or 0) + 1):  # blocks of queries, each against all rows
        block = per.filter(F.col("block") == number).withColumnRenamed("item_id", "of")
        rows = asked.join(block, F.col("item_id").eqNullSafe(F.col("of"))).groupBy("item_id").agg(F.collect_list("t").alias("t"))
        rows = rows.orderBy("item_id").collect()  # at most block_terms terms and one item
        if not rows:
            continue
        best = _search_block(docs, [r[0] for r in rows], [{t.encode() for t in r[1]} for r in rows], k, id_col, text_col)
        names = docs.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "item INT, item_id BIGINT")
        best = best.withColumn("part", F.floor(F.spark_partition_id() / MERGED))
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        for by in (["item", "part"], ["item"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    empty = docs.sparkSession.createDataFrame([], "item_id BIGINT, rank INT, doc_id BIGINT, score BIGINT")
    return empty if found is None else found


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT row_id, doc_id, t, len(t)::BIGINT AS n FROM words WHERE len(t) > 0),
sums AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM docs),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (
  SELECT row_id, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row_id, doc_id, n, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), sums),
scored AS (
  SELECT item_id, row_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // length))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN wanted USING (term), sums GROUP BY item_id, row_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@register("op12_shared_query_search", SQL)
def op12(spark, sf_dir):
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
