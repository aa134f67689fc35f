"""SimHash near-duplicates with BK-trees (operator 5).

Fingerprint: words between ASCII white space of the text with A-Z lower-cased,
shingles of three words (repeats count), XXH64 with seed 42 of each; a bit is
set if over half of the hashes have it.  No words: zero.

Links (distance 3 or less) are found over distinct fingerprints.  The 64 bits
are cut into ``agree + 3`` blocks; two linked fingerprints agree in at least
``agree`` whole blocks, so each fingerprint goes to one shard for each choice
of ``agree`` blocks and no link is lost.  ``agree`` grows with the number of
fingerprints, which keeps shards small at any size.  Each shard is a BK-tree
(children keyed by their distance to the parent; a search follows only edges
within the radius).  Trees grow with the data, so they are not Spark
broadcasts: a shard over ``TREE_NODES`` is dealt over several trees, and its
fingerprints are sent to each of them as queries.

A tree keeps the components of its own nodes, and a search skips subtrees that
lie wholly in a component it has already met.  So a dense cluster costs one link
per node, not one per pair, and a shard sends on a spanning forest only;
components over all shards follow by stars (graph.py).

Edge cases: null or empty texts have fingerprint zero and are linked like any
other; a null id never names a component (a component of null ids only has a
null id); repeated rows share fingerprint and component; an empty table gives no
rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import append_columns, documents, fresh_name
from .graph import connected_components
from .registry import register

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
TREE_NODES = 4096
SHARD_ROWS = 16  # fingerprints expected in a shard
_U64 = (1 << 64) - 1


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> list[int]:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = (np.cumsum([len(p) for p in parts]) + np.arange(len(parts))).tolist()
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:])]


def majority(hashes: list[int], block: int = 1 << 16) -> int:
    """64 bits as a signed integer: those set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), block):
        h = np.array(hashes[i:i + block], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint",
                     words: int = SHINGLE_WORDS) -> DataFrame:
    """All columns of ``docs`` plus the fingerprint as a 64-bit integer."""
    def start():
        return lambda texts: [[majority(shingle_hashes(t, words)) for t in texts]]
    return append_columns(docs, text_col, [(out, T.LongType(), pa.int64())], start)


class BKTree:
    """Fingerprints under their Hamming distances, with the components they form."""

    def __init__(self, radius: int):
        self.radius = radius
        self.keys: list[int] = []
        self.kids: list[dict[int, int]] = []
        self.parent: list[int] = []  # union-find over nodes
        self.uniform: list[bool] = []  # the subtree lies in one component
        self._tidy_at = 64

    def component(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def near(self, x: int) -> set[int]:
        """Components with a node within the radius of ``x``."""
        found: set[int] = set()
        if not self.keys:
            return found
        r, keys, kids, uniform, component = self.radius, self.keys, self.kids, self.uniform, self.component
        stack = [0]
        while stack:
            i = stack.pop()
            if uniform[i] and found and component(i) in found:
                continue
            d = (x ^ keys[i]).bit_count()
            if d <= r:
                found.add(component(i))
                if uniform[i]:
                    continue
            for edge, child in kids[i].items():
                if d - r <= edge <= d + r:
                    stack.append(child)
        return found

    def add(self, x: int, linked: set[int]) -> None:
        """Insert ``x``, which joins the components in ``linked``; a component is named by its oldest node,
        so the links sent on are stars, which need few rounds to settle."""
        new, at, path = len(self.keys), 0, []
        while new:
            path.append(at)
            d = (x ^ self.keys[at]).bit_count()
            if d == 0:
                return
            if d not in self.kids[at]:
                self.kids[at][d] = new
                break
            at = self.kids[at][d]
        self.keys.append(x)
        self.kids.append({})
        root = min(linked, default=new)
        self.parent.append(root)
        self.uniform.append(True)
        for c in linked:
            self.parent[c] = root
        for i in path:
            if self.uniform[i] and self.component(i) != root:
                self.uniform[i] = False
        if len(self.keys) >= self._tidy_at:
            self._tidy_at *= 2
            for i in range(len(self.keys) - 1, -1, -1):
                mine = self.component(i)
                self.uniform[i] = all(self.uniform[c] and self.component(c) == mine for c in self.kids[i].values())


def agreeing_blocks(n: int, radius: int) -> int:
    """Blocks that must agree so that a shard of ``n`` spread fingerprints stays small."""
    agree = 1
    while n / 2 ** (64 * agree / (agree + radius)) > SHARD_ROWS and agree < 4:
        agree += 1
    return agree


def block_masks(agree: int, radius: int) -> list[int]:
    """Masks over each choice of ``agree`` of ``agree + radius`` blocks, as signed integers."""
    edges = [64 * i // (agree + radius) for i in range(agree + radius + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(u, v): a forest that spans all links between the distinct ``fingerprint`` values."""
    masks = block_masks(agreeing_blocks(distinct.count(), radius), radius)
    sent = distinct.select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("bigint")).alias("bits"))
        for i, m in enumerate(masks)])).alias("s")).select("fingerprint", "s.*")
    large = (sent.groupBy("choice", "bits").count().filter(F.col("count") > tree_nodes)
             .select("choice", "bits", F.ceil(F.col("count") / tree_nodes).cast("int").alias("trees")))
    own = F.pmod(F.xxhash64("fingerprint"), F.coalesce("trees", F.lit(1))).cast("int")
    # a tree answers for its own nodes and for those of the shard's later trees
    sent = (sent.join(large, ["choice", "bits"], "left").withColumn("own", own)
            .withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("own"))))
            .select("choice", "bits", "tree", (F.col("tree") != F.col("own")).alias("query"), "fingerprint"))
    sent = (sent.repartition("choice", "bits", "tree")
            .sortWithinPartitions("choice", "bits", "tree", "query", "fingerprint"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, BKTree(radius)
        for batch in batches:
            u, v = [], []
            for choice, bits, part, query, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (choice, bits, part) != shard:
                    shard, tree = (choice, bits, part), BKTree(radius)
                x = fp & _U64
                near = tree.near(x)
                u += [fp] * len(near)
                v += [tree.keys[c] for c in near]
                if not query:
                    tree.add(x, near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, type=pa.int64()), pa.array(np.array(v, dtype="<u8").view("<i8"))], names=["u", "v"])

    return sent.mapInArrow(search, "u BIGINT, v BIGINT")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint as a 64-bit integer, component_id: the smallest id it reaches)."""
    prints = cut_lineage(
        with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words=words)
        .select("doc_id", "fingerprint"))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct, radius)).withColumnRenamed("u", "fingerprint")
    rooted = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(named, "root").select("fingerprint", "component_id")
    return prints.join(member, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest fingerprint."""
    groups = cut_lineage(near_duplicates(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint")
    # components of null ids only have no name: their rows are told apart by fingerprint
    kept = (groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f"))
            .agg(F.min(order).alias("first")).select("first.*"))
    key = [fresh_name(docs, n) for n in ("kept_id", "kept_no_id", "kept_print")]
    kept = kept.select(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "fingerprint").toDF(*key)
    id_ = F.col(id_col).cast("bigint")
    rows = with_fingerprint(docs, text_col, key[2]).withColumns({key[0]: F.coalesce(id_, F.lit(0)), key[1]: id_.isNull()})
    rows = rows.join(kept, key, "left_semi")
    repeated = groups.groupBy("doc_id", "fingerprint").count().filter("count > 1")
    if not repeated.isEmpty():  # rows that share id and fingerprint: any one of them stays
        rows = rows.dropDuplicates(key)
    return rows.select(*docs.columns)


@register("op5_simhash_bk_tree")
def op5(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
