"""Language-model scores by context-tree weighting over bytes (operator 6).

Model.  Each byte of a text (and an end mark, byte 0) is predicted from the
``DEPTH`` bytes before it.  The byte is decomposed into eight binary decisions;
each decision has a context tree whose nodes, at all depths from 0 to ``DEPTH``,
hold a Krichevsky-Trofimov estimate from the training texts.  A node's weight is
the posterior of stopping there, from the weighted block probabilities of its
subtree, so a prediction mixes the estimates of all depths along its path.  The
trained tree is applied without updates: a text's score is the sum of log10
probabilities of its bytes and end mark.

Work.  Documents are dealt into blocks of bounded size by a hash of the row,
compressed.  A block lists its distinct words and (DEPTH+1)-byte sequences with
their training counts; counts are summed over all blocks, the tree is weighted
bottom-up and mixed top-down, one shuffled aggregation or join for each depth,
and every block gets back the counts and probabilities of what it lists.  So the
corpus statistics are exact and complete, they grow with the corpus, and nothing
of them is broadcast or collected.  A word that occurs in one block only is not
sent: its block has its whole count.

The base score is the additively smoothed unigram model over lower-cased words.

Edge cases: null text is empty (its score is that of the end mark); without a
training text all counts are 0 and every bit has probability one half; repeated
rows score alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import documents, fold, slices
from .registry import register

DEPTH = 4
FOLDS = 5
HELD_OUT = 1
BLOCK_BYTES = 16 << 20  # text in a block, about
# Documents of a block turned into arrays at once, and their bytes (a longer text is taken alone); bounds a worker's memory.
SLICE_DOCS = 128
SLICE_BYTES = 1 << 18
SENT_BYTES = 1 << 20  # compressed chunks sent to Spark at once, about
END = b"\0"

SCORES = ("doc_id BIGINT, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, "
          "base_score DOUBLE, score DOUBLE, n_bytes BIGINT")


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                    ("n_bytes", pa.int64())])


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder (compressed, survives lost executors)."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- blocks

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Words are told apart by 128 bits: two polynomial hashes modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base, its powers and those of its inverse, up to ``n``."""
    def run(x: int) -> np.ndarray:
        steps = np.full(n, x, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)
    return [(run(b), run(pow(b, -1, 1 << 64))) for b in _BASES]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash) of each lower-cased (A-Z) word between ASCII white space, and words per text."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]).lower(), dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, stop = edge[::2], edge[1::2]
    lengths = np.array([len(t) + 1 for t in texts])
    words = np.diff(np.searchsorted(first, np.concatenate([[0], 1 + np.cumsum(lengths)])))
    value = data.astype(np.uint64) + np.uint64(1)
    powers = _powers(max(2 * SLICE_BYTES, 1 << len(data).bit_length()))
    found = []
    for up, down in powers:
        total = np.concatenate([[np.uint64(0)], np.cumsum(value * up[:len(value)], dtype=np.uint64)])
        found.append(((total[stop] - total[first]) * down[first]).view(np.int64))
    return found[0], found[1], words


def distinct_words(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash) of the distinct words in order, and each word's place among them (32 bits)."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] != a[:-1]
    if np.any((b[1:] != b[:-1]) & ~new[1:]):  # equal first hashes: order by both
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return a[new], b[new], place


def sequence_keys(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(key of each byte with the ``depth`` bytes before it, first position of each text); texts end with END."""
    pad = b"\0" * depth
    parts = [pad + t + END for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    lengths = np.array([len(p) for p in parts])
    key = data[:-depth].astype(np.int64)
    for back in range(depth - 1, -1, -1):
        key <<= 8
        key |= data[depth - back:len(data) - back]
    firsts = np.cumsum(lengths) - lengths
    real = np.ones(len(key), dtype=bool)
    for i in range(depth):  # positions that stand in the next text's padding
        real[firsts[1:] - depth + i] = False
    return key[real], firsts - depth * np.arange(len(parts))


def block_rows(docs: DataFrame, id_col: str, text_col: str, train: Column, blocks: int) -> DataFrame:
    """(block, payload): compressed chunks of documents, for one shuffle of less than the text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                       train.alias("train"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            at = batch.column("block").to_numpy(zero_copy_only=False)
            plain = batch.select(["doc_id", "text", "train"])
            names, payloads = [], []

            def sent() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(names, type=pa.int32()), pa.array(payloads, type=pa.binary())],
                                                  names=["block", "payload"])

            for block in np.unique(at):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, plain.schema, options=options) as out:
                    out.write_batch(plain.take(pa.array(np.flatnonzero(at == block))))
                names.append(block)
                payloads.append(sink.getvalue().to_pybytes())
                if sum(map(len, payloads)) > SENT_BYTES:
                    yield sent()
                    names, payloads = [], []
            if names:
                yield sent()

    return rows.mapInArrow(chunks, "block INT, payload BINARY")


def unpacked(payload: bytes) -> Iterator[pa.RecordBatch]:
    for batch in pa.ipc.open_stream(payload):
        for part in slices(batch, SLICE_DOCS):
            upto = np.cumsum([len(t.as_buffer()) for t in part.column("text")])
            first = 0
            while first < part.num_rows:
                before = upto[first - 1] if first else 0
                stop = max(first + 1, int(np.searchsorted(upto, before + SLICE_BYTES, side="right")))
                yield part.slice(first, stop - first)
                first = stop


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs (or their summed weights)."""
    order = None if weights is None else np.argsort(keys, kind="stable")
    ordered = np.sort(keys) if order is None else keys[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    if weights is None:
        return ordered[at], np.diff(np.append(at, len(ordered)))
    return ordered[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)


class BlockCounts:
    """Distinct words and byte sequences of a block with their training counts."""

    HELD = 1_000_000  # byte positions held before they are reduced to counts
    LISTS = 16  # lists of distinct words held before they become one

    def __init__(self):
        self.words: list[tuple] = []  # distinct words of some texts (both hashes) and their counts
        self.raw: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, texts: list[bytes], train: list[bool]) -> None:
        h1, h2, n = word_hashes(texts)
        a, b, place = distinct_words(h1, h2)
        self.words.append((a, b, np.bincount(place, np.repeat(train, n), minlength=len(a)).astype(np.int64)))
        if len(self.words) > self.LISTS:
            self.words = [self.word_counts()]
        for learn in (True, False):
            chosen = [t for t, x in zip(texts, train, strict=True) if x == learn]
            if chosen:
                keys = sequence_keys(chosen)[0]
                self.raw[learn].append(keys)
                self.held += len(keys)
        if self.held > self.HELD:
            self.reduce()

    def reduce(self) -> None:
        for learn, arrays in self.raw.items():
            if arrays:
                keys, n = counted(np.concatenate(arrays))
                self.parts.append((keys, n if learn else np.zeros(len(n), dtype=np.int64)))
                arrays.clear()
        self.held = 0
        if self.parts:
            self.parts = [counted(*(np.concatenate(x) for x in zip(*self.parts)))]

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        self.reduce()
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def word_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h1, h2, counts = (np.concatenate(x) for x in zip(*self.words))
        a, b, place = distinct_words(h1, h2)
        return a, b, np.bincount(place, counts, minlength=len(a)).astype(np.int64)


LISTED = "block INT, a BIGINT, b BIGINT, n BIGINT"  # words: both hashes; byte sequences: key and null


def listed(chunks: DataFrame) -> DataFrame:
    """(block, word or sequence, n): what each block holds, from chunks that are together by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts = None, BlockCounts()

        def rows(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(a), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(a[part]), block, dtype=np.int32)), pa.array(a[part]),
                    pa.nulls(len(a[part]), pa.int64()) if b is None else pa.array(b[part]), pa.array(n[part])],
                    names=["block", "a", "b", "n"])

        def out() -> Iterator[pa.RecordBatch]:
            yield from rows(*counts.word_counts())
            keys, n = counts.sequences()
            yield from rows(keys, None, n)

        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column("block")[i].as_py()
                if at != block:
                    if block is not None:
                        yield from out()
                    block, counts = at, BlockCounts()
                for part in unpacked(batch.column("payload")[i].as_py()):
                    counts.add(part.column("text").to_pylist(), part.column("train").to_pylist())
        if block is not None:
            yield from out()

    return chunks.repartition("block").sortWithinPartitions("block").mapInArrow(run, LISTED)


# ---------------------------------------------------------------- context trees

def _lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5: Stirling's series at x + 6."""
    y = x + 6
    shift = F.ln(x * (x + 1) * (x + 2)) + F.ln((x + 3) * (x + 4) * (x + 5))
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def kt_log(n0: Column, n1: Column) -> Column:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    estimate = _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)
    return F.when(n0 + n1 == 0, F.lit(0.0)).otherwise(estimate)


def _decisions(context: Column, byte: Column) -> Column:
    """The eight (context, path, bit) of a byte; a path is the bits before with a 1 in front."""
    steps = [F.struct(context.alias("context"),
                      F.lit(1 << j).bitwiseOR(F.shiftright(byte, 8 - j)).cast("int").alias("path"),
                      F.shiftright(byte, 7 - j).bitwiseAND(F.lit(1)).cast("int").alias("bit")) for j in range(8)]
    return F.explode(F.array(*steps))


def mixed_tree(sequences: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(context, path, one): mixed probability of a one bit at each node of full depth.

    ``sequences`` is (key, n): distinct (depth+1)-byte keys and their training counts.
    """
    bits = sequences.select("n", _decisions(F.shiftright("key", 8), F.col("key").bitwiseAND(F.lit(255))).alias("d"))
    nodes = bits.groupBy("d.context", "d.path").agg(
        F.sum(F.when(F.col("d.bit") == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("d.bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    levels = {depth: stored(nodes.withColumn("block_log", kt_log(F.col("n0"), F.col("n1")))
                            .withColumns({"stop": F.lit(1.0), "estimate": estimate}))}
    for d in range(depth - 1, -1, -1):
        up = F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1))
        nodes = levels[d + 1].groupBy(up.alias("context"), "path").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("block_log").alias("below"))
        nodes = nodes.withColumn("own", kt_log(F.col("n0"), F.col("n1")))
        top = F.greatest("own", "below")
        both = top + F.log1p(F.exp(F.least("own", "below") - top)) - math.log(2)
        nodes = nodes.withColumns({"block_log": both, "stop": 1 / (1 + F.exp(F.col("below") - F.col("own"))),
                                   "estimate": estimate}).drop("own", "below")
        levels[d] = stored(nodes)
    mixed = levels[0].select("context", "path", (F.col("stop") * F.col("estimate")).alias("one"),
                             (1 - F.col("stop")).alias("rest"))
    for d in range(1, depth + 1):
        above = mixed.select(F.col("context").alias("up"), F.col("path").alias("p"), "one", "rest")
        here = levels[d].withColumn("up", F.col("context").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)))
        here = here.join(above, (here.up == above.up) & (here.path == above.p))
        mixed = here.select("context", "path", (F.col("one") + F.col("rest") * F.col("stop") * F.col("estimate")).alias("one"),
                            (F.col("rest") * (1 - F.col("stop"))).alias("rest"))
    return mixed.select("context", "path", "one")


def sequence_scores(sequences: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, log10): log10 probability of each key's last byte after the bytes before it."""
    tree = mixed_tree(sequences, depth)
    bits = sequences.select("key", _decisions(F.shiftright("key", 8), F.col("key").bitwiseAND(F.lit(255))).alias("d"))
    bits = bits.select("key", "d.*").join(tree, ["context", "path"])
    return bits.groupBy("key").agg(F.sum(F.log10(F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one")))).alias("log10"))


# ---------------------------------------------------------------- scores

def _places(a: np.ndarray, b: np.ndarray, all_a: np.ndarray, all_b: np.ndarray) -> np.ndarray:
    """Place of each pair (a, b) among the ordered pairs (all_a, all_b); -1 if it isn't there."""
    at = np.searchsorted(all_a, a)
    found = np.full(len(a), -1, dtype=np.int64)
    open_ = at < len(all_a)
    while open_.any():  # more than once only where first hashes collide
        i = np.flatnonzero(open_)
        same = all_a[at[i]] == a[i]
        hit = same & (all_b[at[i]] == b[i])
        found[i[hit]] = at[i[hit]]
        at[i] += 1
        open_[i] = same & ~hit & (at[i] < len(all_a))
    return found


def block_scores(texts: pa.Table, table: pa.Table, n_train: int, tokens: int, unit: float) -> pa.Table:
    """Scores of a block's texts from the counts and probabilities of what it lists (``table``: a, b, value).

    Of the words only their places are kept from slice to slice, and the hashes of those that ``table`` lacks.
    """
    a, value = table.column("a").to_numpy(), table.column("value").to_numpy()
    is_word = np.asarray(table.column("b").is_valid())
    order = np.argsort(a[~is_word])
    key, log10 = a[~is_word][order], value[~is_word][order]
    w1, w2, total = a[is_word], table.column("b").drop_null().to_numpy(), value[is_word]
    del table, a, value
    order = np.lexsort((w2, w1))
    w1, w2, total = w1[order], w2[order], total[order]
    del order
    rows: list[tuple] = []
    words: list[tuple] = []
    alone: list[tuple] = []  # words of this block only: both hashes and counts
    sums: list[np.ndarray] = []
    for payload in texts.column("payload"):
        for part in unpacked(payload.as_buffer()):
            body = part.column("text").to_pylist()
            seq, firsts = sequence_keys(body)
            codes, uniques = pd.factorize(seq)
            at = np.minimum(np.searchsorted(key, uniques), max(len(key) - 1, 0))
            if len(key) == 0 or not np.array_equal(key[at], uniques):
                raise RuntimeError("a block lacks byte sequences of its own texts")
            sums.append(np.add.reduceat(log10[at][codes], firsts))
            learn = np.array(part.column("train").to_numpy(zero_copy_only=False))
            h1, h2, n = word_hashes(body)
            d1, d2, place = distinct_words(h1, h2)
            at = _places(d1, d2, w1, w2)
            lacks = at < 0
            alone.append((d1[lacks], d2[lacks], np.bincount(place, np.repeat(learn, n), minlength=len(d1))[lacks]))
            words.append((at.astype(np.int32), place, n))
            rows.append((part.column("doc_id").to_pylist(), learn, np.array([len(t) for t in body])))
    if not rows:
        return pa.Table.from_pylist([], schema=SCORED)
    train, n_bytes = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
    # the count of a word of this block only is its count here
    u1, _, where = distinct_words(np.concatenate([w[0] for w in alone]), np.concatenate([w[1] for w in alone]))
    own = np.bincount(where, np.concatenate([w[2] for w in alone]), minlength=len(u1))
    base, known_words, done = [], [], 0
    for at, place, n in words:
        lacks = at < 0
        count = np.empty(len(at))
        count[~lacks] = total[at[~lacks]]
        count[lacks] = own[where[done:done + lacks.sum()]]
        done += lacks.sum()
        first, has = np.cumsum(n) - n, n > 0
        b, k = np.zeros(len(n)), np.zeros(len(n), dtype=np.int64)
        if has.any():
            b[has] = np.add.reduceat((np.log10(count + 0.5) - unit)[place], first[has])
            k[has] = np.add.reduceat((count > 0)[place].astype(np.int64), first[has])
        base.append(b)
        known_words.append(k)
    base, known_words, n_words = np.concatenate(base), np.concatenate(known_words), np.concatenate([w[2] for w in words])
    end = math.log10(n_train + 0.5) - unit
    return pa.Table.from_arrays([
        pa.array([i for r in rows for i in r[0]], type=pa.int64()), pa.array(~train), pa.array(n_words + 1),
        pa.array(known_words + (n_train > 0)), pa.array(np.full(len(train), tokens)), pa.array(base + end),
        pa.array(np.concatenate(sums)), pa.array(n_bytes)], schema=SCORED)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of every text under the models learned from the rows where ``train`` holds."""
    spark: SparkSession = docs.sparkSession
    size = F.sum(F.octet_length(text_col).cast("bigint"))
    total, n_train = docs.agg(size, F.count_if(train)).first()
    blocks = max(1, -(-(total or 0) // block_bytes))
    chunks = block_rows(docs, id_col, text_col, train, blocks)
    # one row for each distinct word or sequence: its count, and the blocks that list it
    found = stored(listed(chunks).groupBy("a", "b").agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks")))
    words = found.filter("b IS NOT NULL")
    tokens, kinds = words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    tokens = (tokens or 0) + n_train
    kinds += n_train > 0
    known = words.filter(F.size("blocks") > 1).select("a", "b", F.col("n").cast("double").alias("value"),
                                                      F.explode("blocks").alias("block"))
    keys = found.filter("b IS NULL").select(F.col("a").alias("key"), "n", "blocks")
    logs = sequence_scores(keys.select("key", "n"))
    probable = keys.select("key", "blocks").join(logs, "key").select(
        F.col("key").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("log10").alias("value"),
        F.explode("blocks").alias("block"))
    given = known.unionByName(probable)
    unit = math.log10(tokens + 0.5 * (kinds + 1))

    def score(texts: pa.Table, table: pa.Table) -> pa.Table:
        return block_scores(texts, table, n_train, tokens, unit)

    return chunks.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(score, SCORES)


@register("op6_context_tree_scores")
def op6(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = score_texts(docs, fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    bits = -F.col("score") / math.log10(2) / F.greatest("n_bytes", F.lit(1))
    return out.withColumn("bits_per_byte", bits).drop("n_bytes")
