"""Byte-level BPE encoding and decoding (operator 2).

Two tiers.  A minimal perfect hash over the vocabulary resolves pre-tokens that
are tokens themselves; all others are merged by rank with a heap over a linked
list of their bytes.  The hash (hash and displace: one displacement per bucket,
so that every token owns one slot of exactly as many slots as tokens) and the
table of mergeable pairs are built once on the driver from the rank file and
broadcast; both are bounded by the vocabulary, whatever the data.

Workers remember the ids of text chunks between spaces.  A text is cut before
each space that is followed by something else than white space, which is always
an edge of a pre-token; texts with a space followed by white space are
pre-tokenised whole.

Edge cases: null text is empty and has no ids; repeated rows and ties give
equal rows; an empty table gives no rows; extra columns are ignored by the
query and kept by ``encode_texts``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, append_columns, documents, fresh_name
from .registry import register

MEMO_CHUNKS = 800_000  # distinct chunks whose ids a worker remembers
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?*$%&#\"')|]*)").fullmatch
_MASK = (1 << 64) - 1


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash from byte strings to values, by hash and displace."""

    def __init__(self, values: dict[bytes, int], per_bucket: int = 1):
        n = len(values)
        self.n, self.n_buckets = n, max(1, n // per_bucket)
        self.displace = np.zeros(self.n_buckets, dtype=np.int64).tolist()
        self.keys: list[bytes] = [b""] * n
        self.values: list[int] = [-1] * n
        buckets: list[list[bytes]] = [[] for _ in range(self.n_buckets)]
        for key in values:
            buckets[xxhash.xxh64_intdigest(key) % self.n_buckets].append(key)
        taken = bytearray(n)
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            if not buckets[b]:
                break
            if len(buckets[b]) == 1:  # a single key takes any free slot, named directly
                if free is None:
                    free = (i for i in range(n) if not taken[i])
                slots, d = [next(free)], None
                self.displace[b] = -1 - slots[0]
            else:
                hashes, d = [xxhash.xxh64_intdigest(k) for k in buckets[b]], 0
                while True:
                    slots = [self._slot(h, d) for h in hashes]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.displace[b] = d
            for key, s in zip(buckets[b], slots, strict=True):
                taken[s], self.keys[s], self.values[s] = 1, key, values[key]

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
        return (x ^ (x >> 29)) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1 when it is not among the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.displace[h % self.n_buckets]
        s = -1 - d if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


class BytePairTables:
    """What workers need: the perfect hash, mergeable pairs of ids, bytes by id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.whole = PerfectHash(ranks)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.pairs: list[dict[int, int]] = [{}] * len(self.bytes_of)  # by left id: right id -> id of both joined
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut], -1), ranks.get(token[cut:], -1)
                if left >= 0 and right >= 0:
                    if not self.pairs[left]:
                        self.pairs[left] = {}
                    self.pairs[left][right] = rank


def merge_bytes(data: bytes, single: list[int], pairs: list[dict[int, int]]) -> list[int]:
    """Ids of a pre-token: lowest rank first, leftmost among equals, by a heap over linked bytes.

    ``rank`` holds what each place's pair would merge to now; heap items that
    differ from it are out of date.
    """
    ids = [single[b] for b in data]
    if -1 in ids:
        raise ValueError("the vocabulary lacks a byte of this text")
    n = len(ids)
    rank = [pairs[a].get(b) for a, b in zip(ids, ids[1:])]
    heap = [(r, i) for i, r in enumerate(rank) if r is not None]
    if not heap:
        return ids
    heapify(heap)
    rank.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        r, i = heappop(heap)
        if rank[i] != r:
            continue
        j = after[i]
        ids[i], ids[j], rank[i], rank[j] = r, -1, None, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            q = rank[i] = pairs[r].get(ids[k])
            if q is not None:
                heappush(heap, (q, i))
        h = before[i]
        if h >= 0:
            q = rank[h] = pairs[ids[h]].get(r)
            if q is not None:
                heappush(heap, (q, h))
    return [x for x in ids if x >= 0]


def as_ids(ids: tuple[int, ...]) -> tuple[int, ...]:
    return ids


class Encoder:
    """Ids of texts, by chunks between spaces; what ``finish`` makes of a chunk's ids is remembered."""

    def __init__(self, tables: BytePairTables, finish=as_ids):
        import regex
        self.t, self.finish = tables, finish
        self.find = regex.compile(tables.pattern).findall
        # letters, then punctuation: the usual pattern's two pre-tokens
        self.plain = PLAIN if tables.pattern == split_pattern() else lambda _: None
        self.pieces = Memo(self.pretoken, MEMO_CHUNKS)
        self.first = Memo(self.chunk, MEMO_CHUNKS)  # chunk at the start of a text
        self.after = Memo(self.spaced, MEMO_CHUNKS)  # chunk after a space, which belongs to it

    def pretoken(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        rank = self.t.whole.get(data)
        return (rank,) if rank >= 0 else tuple(merge_bytes(data, self.t.single, self.t.pairs))

    def chunk(self, text: str):
        return self.finish(tuple(chain.from_iterable(map(self.pieces.__getitem__, self.find(text)))))

    def spaced(self, text: str):
        """For the chunk after a space; None if white space follows, where the space may belong to another pre-token."""
        if not text or text[0].isspace():
            return None
        split = self.plain(text)
        if split is None:
            return self.chunk(" " + text)
        letters, tail = split.groups()
        ids = self.pieces[" " + letters]
        return self.finish(ids + self.pieces[tail] if tail else ids)

    def chunks(self, text: str) -> list:
        """What ``finish`` makes of the ids of each chunk, in order."""
        if not text:
            return []
        head, *tail = text.split(" ")
        found = list(map(self.after.__getitem__, tail))
        if None in found:
            return [self.chunk(text)]
        return [self.first[head], *found] if head else found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.chunks(text)))


def decode(ids, bytes_of: list[bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, ids))


def broadcast_tables(docs: DataFrame, vocabulary: str, pattern: str):
    """The tables on every executor; their size is bounded by the rank file."""
    return docs.sparkSession.sparkContext.broadcast(BytePairTables(load_ranks(vocabulary), pattern))


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text",
                 ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus the ids of each text as an array."""
    shared = broadcast_tables(docs, vocabulary, pattern)

    def start():
        enc = Encoder(shared.value)
        return lambda texts: [[enc.encode(t or "") for t in texts]]

    return append_columns(docs, text_col, [(ids_col, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], start)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text",
                   prefix: str = "bpe_") -> DataFrame:
    """All columns plus count and digest of the ids, and the digest of what they decode to.

    Ids are digested where they are made, so that no id list is shuffled or stored.
    """
    shared = broadcast_tables(docs, vocabulary, pattern)

    def start():
        tables = shared.value

        decimal = list(map(str, range(len(tables.bytes_of))))

        def written(ids: tuple[int, ...]) -> tuple[str, bytes]:
            return " ".join([decimal[i] for i in ids]), decode(ids, tables.bytes_of)

        enc = Encoder(tables, written)

        def run(texts):
            n, a, b = [], [], []
            for t in texts:
                found = enc.chunks(t or "")
                ids = " ".join([c[0] for c in found])
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(b"".join([c[1] for c in found])).hexdigest())
            return n, a, b
        return run

    return append_columns(docs, text_col, [
        (fresh_name(docs, prefix + "n_tokens"), T.LongType(), pa.int64()),
        (fresh_name(docs, prefix + "ids_sha256"), T.StringType(), pa.string()),
        (fresh_name(docs, prefix + "decoded_sha256"), T.StringType(), pa.string())], start)


@register("op2_byte_bpe_codec")
def op2(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = encode_digests(docs, vocabulary_path(), split_pattern())
    n, ids, dec = out.columns[-3:]
    return out.select("doc_id", F.col(n).alias("n_tokens"), F.col(ids).alias("ids_sha256"),
                      F.col(dec).alias("decoded_sha256"))
