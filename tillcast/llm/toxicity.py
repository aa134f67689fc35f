"""Toxicity by a factorization machine over hashed terms (operator 9).

Terms of a text: its lower-cased words without outer punctuation, and their
first four and five letters, hashed.  The machine adds a weight per term and,
for each pair of terms, the product of their factors, so it learns pairs (an
insult with a mention of a group) that additive weights miss.

It is fitted on the driver on a bounded sample, about ``PER_CLASS`` documents of
each label (rows of the commoner label weigh more, so that scores keep the
labelled share).  Terms that the labels clearly depend on (chi-square over
``MIN_CHI2``) are kept, alone or in a pair: where one is present, the label depends
on the other, and the other way round.  A term that says nothing about the label
either way has no weight, so a long clean document is not judged by the sum of its noise.  Scoring is one
pass without a shuffle; most words are remembered as having no kept term.

Edge cases: null or empty texts get the score of a text without any kept term;
labels that are null or repeat are dropped or reduced to their largest value;
without labels of both kinds every score is 0.  Repeated rows score alike; an
empty table gives no rows; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, class_sample, documents, fold, fresh_name
from .registry import register

PER_CLASS = 3000  # labelled documents of each label that the machine is fitted on, about
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.3
FACTORS = 4
MIN_CHI2 = 30.0
MIN_DOCS = 5
PAIR_BLOCK = 512  # terms of a block when pairs are counted
MEMO_WORDS = 400_000  # words that a worker remembers as having no kept term
EDGE = ".,;:!?*$%&#\"'()[]{}<>|/\\-_=+~`@^0123456789"


def terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a chunk between white space."""
    w = word.strip(EDGE).lower().encode("utf-8", "surrogatepass")
    if not w:
        return ()
    return zlib.crc32(b"w" + w), zlib.crc32(b"4" + w[:4]), zlib.crc32(b"5" + w[:5])


def document_terms(text: str | None) -> np.ndarray:
    found = set()
    for word in set((text or "").split()):
        found.update(terms(word))
    return np.array(sorted(found), dtype=np.uint32)


class FactorizationMachine:
    """b + sum of w + half of (square of the summed factors - sum of their squares), over a text's terms."""

    def __init__(self, term_ids: np.ndarray):
        self.ids = {int(t): i for i, t in enumerate(term_ids)}
        rng = np.random.default_rng(11)
        self.b, self.w = 0.0, np.zeros(len(term_ids))
        self.v = rng.normal(0, 0.05, (len(term_ids), FACTORS))

    def raw(self, index: np.ndarray) -> float:
        if not len(index):
            return self.b
        v = self.v[index]
        return float(self.b + self.w[index].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum())

    def fit(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 300,
            rate: float = 0.05, penalty: float = 1e-3) -> None:
        """Weighted logistic loss, whole-sample gradients, adaptive moments."""
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        col = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        n, k = len(docs), len(self.w)
        params = [np.array([self.b]), self.w, self.v]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = weight.sum()
        by_row = lambda a: np.stack([np.bincount(row, a[:, f], minlength=n) for f in range(a.shape[1])], 1)
        for t in range(1, steps + 1):
            b, w, v = params
            vs = v[col]
            s = by_row(vs)
            z = b[0] + np.bincount(row, w[col], minlength=n) + 0.5 * (s * s - by_row(vs * vs)).sum(1)
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
            gv = g[row][:, None] * (s[row] - vs)
            grads = [np.array([g.sum()]), np.bincount(col, g[row], minlength=k) + penalty / n * w,
                     np.stack([np.bincount(col, gv[:, f], minlength=k) for f in range(FACTORS)], 1) + penalty / n * v]
            for p, gr, m, q in zip(params, grads, first, second, strict=True):
                m += 0.1 * (gr - m)
                q += 0.001 * (gr * gr - q)
                p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(q / (1 - 0.999 ** t)) + 1e-10)
        self.b, self.w, self.v = float(params[0][0]), params[1], params[2]


def telling_terms(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Terms whose presence and the label depend on each other (chi-square over the sample)."""
    ids, col = np.unique(np.concatenate(docs), return_inverse=True)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    seen = np.bincount(col, minlength=len(ids)).astype(float)
    hit = np.bincount(col, y[row], minlength=len(ids))
    n, pos = float(len(y)), float(y.sum())
    cross = hit * n - seen * pos
    chi2 = n * cross ** 2 / np.maximum(seen * (n - seen) * pos * (n - pos), 1)
    kept = (chi2 >= MIN_CHI2) & (seen >= MIN_DOCS)
    # chi-square is at most the number of documents, so no pair of a rarer term can pass
    common = np.flatnonzero(seen >= MIN_CHI2)
    return ids[kept | np.isin(np.arange(len(ids)), common[_in_telling_pair(row, col, common, y)])]


def _in_telling_pair(row: np.ndarray, col: np.ndarray, common: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the ``common`` columns have another that tells the label where they are, and the other way round."""
    place = np.full(int(col.max()) + 1 if len(col) else 0, -1)
    place[common] = np.arange(len(common))
    at = place[col]
    there = np.zeros((len(common), len(y)), dtype=bool)
    there[at[at >= 0], row[at >= 0]] = True
    packed = np.packbits(there, axis=1)  # a word and its first letters are often in the same documents
    first, same = {}, np.zeros(len(common), dtype=np.int64)
    for i in range(len(common)):
        same[i] = first.setdefault(packed[i].tobytes(), len(first))
    x = there[np.unique(same, return_index=True)[1]] if len(common) else there
    seen, hit = x.sum(1).astype(float), x[:, y > 0].sum(1).astype(float)
    found, size = np.zeros(len(x), dtype=bool), PAIR_BLOCK
    toxic = y > 0

    def chi2(n, pos, both, hits):
        return n * (hits * n - both * pos) ** 2 / np.maximum(both * (n - both) * pos * (n - pos), 1)
    for i in range(0, len(x), size):
        a = x[i:i + size].astype(np.float32)
        for j in range(i, len(x), size):
            b = x[j:j + size].astype(np.float32)
            hits = (a[:, toxic] @ b[:, toxic].T).astype(float)
            both = (a[:, ~toxic] @ b[:, ~toxic].T).astype(float) + hits
            pair = both >= MIN_DOCS
            pair &= chi2(seen[i:i + size, None], hit[i:i + size, None], both, hits) >= MIN_CHI2
            pair &= chi2(seen[None, j:j + size], hit[None, j:j + size], both, hits) >= MIN_CHI2
            found[i:i + size] |= pair.any(1)
            found[j:j + size] |= pair.any(0)
    return found[same]


class Scorer:
    def __init__(self, model: FactorizationMachine | None):
        self.model = model
        self.telling: dict[str, tuple[int, ...]] = {}
        self.silent: set[str] = set()

    def __call__(self, texts: list[str | None]) -> tuple[list[float], ...]:
        if self.model is None:
            return ([0.0] * len(texts),)
        if len(self.silent) > MEMO_WORDS:
            self.silent.clear()
        out, ids = [], self.model.ids
        for t in texts:
            found: set[int] = set()
            for word in set((t or "").split()).difference(self.silent):
                kept = self.telling.get(word)
                if kept is None:
                    kept = tuple(ids[x] for x in terms(word) if x in ids)
                    if not kept:
                        self.silent.add(word)
                        continue
                    if len(self.telling) > MEMO_WORDS:
                        self.telling.clear()
                    self.telling[word] = kept
                found.update(kept)
            z = self.model.raw(np.array(sorted(found), dtype=np.int64))
            out.append(float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))))
        return (out,)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = PER_CLASS) -> FactorizationMachine | None:
    """Fit on about ``per_class`` whole documents of each label; None without labels of both kinds.

    The sample that reaches the driver has at most ``4 * per_class`` rows: where a
    chosen id repeats so often that there are more, those whose id hashes low are taken.
    """
    marked = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).alias("y")))
    counts = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return None
    chosen = class_sample(marked, "y", "key", per_class)  # bounded by per_class, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key")
    sample = append_columns(rows, "text", [("f", T.BinaryType(), pa.binary())],
                            lambda: lambda texts: [[document_terms(t).tobytes() for t in texts]])
    got = sample.select("y", "f").orderBy(F.xxhash64("key"), "f").limit(4 * per_class).collect()
    y = np.array([r.y for r in got], dtype=float)
    if not 0 < y.sum() < len(y):
        return None
    found = [np.frombuffer(r.f, dtype=np.uint32) for r in got]
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    model = FactorizationMachine(telling_terms(found, y, weight))
    kept = [np.array([model.ids[int(t)] for t in d if int(t) in model.ids], dtype=np.int64) for d in found]
    model.fit(kept, y, weight)
    return model


def score_texts(docs: DataFrame, model: FactorizationMachine | None, text_col: str = "text",
                out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the toxicity score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # kept terms of a bounded sample
    return append_columns(docs, text_col, [(out, T.DoubleType(), pa.float64())], lambda: Scorer(shared.value))


def keep_clean(docs: DataFrame, model: FactorizationMachine | None, text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    out = fresh_name(docs, "toxicity")
    return score_texts(docs, model, text_col, out).filter(F.col(out) < threshold).drop(out)


@register("op9_factorization_toxicity")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    held = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return score_texts(docs.select("doc_id", "text", held), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
