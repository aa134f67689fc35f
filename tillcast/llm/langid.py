"""Language identification by hierarchical discrimination (operator 3).

The family is predicted first, then one-versus-one linear support vector
machines separate the languages inside it.  Features are relative frequencies
of hashed byte trigrams of the lower-cased letters, so a whole text is scored by
summing table rows over its bytes.  Machines are fitted on the driver by dual
coordinate descent (squared hinge loss) on a bounded sample, ``PER_LANGUAGE``
documents of each language; the model is one table of ``FEATURES`` rows and one
column per machine.  Scoring is one pass without a shuffle.

Languages without an entry in ``FAMILIES`` share the family "other".

Edge cases: null texts, and texts without a letter, are ``und`` with score 0;
so is every text when no labelled row is there to learn from.  Rows without a
language are scored but not learned from.  Repeated rows score alike; ties go to
the language first by name; an empty table gives no rows; extra columns pass
through, whatever their names.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, class_sample, documents, fold, fresh_name
from .registry import register

FEATURES = 8192
PER_LANGUAGE = 400  # labelled documents of each language that the machines are fitted on, about
FOLDS = 5
UNKNOWN = "und"
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic",
}
_LETTER = re.compile(r"[^\W\d_]").search
# ASCII bytes other than letters become spaces; bytes of other scripts stay
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigram_slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slot of each byte trigram of all texts, and where each text starts.

    A trigram that holds two spaces in a row gets slot ``FEATURES``, which weighs nothing.
    """
    parts = [b"  " + t.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY) + b"  " for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    wide = data.astype(np.uint32)
    key = np.zeros(len(data), dtype=np.uint32)
    key[:-2] = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    slot = ((key * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int32)
    space = data == 32
    twice = np.ones(len(data), dtype=bool)
    twice[:-2] = (space[:-2] | space[2:]) & space[1:-1]
    slot[twice] = FEATURES
    return slot, starts


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM, squared hinge, dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    diagonal = (x * x).sum(1) + 0.5 / c
    alpha, w, order = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            step = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - step / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class LanguageModel:
    """Machines between families and, inside a family, between its languages."""

    def __init__(self, rows: np.ndarray, langs: list[str], families: dict[str, str]):
        self.langs = sorted(set(langs))
        family = {lang: families.get(lang, "other") for lang in self.langs}
        self.members: dict[str, list[str]] = {}
        for lang in self.langs:
            self.members.setdefault(family[lang], []).append(lang)
        self.machines: list[tuple[str, str]] = list(combinations(sorted(self.members), 2))
        self.n_family = len(self.machines)
        for members in self.members.values():
            self.machines += combinations(members, 2)
        self.table = np.zeros((FEATURES + 1, len(self.machines)), dtype=np.float32)
        self.bias = np.zeros(len(self.machines))
        if not langs:
            return
        spread = rows.std(0) + 1e-4  # rare trigrams do not count for more than they are seen
        scaled = (rows / spread / np.sqrt((rows / spread).var(0).sum() + 1e-9)).astype(np.float32)
        scale = 1 / spread / np.sqrt((rows / spread).var(0).sum() + 1e-9)
        of_lang, of_family = np.array(langs), np.array([family[x] for x in langs])
        for m, (a, b) in enumerate(self.machines):
            of = of_family if m < self.n_family else of_lang
            use = (of == a) | (of == b)
            w = fit_machine(scaled[use], np.where(of[use] == a, 1.0, -1.0), c=10.0)
            self.table[:FEATURES, m] = w[:-1] * scale
            self.bias[m] = w[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and _LETTER(t)]
        if not at or not self.langs:
            return langs, scores
        slot, starts = trigram_slots([texts[i] for i in at])
        n = np.maximum(np.add.reduceat(slot < FEATURES, starts, dtype=np.int64), 1)
        margin = np.zeros((len(at), len(self.machines)))
        for m in range(len(self.machines)):
            margin[:, m] = np.add.reduceat(self.table[:, m][slot], starts, dtype=np.float64) / n + self.bias[m]
        for i, row in zip(at, margin, strict=True):
            fam, a = self._decide(sorted(self.members), row, 0)
            lang, b = self._decide(self.members[fam], row, self.n_family)
            langs[i], scores[i] = lang, float(1 / (1 + np.exp(-2.0 * max(min(a, b), 0.0))))
        return langs, scores

    def _decide(self, names: list[str], row: np.ndarray, first: int) -> tuple[str, float]:
        """The name with most one-versus-one wins (then the widest margins), and its least margin."""
        if len(names) == 1:
            return names[0], np.inf
        stop = self.n_family if first == 0 else len(self.machines)
        got = {n: [0, 0.0, np.inf] for n in names}
        for m in range(first, stop):
            a, b = self.machines[m]
            if a in got and b in got:
                for name, x in ((a, row[m]), (b, -row[m])):
                    got[name] = [got[name][0] + (x > 0), got[name][1] + x, min(got[name][2], x)]
        best = max(sorted(names), key=lambda n: got[n][:2])
        return best, got[best][2]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id",
          per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> LanguageModel:
    """Fit on about ``per_language`` whole documents of each non-null language in ``docs``.

    The sample that reaches the driver has at most ``2 * per_language`` rows a language:
    where a chosen id repeats so often that there are more, those whose id hashes low are taken.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(key).alias("key"))
    rows = class_sample(rows.filter("text IS NOT NULL AND lang IS NOT NULL"), "lang", "key", per_language)

    def start():
        def features(texts):
            out = []
            for t in texts:
                slot, _ = trigram_slots([t])
                out.append(np.bincount(slot, minlength=FEATURES + 1)[:FEATURES].astype(np.uint32))
            # a slot and its count for each slot that occurs: kilobytes a document
            return [[np.stack([f.nonzero()[0].astype(np.uint32), f[f > 0]]).tobytes() for f in out]]
        return features

    sample = append_columns(rows, "text", [("f", T.BinaryType(), pa.binary())], start)
    n_langs = 1 + sample.select("lang").distinct().count()
    got = sample.select("lang", "f").orderBy(F.xxhash64("key"), "f").limit(2 * per_language * n_langs).collect()
    x = np.zeros((len(got), FEATURES), dtype=np.float32)
    for i, r in enumerate(got):
        slot, n = np.frombuffer(r.f, dtype=np.uint32).reshape(2, -1)
        x[i, slot] = n / max(n.sum(), 1)
    return LanguageModel(x, [r.lang for r in got], FAMILIES if families is None else families)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred",
             score_out: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the predicted language and its score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows, whatever the data
    return append_columns(docs, text_col, [(lang_out, T.StringType(), pa.string()),
                                           (score_out, T.DoubleType(), pa.float64())],
                          lambda: shared.value.predict)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is unknown (no text or no letters)."""
    lang = fresh_name(docs, "lang_pred")
    score = fresh_name(docs, "lang_score")
    return identify(docs, model, text_col, lang, score).filter(F.col(lang) != UNKNOWN).drop(lang, score)


@register("op3_hierarchical_language_id")
def op3(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held = fold(F.col("doc_id"), FOLDS) == 0
    model = train(docs.filter(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")
