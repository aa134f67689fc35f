"""Sum-of-squares packing of tokenised documents into fixed windows (operator 4).

Every Spark task packs the documents of its own input split: the text is
tokenised, whole windows of a long document go out at once, and the rest is
placed by the sum-of-squares rule in the fill level that keeps the squared
counts of partially filled windows lowest.  Open windows live in an array of
levels; if more than ``OPEN_WINDOWS`` are open (a group of equal copies opens one
each, since no two fit into one window), all are laid end to end and cut into whole
windows, so memory is bounded by their number, never by the data.
Nothing is shuffled and no task depends on another one.

At the end of a split the windows still open are closed: their pieces are laid
end to end and cut into whole windows, and the last rest (under one window) is
cut into sequences whose lengths are powers of two, which need no padding.

Edge cases: null or empty text is the end id alone; a null id is kept as null;
repeated rows are packed once each; an empty table gives no rows; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, slices
from .registry import register

WINDOW = 4096
END_ID = 2
OPEN_WINDOWS = 1024
MEMO_WORDS = 400_000  # distinct words whose ids a task remembers
# Composed Latin letters, then ASCII punctuation: lower case is all that the tokenizer's
# normal form and pre-tokenisation do to such letters, so its merges can be asked for directly.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?*$%&#\"')|]*)").fullmatch
SEQUENCES_PER_TASK = 1 << 36


def byte_level() -> dict[int, int]:
    """The usual byte-level alphabet: visible Latin-1 characters stand for themselves, others from 256 on."""
    shown = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 173}
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_LEVEL = byte_level()

PIECE_SCHEMA = ("doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, "
                "sequence_id BIGINT, offset BIGINT")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of a text by a tokenizer that drops white space, remembered per word.

    No merge crosses a space or line feed, so a text's ids are those of its
    words in order; other white space stays inside a word and is left to the
    tokenizer.  Nor does one cross from a letter to ASCII punctuation, so letters
    are remembered apart from the punctuation behind them, in lower case (the
    tokenizer's own normal form).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.words, self.stems = Memo(self.word, MEMO_WORDS), Memo(self.stem, MEMO_WORDS)
        self.others = Memo(self.whole, MEMO_WORDS)

    def whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack_ids("<%dI" % len(ids), *ids)

    def stem(self, letters: str) -> bytes:
        found = self.merge(letters.encode().decode("latin-1").translate(BYTE_LEVEL))
        return pack_ids("<%dI" % len(found), *[t.id for t in found])

    def word(self, word: str) -> bytes:
        split = PLAIN(word)
        if split is None:
            return self.whole(word) if word else b""
        letters, tail = split.groups()
        ids = self.stems[letters.lower()]
        return ids + self.others[tail] if tail else ids

    def encode(self, text: str | None) -> np.ndarray:
        words = (text or "").replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u4")


class SumOfSquaresPacker:
    """Online packing: ``place`` returns the window that became full; ``drain`` closes what exceeds ``most`` open ones."""

    def __init__(self, window: int = WINDOW, most: int = OPEN_WINDOWS):
        self.window, self.most = window, most
        self.levels = np.zeros(window + 1, dtype=np.int64)  # open windows at each fill level
        self.open: dict[int, list[list]] = defaultdict(list)

    def level_for(self, size: int) -> int:
        """Fill level whose window should take ``size`` ids; 0 opens a window.

        Moving a window from level h to h+size changes the sum of squares by
        2*(N[h+size]-N[h])+2, by 1-2*N[h] when it becomes full, and opening one
        by 2*N[size]+1.  Ties go to the fullest window.
        """
        if size == self.window:
            return 0
        n, last = self.levels, self.window - size
        change = 2 * (n[size + 1:self.window + 1] - n[1:last + 1]) + 2
        change[-1] = 1 - 2 * n[last]
        change[n[1:last + 1] == 0] = np.iinfo(np.int64).max
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        return at + 1 if change[at] <= 2 * n[size] + 1 else 0

    def place(self, piece: tuple, size: int) -> list | None:
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.levels[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def drain(self) -> Iterator[list[tuple]]:
        """Full windows cut from all open ones, if those are too many; at most one stays open."""
        if int(self.levels.sum()) <= self.most:
            return
        total, pieces = sum(level * len(w) for level, w in self.open.items()), list(self.rest())
        self.levels[:] = 0
        self.open.clear()
        whole, rest = divmod(total, self.window)
        sizes = iter([self.window] * whole + [rest] * (rest > 0) + [1])
        for n, cut_window in enumerate(cut(iter(pieces), sizes)):
            if n < whole:
                yield cut_window
            else:
                self.levels[rest] += 1
                self.open[rest].append([(doc, start, ids.copy(), total_) for doc, start, ids, total_ in cut_window])

    def rest(self) -> Iterator[tuple]:
        """Pieces of the windows still open, fullest window first."""
        for level in sorted(self.open, reverse=True):
            for pieces in self.open[level]:
                yield from pieces


def cut(pieces: Iterator[tuple], sizes: Iterator[int]) -> Iterator[list[tuple]]:
    """Lay (doc, start, ids, doc_tokens) end to end and cut them at ``sizes``."""
    room, window = next(sizes), []
    for doc, start, ids, total in pieces:
        while len(ids):
            take = min(room, len(ids))
            window.append((doc, start, ids[:take], total))
            start, ids, room = start + take, ids[take:], room - take
            if not room:
                yield window
                room, window = next(sizes), []


def closing_sizes(total: int, window: int) -> Iterator[int]:
    """Whole windows, then the powers of two of what is left."""
    yield from (window for _ in range(total // window))
    rest = total % window
    yield from (1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1)
    yield 1  # never filled: all ids are placed by now


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence holds ``window`` ids, or a power of two where a split ends.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordTokenizer(tokenizer), SumOfSquaresPacker(window)
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        end = np.array([end_id], dtype="<u4")
        rows: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])

        for batch in batches:
            for part in slices(batch):
                docs_, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                for doc, text in zip(docs_, texts, strict=True):
                    ids = np.concatenate([words.encode(text), end])
                    total, whole = len(ids), len(ids) // window * window
                    for at in range(0, whole, window):
                        close([(doc, at, ids[at:at + window], total)])
                    if total > whole:
                        full = packer.place((doc, whole, ids[whole:].copy(), total), total - whole)
                        if full:
                            close(full)
                        for pieces in packer.drain():
                            close(pieces)
                if len(rows) >= 5000:
                    yield flush()
        left = sum(level * len(w) for level, w in packer.open.items())
        for pieces in cut(packer.rest(), closing_sizes(left, window)):
            close(pieces)
        if rows:
            yield flush()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


@register("op4_sum_of_squares_packing")
def op4(spark, sf_dir):
    return pack(documents(spark, sf_dir), tokenizer_path())
