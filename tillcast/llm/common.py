"""Helpers shared by the training-data operators (no operator logic here)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows turned into Python objects at once; bounds a worker's memory.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key written as text, modulo ``folds`` (a null key counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def fresh_name(df: DataFrame, stem: str) -> str:
    """``stem``, extended until no column of ``df`` carries it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


class Memo(dict):
    """Remembered values of a function, bounded: of over ``limit`` keys, those not used
    since the last turn are forgotten at the next one.  Keys of over ``longest`` characters
    (a whole text without spaces, say) are never kept, so bytes are bounded too."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def append_columns(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType, pa.DataType]],
                   start: Callable[[], Callable[[list[str | None]], Iterable[Iterable]]]) -> DataFrame:
    """All columns of ``df`` plus ``fields``, computed from ``text_col`` in Arrow batches.

    A column of ``df`` with the name of a field (names compare without case) is replaced.
    ``start()`` runs once in each task and returns a function from a list of
    texts to one list per field.  Other columns pass through untouched, so no
    join by id is needed afterwards; no shuffle, rows keep their partitions.
    """
    names = [f[0] for f in fields]
    kinds = [f[2] for f in fields]
    taken = {n.lower() for n in names}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]
    schema = T.StructType([df.schema.fields[i] for i in kept] + [T.StructField(n, t) for n, t, _ in fields])
    text_at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = start()
        for batch in batches:
            for part in slices(batch):
                found = score(part.column(text_at).to_pylist())
                cols = [pa.array(v, type=k) for v, k in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + cols, names=schema.names)

    return df.mapInArrow(run, schema)


def class_sample(rows: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each class, the same ones at every run: those whose key hashes low.

    Only for fitting classifiers; a class with fewer rows is taken whole.
    """
    space = 1 << 30
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(space))
    wanted = F.lit(False)
    for value, n in rows.filter(F.col(label).isNotNull()).groupBy(label).count().collect():
        wanted |= (F.col(label) == F.lit(value)) & (place < F.lit(min(space, space * per_class // n + 1)))
    return rows.filter(wanted)
