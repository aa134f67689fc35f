"""Nearest vectors against brute force in double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import nearest


def brute(rows, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        x = np.array(min(list(v) for i, v in good if i == q))
        best = {}
        for i, v in good:
            if i != q and len(v) == len(x):
                best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - x) ** 2).sum())))
        out[q] = [(i, d) for d, i in sorted((d, i) for i, d in best.items())[:k]]
    return out


def check(df, rows, k=10, **sizes):
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 100 == 0, k=k, **sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = {q: v for q, v in brute(rows, k).items() if v}
    assert got.keys() == want.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in want[q]], rel=1e-12, abs=1e-12)


def test_equals_brute_force_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    check(df, rows)
    check(df, rows, query_rows=2, tile_rows=60)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5).astype("float32")]) for i in range(250)]
    same = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows += [(1000 + i, same) for i in range(150)] + [(300, None), (400, [0.0] * 5), (500, [1.0, None, 1.0, 1.0, 1.0]),
             (600, [float("nan")] * 5), (700, [float("inf")] * 5), (800, []), (900, [1.0, 2.0]), (901, [1.0, 3.0]),
             (5, same), (100, same), (None, same)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, v INT, score STRING").repartition(4)
    check(df, rows)
    check(df, rows, k=7, query_rows=1, tile_rows=30)
    assert nearest.nearest(df.filter("false"), F.lit(True)).count() == 0


def test_extreme_values_and_repeated_rows(spark):
    rng = np.random.default_rng(7)
    for size in (1e160, 1e-310, 1e-160, 1.0):
        rows = [(i, [float(x) * size for x in rng.normal(size=4)]) for i in range(60)]
        rows += [rows[7]] * 500 + [(8, [float(x) * size for x in rng.normal(size=4)]) for _ in range(20)]
        df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").repartition(3)
        got = nearest.nearest(df, F.col("vec_id") % 100 == 0, tile_rows=40).collect()
        assert len(got) == 10 and len({r.vec_id for r in got}) == 10
        if 1e-150 < size < 1e150:
            check(df, rows, tile_rows=40)
