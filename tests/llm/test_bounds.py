"""Memory that follows bytes, and classes of the secret models."""

import random
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tillcast.llm import bpe, ctw, packing, secrets, sharding, sketches
from tillcast.llm.common import Memo

SF = "/root/testdata/sf0.01"


def test_long_keys_are_not_remembered():
    memo = Memo(lambda k: k * 2, 1000)
    for i in range(50):
        text = chr(0x4e00 + i) * 5000
        assert memo[text] == text * 2
    assert len(memo) == 0 and memo["short"] == "shortshort" and len(memo) == 1


def test_unspaced_texts_leave_little_behind():
    rng = random.Random(3)
    words = packing.WordTokenizer(packing.tokenizer_path())
    for _ in range(60):
        words.encode("".join(chr(rng.randint(0x4e00, 0x9000)) for _ in range(2000)))
    held = sum(len(k) + len(v) for memo in (words.words, words.stems, words.others) for k, v in [*memo.items(), *memo.old.items()])
    assert held < 200_000  # of 60 x 2000 characters
    assert bpe.MEMO_CHUNKS * 64 < 1 << 27


def test_equal_long_copies_keep_few_windows_open():
    packer, done = packing.SumOfSquaresPacker(4096, most=50), []
    for doc in range(700):
        ids = np.full(3000, doc, dtype="<u4")
        full = packer.place((doc, 0, ids, 3000), 3000)
        done += [full] if full else []
        done += list(packer.drain())
        assert int(packer.levels.sum()) <= 51 and sum(len(w) for w in packer.open.values()) == int(packer.levels.sum())
    left = list(packer.rest())
    assert all(sum(len(p[2]) for p in w) == 4096 for w in done)
    seen = {}
    for doc, start, ids, total in [p for w in done for p in w] + left:
        seen.setdefault(doc, []).append((start, len(ids)))
        assert total == 3000 and (ids == doc).all()
    for cuts in seen.values():
        at = 0
        for start, n in sorted(cuts):
            assert start == at
            at += n
        assert at == 3000
    assert len(seen) == 700


def test_shards_keep_columns_that_look_like_their_own(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50), i, str(i), -i) for i in range(300)] + [(5, "same", 1, "a", 2)] * 400,
                                 "doc_id BIGINT, text STRING, _h BIGINT, _cell STRING, _tie BIGINT")
    out = sharding.shards(docs, F.col("doc_id"), F.octet_length("text"), 300)
    assert set(out.columns) == {*docs.columns, "row_bytes", "shard_id", "shard_bits", "page"}
    assert out.select(*docs.columns).exceptAll(docs).count() == 0 and out.count() == docs.count()
    assert out.groupBy("shard_id", "page").agg(F.sum("row_bytes").alias("b")).filter("b > 300").count() == 0


ORDINARY = ["user_2024_account_name_17", "com_example_package_v2_3_4_module", "release-2024-01-15-build-20391-final",
            "AbcDefGhiJklMnoPqrStu", "123e4567-e89b-42d3-a456-426614174000"]


def test_identifiers_are_ordinary_and_keys_are_found(spark):
    rng = random.Random(11)
    table = secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))
    key = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    base62, base64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    planted = [key(n, chars) for n in (24, 32, 40, 64) for chars in (base62, base64) for _ in range(60)]
    words = "user account name module release build final order total price index table column value system report client server".split()
    names = []
    for i in range(600):
        w = rng.sample(words, 3)
        names.append([f"{w[0]}_{2000 + i % 25}_{w[1]}_{w[2]}_{i}", f"{w[0]}-{w[1]}-{w[2]}-v{i % 9}", w[0] + w[1].title() + w[2].title() + "Id",
                      f"{w[0]}/{w[1]}/{w[2]}/{i}", f"{w[0].upper()}_{w[1].upper()}_{w[2].upper()}"][i % 5])
    rows = [(i, f"the value {s} stands here") for i, s in enumerate(ORDINARY + planted + names)]
    out = {r.doc_id: [s for s in r.spans if secrets.KINDS[s.kind] == "markov"]
           for r in secrets.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), table).collect()}
    assert [ORDINARY[i] for i in range(len(ORDINARY)) if out[i]] == []
    n = len(ORDINARY)
    recall = sum(bool(out[n + i]) for i in range(len(planted))) / len(planted)
    wrong = sum(bool(out[n + len(planted) + i]) for i in range(len(names))) / len(names)
    print(f"recall {recall:.3f}, false positives {wrong:.4f}")
    assert recall >= 0.9 and wrong <= 0.01


def test_context_tree_slices_are_bounded_in_bytes():
    texts = [b"word " * n for n in (1, 4000, 4000, 90_000, 0, 20_000, 20_000, 20_000)] * 8
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary()), pa.array([True] * len(texts))],
        names=["doc_id", "text", "train"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    parts = [p.column("text").to_pylist() for p in ctw.unpacked(sink.getvalue())]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(map(len, p)) <= ctw.SLICE_BYTES for p in parts)


def test_few_stripes_of_a_sketch_are_peeled(spark, monkeypatch):
    texts = [" ".join(f"Piece {random.Random(f'{k}.{i}').random()}." for i in range(120)) for k in "ab"]
    rows = spark.createDataFrame([tuple(texts)], "a STRING, b STRING").select(
        *[sketches.paragraph_digests(F.col(c)).alias(c) for c in "ab"])
    found = rows.select("a", "b", sketches._striped_difference(F.col("a"), F.col("b"), F.lit(240.0)).alias("d")).first()
    assert found.d == len({*found.a} ^ {*found.b}) == 240
    monkeypatch.setattr(sketches, "_stripe_difference", lambda both: F.lit(1000))
    d = rows.select(sketches._striped_difference(F.col("a"), F.col("b"), F.lit(240.0))).first()[0]
    assert d // 1000 < 15  # about 40 stripes of two or more without a finer cut
