"""The corpus pipeline stage by stage against plain versions, and the registry's guard."""

import os
import re
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from tillcast.llm import packing, registry, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_on_the_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF)
        last = k == len(corpus_pipeline.STAGES) - 1
        assert last or out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = after.collect()
        if name == "language":
            assert {tuple(r) for r in rows} == {r for r in before if r[1] and re.search(r"[^\W\d_]", r[1])}
        elif name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            scores, = toxicity.Scorer(toxicity.train(docs, labels))([r[1] for r in before])
            assert {tuple(r) for r in rows} == {r for r, x in zip(before, scores) if x < toxicity.THRESHOLD}
            marked = {r.doc_id: r.toxic for r in labels.collect()}
            assert not any(marked.get(i) == 0 for i in {r[0] for r in before} - {r.doc_id for r in rows})
        elif name == "near_duplicates":
            groups = simhash.near_duplicates(docs).collect()
            assert {r.doc_id for r in rows} == {g.component_id for g in groups} and len(rows) == len({g.component_id for g in groups})
            assert {tuple(r) for r in rows} <= set(before)
        elif name == "secrets":
            assert {r.doc_id for r in rows} == {r[0] for r in before}
            texts = {r[0]: r[1] for r in before}
            for r in rows:
                spans = [m.span() for p in (r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}") for m in re.finditer(p, texts[r.doc_id])]
                assert not any(re.search(p, r.text) for p in (r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"))
                assert r.n_chars == len(r.text) and (not spans or secrets.MASK in r.text)
        else:
            by_doc = {}
            for r in rows:
                by_doc.setdefault(r.doc_id, []).append(r)
            words = packing.WordTokenizer(packing.tokenizer_path())
            for r in before:
                assert sum(p.length for p in by_doc[r[0]]) == len(words.encode(r[1])) + 1
        docs = after


def test_run_over_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "embeddings", "benchmark", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").filter("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in registry.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_odd_documents_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "text without id but words", None, "s", 1),
                                 (-1, "", "en", None, 0), (-2, "x" * 200_000, "en", "s", 200_000), (0, "another zero", "en", "s", 3)],
                                docs.schema)
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    for name, query in registry.queries().items():
        if name in ("op4_sum_of_squares_packing", "op12_shared_query_search"):
            assert query(spark, str(tmp_path)).count() > 0, name
        elif name not in ("op7_int8_block_join", "op13_burst_trie"):  # these read no documents
            assert query(spark, str(tmp_path)).count() == docs.count() + odd.count(), name


def test_entry_lists_all_operators():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_shard_query_equals_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for limit in (None, 50_000):
        sql = registry.oracle_sql()["op8_extendible_hash_shards"]
        if limit:
            from tillcast.llm import sharding
            sql = sql.replace(str(sharding.QUERY_BYTES), str(limit))
            docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
            got = sharding.shards(docs, F.col("doc_id"), F.octet_length("text"), limit)
        else:
            got = registry.queries()["op8_extendible_hash_shards"](spark, SF)
        cols = ["doc_id", "row_bytes", "shard_bits", "shard_id", "page"]
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())


def test_library_imports_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys; sys.modules['tillcast.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())")
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0
