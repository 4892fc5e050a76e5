"""The pipeline over a small table, stage by stage."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, TABLES).write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= seen and now, name
        seen = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(seen)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out[:-1], out[1:], strict=True))
    assert {r.doc_id for r in corpus_pipeline.run(spark, TABLES).collect()} == seen
