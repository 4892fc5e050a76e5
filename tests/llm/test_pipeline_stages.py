"""Ids that the near-duplicate and decontamination stages keep on the small table, against brute force on their own input."""

import os

import pytest
from test_operators import grouped, leaks_by_hand

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_kept_ids(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        path = str(tmp_path / name.replace(" ", "-"))
        stages[name](spark, docs, TABLES).write.parquet(path)
        return spark.read.parquet(path)

    docs = after("quality rules", spark.read.parquet(f"{TABLES}/documents.parquet"))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    sets = [shingles(r.text) for r in rows]
    label = grouped(len(rows), [[a == b or len(a & b) >= 0.8 * len(a | b) - 1e-12 for b in sets] for a in sets])
    docs = after("near-duplicates", docs)
    kept = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert kept == [rows[i].doc_id for i in sorted(set(label))] and len(kept) < len(rows)

    items = [tuple(r) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").select("item_id", "text").collect()]
    leaking = set()
    for r in docs.select("doc_id", "text").collect():
        own = shingles(r.text)
        # an item of that similarity shares so many shingles at least
        likely = [x for x in items if len((x[1] or "").split()) < 5 or len(shingles(x[1]) & own) >= 0.8 * len(shingles(x[1])) - 1e-9]
        if likely and leaks_by_hand([r], likely):
            leaking.add(r.doc_id)
    gone = set(kept) - {r.doc_id for r in after("decontamination", docs).select("doc_id").collect()}
    assert gone <= leaking and len(gone) >= 0.95 * len(leaking) and leaking
