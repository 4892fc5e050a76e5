"""Held-out rows of the test tables, by language."""

import os

import pytest

from pixelweave.llm import queries

TABLES = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
def test_held_out_recall(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{x}.parquet") for x in ("documents", "labels"))
    rows = queries.op8_toxicity(spark, TABLES).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    found, marked, wrong, clean = {}, {}, 0, 0
    for r in rows.select("lang", "toxic", "predicted").collect():
        if r.toxic:
            found[r.lang] = found.get(r.lang, 0) + r.predicted
            marked[r.lang] = marked.get(r.lang, 0) + 1
        else:
            wrong, clean = wrong + r.predicted, clean + 1
    assert {k: round(found[k] / marked[k], 2) for k in marked if found[k] < 0.9 * marked[k]} == {}
    assert wrong <= 0.005 * clean
