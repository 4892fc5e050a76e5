"""The pipeline's rows against all its stages by brute force, over the smallest table."""

import os
import zlib

import numpy as np
import pytest
from test_operators import counts_by_hand, grouped, leaks_by_hand, mix_by_hand

from pixelweave.llm import common, queries, token_files

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TABLES = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
def test_run(spark):
    from tokenizers import Tokenizer

    rows = sorted(tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang", "source").collect())
    # too few labels for any rule but the base one
    rows = [r for r in rows if not counts_by_hand(r[1])[-1]]
    sets = [shingles(r[1]) for r in rows]
    first = grouped(len(rows), [[a == b or len(a & b) >= 0.8 * len(a | b) - 1e-12 for b in sets] for a in sets])
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").select("item_id", "text").collect()]
    clean = []
    for r in rows:
        likely = [x for x in items if len((x[1] or "").split()) < 5 or len(shingles(x[1]) & shingles(r[1])) >= 0.8 * len(shingles(x[1])) - 1e-9]
        if not (likely and leaks_by_hand([r], likely)):
            clean.append(r)
    assert len(clean) < len(rows) < 200
    chosen = sorted({i for i, *_ in mix_by_hand(clean, 0.8, queries.MIX_WEIGHTS, 1)})
    text, t, start, expected = {r[0]: r[1] for r in clean}, Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for i in chosen:
        ids = [*t.encode(text[i] or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, TABLES)
    assert not any("pipeline-" in x and "tokens" not in x for x in common._written)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == expected and len(expected) > 50
