"""Rows that the operators once lost or wrongly kept, against brute force."""

import os
import random

import pytest
from test_operators import SCHEMA, grouped, shingle_set

from pixelweave.llm import queries, sharding, simhash


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def by_force(texts, similarity=0.8):
    sets = [shingle_set(t) for t in texts]
    return grouped(len(sets), [[a == b or bool(a | b) and len(a & b) >= similarity * len(a | b) - 1e-12 for b in sets] for a in sets])


def components(spark, texts, **options):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, texts), similarity=0.8, **options).collect()}
    return [got[i] for i in range(len(texts))]


def test_repeated_lines_do_not_part_near_duplicates(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        body = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for _ in range(2):
            line = [f"x{rng.randrange(5000)}" for _ in range(8)]
            texts.append(" ".join(body + line * 12))
    expected = by_force(texts)
    assert sum(i != x for i, x in enumerate(expected)) == 25
    assert components(spark, texts) == expected


@pytest.mark.parametrize("hot", [4096, 3])
def test_similarity_is_exact(spark, hot):
    """Pairs from just under to just over 0.8, and groups where a near miss lies between what is alike."""
    rng = random.Random(9)
    texts = []
    for n in (60, 300, 1500):
        for k in range(16):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            for _ in range(1 + k % 3):
                gone = round(n * (0.09 + 0.002 * k))
                texts.append(" ".join(base[gone:] + [f"x{rng.randrange(10**6)}" for _ in range(gone)]))
            texts.append(" ".join(base))
    expected = by_force(texts)
    assert components(spark, texts, hot=hot) == expected


def test_survivors_of_rows_without_own_ids(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(12)]
    near = " ".join(texts[0].split()[:-1] + ["changed"])
    ids = [None] * 6 + [1, 1, 2, 3, None, 4]
    rows = table(spark, [*texts, near, texts[1], texts[6]], [*ids, 9, None, 7])
    for options in ({"similarity": 0.8}, {"radius": 0}):
        kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_first(rows, **options).collect())
        expected = [(i or 0, t) for i, t in zip(ids, texts, strict=True)]
        if "similarity" in options:
            expected[0] = (9, near)
        else:
            expected.append((9, near))
        assert kept == sorted(expected)


def test_shards_hold_whole_documents(spark, tmp_path, monkeypatch):
    """The query's shards are files of whole documents, and one row many times over is spread over buckets."""
    texts = [f"text {i} " * (1 + i) for i in range(40)] + ["the same row"] * 60
    rows = table(spark, texts, [*range(40), *[7] * 60])
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    path = str(tmp_path / "shards")
    monkeypatch.setattr(queries, "run_dir", lambda *_: path)
    got = queries.op4_sharding(spark, str(tmp_path)).collect()
    held = spark.read.parquet(path).collect()
    assert sorted((r.doc_id, r.text) for r in held) == sorted(zip([*range(40), *[7] * 60], texts, strict=True))
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in held} and len(got) == 100
    small = sharding.write_shards(rows, str(tmp_path / "small"), shards=2, bucket_bytes=1000)
    slots = {s: sorted(r.slot for r in small.collect() if r.shard == s) for s in (0, 1)}
    assert sum(map(len, slots.values())) == 100 and all(v == list(range(len(v))) for v in slots.values())
    assert sum(f.endswith(".parquet") for _, _, files in os.walk(tmp_path / "small") for f in files) > 4  # more than one bucket a shard
    keyed = sharding._numbered_copies(rows.selectExpr("0 shard", "xxhash64(doc_id, text) h", "xxhash64(text, doc_id) h2", "text"))
    assert keyed.count() == keyed.select("h").distinct().count() == 100
