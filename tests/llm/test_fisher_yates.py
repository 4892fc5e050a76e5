"""Operator 4 against a plain two-pass shuffle: scatter by hash, then Fisher-Yates of each bucket, with the same seeds."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, corpus

from pixelweave.llm import sharding


def deal(rows: list, seed: int) -> list:
    """Fisher-Yates inside out, by a Mersenne twister of 31-bit numbers."""
    twister, out = np.random.RandomState([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF]), list(rows)

    def below(n):
        while True:
            bits = int(twister.randint(0, 1 << 32, dtype=np.uint32)) >> 1
            if n & (n - 1) == 0:
                return n * bits >> 31
            if bits - bits % n + n - 1 < 1 << 31:
                return bits % n

    for i, row in enumerate(rows):  # inside out: each row changes places with one before it, or with itself
        j = below(i + 1)
        out[i] = out[j]
        out[j] = row
    return out


@pytest.mark.parametrize("options", [{"shards": 4, "bucket_rows": 9}, {"shards": 2, "seed": 7}, {"shards": 24}])
def test_shuffle_by_hand(spark, options):
    rows = [r for r in corpus(n=80)] + [(999, "the same", "en", "s", 8)] * 30
    docs = spark.createDataFrame(rows, SCHEMA)
    seed = options.get("seed", 42)
    scattered, buckets = sharding.scatter(docs, **options)
    by = collections.defaultdict(list)
    for r in scattered.collect():
        by[r.bucket].append((r.h, r.shard, r.grown_shard, tuple(r.row)))
    first = np.cumsum([0, *buckets])
    expected, slot = [], collections.Counter()
    for b in sorted(by):
        assert all(first[s] <= b < first[s + 1] for _, s, _, _ in by[b])
        for _, s, g, row in deal(sorted(by[b]), seed + b):
            expected.append((*row, s, slot[s], g))
            slot[s] += 1
    got = sharding.shuffle_shards(docs, **options).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    # the scatter's law, row by row
    law = docs.select("doc_id", sharding.rendezvous(F.col("doc_id").cast("string"), options["shards"], seed).alias("shard")).distinct().collect()
    shard = {r.doc_id: r.shard for r in law}
    assert all(r.shard == shard[r.doc_id] and r.grown_shard in (r.shard, options["shards"]) for r in got)


def test_large_groups_of_identical_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(i, f"text {i % 50}", "en", "s", 8) for i in range(100)] + [(7, "the same", "en", "s", 8)] * 1500 + [(8, "some", "en", "s", 8)] * 20
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shuffle_shards(docs, shards=2, bucket_rows=200).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(rows)
    for s in (0, 1):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    scattered, buckets = sharding.scatter(docs, shards=2, bucket_rows=200)
    assert scattered.count() == scattered.select("h").distinct().count() == len(rows)
    assert max(r["count"] for r in scattered.groupBy("bucket").count().collect()) < 280 and sum(buckets) >= 9
