"""Joins on keys that hold most rows, columns with the names that operators use inside, and folders that are removed."""

import os
import random

import pytest
from test_operators import SCHEMA

from pixelweave.llm import common, decontaminate, graph, mixing, simhash


def test_join_hot_is_a_join(spark):
    left = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 50 END k", "id v")
    right = left.groupBy("k").count().where("k < 40").selectExpr("k", "count n", "k * 10 w")
    for least in (0, 100, 10**6):
        got = common.join_hot(left, right, "k", 5000, least=least)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))


def test_components_of_a_hub(spark):
    links = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5040)] + [(7, 7)], "u bigint, v bigint")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == dict.fromkeys(range(3000), 0) | dict.fromkeys(range(5000, 5041), 5000)
    assert graph.components(links.limit(0)).count() == 0


@pytest.fixture
def rows(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    ids = [None, None, None, 5, 5, 6]
    names = ["__id", "__row", "__text_hash", "__domain", "__tokens", "__epoch", "__hash", "own_id", "own_hash", "kept_id", "leak_id", "passes", "own_tokens", "n"]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    return docs.selectExpr("*", *(f"'own {c}' AS {c}" for c in names))


def test_unlike_documents_stay(spark, rows):
    benchmark = spark.createDataFrame([(1, "these words are in none of the documents at all")], "item_id bigint, text string")
    expected = sorted(rows.collect(), key=str)
    for got in (simhash.keep_first(rows, similarity=0.8), simhash.keep_first(rows, radius=4), decontaminate.keep_clean(rows, benchmark), mixing.mix(rows, fraction=1.0, max_epochs=1, only_rows=True), mixing.mix(rows, fraction=1.0, max_epochs=1, only_rows=True, most_leaves=0)):
        assert got.columns == rows.columns and sorted(got.collect(), key=str) == expected
    assert mixing.mix(rows, fraction=1.0, max_epochs=1).columns[-3:] == ["__domain", "__tokens", "__epoch"]


def test_scratch_folders_go(spark):
    with common.scratch() as keep:
        gone = common.materialize(spark.range(3), "gone")
        kept = common.materialize(gone.selectExpr("id + 1 id"), "kept", keep)
    assert kept.count() == 3 and len(keep) == 1 and os.path.isdir(keep[0].removeprefix("file://"))
    assert not any("gone-" in x for x in common._written)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist|FileNotFound"):
        gone.count()


def test_partitions_by_size(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "md5(cast(id as string)) t").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert common.more_partitions(rows, 1 << 30) == []
    (n,) = common.more_partitions(rows, 100_000)
    assert 50 < n < 200 and common.more_partitions(rows, 1000, most=60) == [60]
    joined = rows.join(rows.withColumnRenamed("t", "u"), "id")
    assert common.more_partitions(joined, 100_000) in ([n], [n - 1], [n + 1], [2 * n]) and common.more_partitions(joined, 1 << 30) == []
    assert common.more_partitions(spark.createDataFrame(spark.sparkContext.parallelize([(1, "a")]), "id bigint, t string"), 1 << 20) == []


def test_workers_let_go():
    held = {"a": [1], "b": [2]}
    common.holds("a", held["a"].clear)
    common.working("a")
    assert held == {"a": [1], "b": [2]}
    common.holds("b", held["b"].clear)
    common.working("b")
    assert held == {"a": [], "b": [2]}
    common.working("c")
    assert held == {"a": [], "b": []} and not common._held
