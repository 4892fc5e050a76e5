"""Training-data queries against their SQL in DuckDB, over the test tables and over labels for which several rules are on."""

import os
import random

import duckdb
import pytest
from test_operators import SCHEMA

from pixelweave.llm import queries

TABLES = "/root/testdata/sf0.001"


def same(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}" if f.endswith(".parquet") and os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(columns).collect()), key=repr)
    assert rows == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall(), key=repr)
    return got


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, name, TABLES).count()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quality_with_several_rules(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(2500):
        good, lang = rng.random() < 0.8, rng.choices(["en", "de", "aa", "bb", None], [20, 8, 1, 1, 2])[0]
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 90))]
        marks = rng.randrange(0, 12) if good and rng.random() < 0.1 else 0 if good else rng.randrange(0, 30)
        if not good and rng.random() < 0.4:
            words[10:30] = ["WORD" + w.upper() for w in words[10:30]]
        if rng.random() < (0.02 if good else 0.3):
            words += words[:12] * 2
        lines = [" ".join(words)] + ["same line"] * (rng.randrange(4) if rng.random() < 0.1 or not good else 0)
        rows.append((i, "\n".join(lines) + " " + "#" * marks + "!" * rng.randrange(1 + 9 * (not good)), lang, "s", 0))
        if i % 5:
            labels.append((i if i % 50 else None, int(good), 0))
        if not i % 20:
            labels.append((i, int(rng.random() < 0.5), 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = same(spark, "op10_quality_rules", str(tmp_path))
    assert got.where("not kept and not base_failed").count() > 50


def test_decontamination_with_short_and_repeated_items(spark, tmp_path):
    rng = random.Random(8)
    items = [(j, " ".join(rng.choices([f"w{i}" for i in range(60)], k=rng.randrange(1, 30)))) for j in range(30)] + [(3, "another text of the same id as before here"), (40, ""), (41, None), (42, "a a a a a a a a")]
    rows = []
    for i in range(120):
        own = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(2)):
            own[rng.randrange(len(own) + 1) :][:1] = ["new"]
        base = rng.choices([f"w{i}" for i in range(60)], k=rng.randrange(0, 40))
        rows.append((i, " ".join([*base, *own, *base[:3]]), "en", "s", 0))
    rows += [(7, rows[7][1], "en", "s", 0), (None, rows[9][1], "en", "s", 0), (200, None, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert same(spark, "op5_decontaminate", str(tmp_path)).count() > 80


def test_fingerprints_of_odd_texts(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "A b C d", "ÄÖ é 日本 ☃ x", "x" * 500, "one two three four " * 20]
    texts += [" ".join("".join(rng.choice("abcÄ日Z.") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    texts += [t + " z" for t in texts[7:20]] + texts[5:9]
    rows = [(i if i % 11 else i + 500, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = same(spark, "op1_simhash", str(tmp_path))
    assert got.where("doc_id <> component_id").count() >= 4
