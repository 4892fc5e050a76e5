import pytest

#: Rows that every operator must take: empty, null, very long, repeated, tied; and columns whose names operators use inside.
CLASHING = "n_words, key, fp, component_id, shard, slot, tokens, bucket, h, row, own, at, parts, start, item_id, text_hash, size, a, b, score, epochs, last, domain, root, first, __epoch".split(", ")
WORDS = [f"w{i}" for i in range(400)]


def text(first, n):
    return " ".join(WORDS[(first + 7 * i * i + i) % 400] for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    long = text(3, 60_000)
    base = [(1, text(0, 120), "en", "src0"), (2, text(0, 120), "en", "src0"), (3, "", "de", "src1"), (4, None, None, None), (5, " \t\n ", "", ""), (6, "one", "en", "src2"), (7, long, "fr", "src0"), (None, text(5, 80), "en", "src1"), (8, text(9, 60), None, "src0"), (8, text(9, 60), None, "src0"), (9, "Ünï çødé ☃ 日本 <b>&amp;", "en", None), (10, "a, b! c. " * 40, "en", "src0")]
    return [(*r, len(r[1] or "")) for r in base]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def edge(spark, edge_rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(edge_rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
