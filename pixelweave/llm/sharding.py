"""Operator 4 [native]: seeded two-pass external shuffle into shards.

Pass one scatters records: the shard is the winner of seeded rendezvous hashing of (id, shard), so the id and the shard
count alone decide, and one more shard only takes rows into itself (law ``key``). A second seeded hash, of the whole row,
spreads each shard's rows evenly over buckets, as many as its rows and bytes ask for. Pass two has a bucket in each partition: it
sorts the bucket's rows by that hash, Fisher-Yates shuffles them (Spark's ``shuffle``, whose generator is seeded by the seed and the
partition's number, so a task that runs again deals the same), numbers them after the buckets before it, and writes them, whole.

Rows with one id share a shard, which then has more buckets, not larger ones. Identical rows are numbered and spread by that
number too, so they don't meet in a bucket; they keep separate slots. A bucket is only ever larger than its size by chance or by
a single row. A null id hashes as any value. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_KEYS, join_hot, materialize

#: Rows and bytes of a bucket at most, on average, while these make up to BUCKETS buckets. Of larger tables buckets are larger, so that
#: their number stays one that a stage can have, up to LARGEST times as large: what a task can hold.
BUCKET_ROWS, BUCKET_BYTES = 20_000, 8 << 20
BUCKETS, LARGEST = 20_000, 16
SEED = 42
#: Identical rows that a task makes of one.
COPIES = 1000


def rendezvous(key, shards: int, seed: int = SEED):
    """The shard in 0..shards-1 with the largest seeded hash of (seed, shard, key)."""
    return F.array_max(F.array(*(F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards))))["s"]


def _row_bytes(rows: DataFrame):
    """Bytes of a row's values, about."""
    total = F.lit(0).cast("bigint")
    for field in rows.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
        else:
            total = total + 8
    return total


def _numbered_copies(keyed: DataFrame) -> DataFrame:
    """The rows, with h of identical ones made different by their numbers. One of each group is kept and made as many again, a chunk of
    COPIES in a task, so that no task gets more of a group."""
    same = ["h", "h2"]
    repeated = materialize(keyed.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1"), "repeated-rows")
    total = repeated.agg(F.sum("n").alias("n")).first().n
    if not total:
        return keyed
    first = join_hot(keyed, repeated.withColumn("copies", F.col("n")), same, total).dropDuplicates(same)
    chunks = first.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).repartition(*same, "chunk")
    copies = chunks.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {COPIES} + 1, least(copies, (chunk + 1) * {COPIES}))")))
    # rows of large groups go without a shuffle
    large = repeated.where(F.col("n") > max(1000, total // HOT_KEYS)).select(same)
    single = keyed.join(F.broadcast(large), same, "left_anti").join(repeated.select(same), same, "left_anti")
    return single.unionByName(copies.withColumn("h", F.xxhash64("h", "copy")).select(keyed.columns))


def scatter(rows: DataFrame, *, id_col: str = "doc_id", shards: int = 24, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, list[int]]:
    """Pass one: (bucket, shard, h, grown_shard, row), and how many buckets each shard has; buckets are numbered over all shards."""
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))
    shard = rendezvous(key, shards, seed)
    sizes = rows.select(shard.alias("s"), _row_bytes(rows).alias("b")).groupBy("s").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()  # a row a shard
    wanted = {r.s: max(r.n / bucket_rows, r.b / bucket_bytes) for r in sizes}
    larger = min(LARGEST, max(1.0, sum(wanted.values()) / BUCKETS))
    buckets = [max(1, math.ceil(wanted.get(s, 0) / larger)) for s in range(shards)]
    h, h2 = (F.xxhash64(F.lit(seed), F.lit(what), key, own) for what in ("order", "copy"))
    keyed = rows.select(shard.alias("shard"), rendezvous(key, shards + 1, seed).alias("grown_shard"), h.alias("h"), h2.alias("h2"), own.alias("row"))
    element = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)
    first = [sum(buckets[:s]) for s in range(shards)]
    bucket = element(first) + F.pmod("h", element(buckets)).cast("int")
    return _numbered_copies(keyed).select(bucket.alias("bucket"), "shard", "h", "grown_shard", "row"), buckets


def shuffle_shards(rows: DataFrame, *, seed: int = SEED, **options) -> DataFrame:
    """The rows with shard, slot (gapless from 0 in each shard) and grown_shard (with one more shard).

    Columns of these names in the input give way.
    """
    scattered, buckets = scatter(rows.drop("shard", "slot", "grown_shard"), seed=seed, **options)
    item = F.struct("h", "grown_shard", "row")
    filled = scattered.repartitionById(sum(buckets), "bucket").groupBy("bucket").agg(F.first("shard").alias("shard"), F.sort_array(F.collect_list(item)).alias("items"))
    dealt = filled.select("shard", "bucket", F.shuffle("items", F.lit(seed)).alias("items"))
    sizes = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = dealt.join(F.broadcast(offsets), "bucket").select("shard", "offset", F.posexplode("items").alias("at", "item"))  # two numbers a bucket
    return out.select("item.row.*", "shard", (F.col("offset") + F.col("at")).alias("slot"), F.col("item.grown_shard").alias("grown_shard"))


def write_shards(rows: DataFrame, path: str, **options) -> DataFrame:
    """Write the shuffled rows, a folder for each shard and a file for each task's buckets of it, in order of slots; read them back."""
    out = shuffle_shards(rows, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return read_shards(rows.sparkSession, path, out.schema)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def digests(docs: DataFrame, *more: str):
    """doc_id, size (UTF-8 bytes and 8; null has none), crc32 of the text, and the given columns."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), *more)
