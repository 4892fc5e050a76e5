"""Operator 5 [native]: documents that hold benchmark items, by SimHash of item-sized windows.

Words are lower-cased; a shingle is 5 consecutive words (an item of fewer words is one shingle). A window has as many shingles
as an item (the whole document where that has fewer). A document holds an item if one of its windows has a weighted Jaccard
similarity (shingle counts) of at least ``similarity`` to it, their SimHashes being within ``radius``.

Windows of every item size are fingerprinted where they may match at all. Sliding a window right to its first shingle of an
item never lowers the similarity to that item, so these are the windows that start with a shingle that some item of the size
has (or end with the document). The windows know nothing of the items: the fingerprint alone finds these, in a multi-index of
blocks of bits. Two fingerprints within the radius differ by no more than ``radius // blocks`` bits in one block at least, so
each block is looked up with all patterns so near; blocks are as many as cost least for the number of items. What is found passes
the whole Hamming distance and then the exact similarity.

Everything up to the last aggregation runs in the scan's stage, with broadcast tables whose sizes are measured and bounded: a
benchmark of over ``broadcast`` shingles is cut into blocks of at most that many, each matched against all documents. An item
that is longer alone is a block alone: its size is the only one that isn't bounded, and is linear.

Null or empty texts and items have no shingles and match nothing. Repeated rows give one result. A null id is an id. Items that
share an id but not the text are items of their own. Further columns, of any names, go with the documents that stay. Of windows with one similarity the first counts, then the nearest print.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, unpacked

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 16
#: Shingles of the benchmark that are broadcast at once (a few tens of MB).
BROADCAST = 500_000
BITS = 64
#: Patterns of a block that a look-up may ask for.
PATTERNS = 1500


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(hashed: Column, width: int) -> Column:
    """Hashes of every so many consecutive word hashes."""
    return F.transform(F.sequence(F.lit(0), F.size(hashed) - width), lambda i: F.xxhash64(*(F.get(hashed, i + j) for j in range(width)))) if width > 1 else hashed


def fingerprint(values: Column, most: int) -> Column:
    """Bit i is set where over half of the values, of which there are at most ``most``, have it. A pass over the values counts as
    many bits as a long has room for."""
    lane = next(b for b in (8, 16, 32) if most < 1 << b)
    mask = F.lit(sum(1 << i for i in range(0, BITS, lane))).cast("bigint")
    zero = F.lit(0).cast("bigint")
    half = F.shiftright(F.size(values), 1).cast("bigint")
    out = zero

    def counted(j: int) -> Column:  # the bits j, j + lane, j + 2 lane ...
        return F.aggregate(values, zero, lambda n, x: n + F.shiftrightunsigned(x, j).bitwiseAND(mask))

    for j in range(lane):
        counts = counted(j)
        for i in range(0, BITS, lane):
            count = F.shiftrightunsigned(counts, i).bitwiseAND(F.lit((1 << lane) - 1).cast("bigint"))
            out = out.bitwiseOR(F.when(count > half, F.lit(_signed(1 << (i + j)))).otherwise(zero))
    return out


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def blocks(fp: Column, n: int) -> list[tuple[Column, int]]:
    """n blocks of bits, and how many bits each has."""
    cut = [BITS * i // n for i in range(n + 1)]
    return [(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit(_signed((1 << (b - a)) - 1))), b - a) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def block_plan(items: float, radius: int) -> int:
    """The number of blocks whose look-ups and candidates are fewest for so many items of a size."""
    best = None
    for n in range(1, BITS + 1):
        widths = [BITS * (i + 1) // n - BITS * i // n for i in range(n)]
        asked = [sum(comb(w, k) for k in range(min(w, radius // n) + 1)) for w in widths]
        cost = sum(a + a * items / 2.0**w for a, w in zip(asked, widths, strict=True))
        if max(asked) <= PATTERNS and (best is None or cost < best[0]):
            best = cost, n
    return best[1]


def _counted_twice(values: Column) -> Column:
    """The distinct values that a list has more than once."""
    in_order = F.sort_array(values)
    return F.array_distinct(F.filter(in_order, lambda x, i: (i > 0) & (F.get(in_order, i - 1) == x)))


def similarity_of(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle lists; values that both have once are counted in one pass."""
    count = lambda values, x: F.size(F.filter(values, lambda y: y == x))
    more = F.aggregate(F.array_intersect(_counted_twice(a), _counted_twice(b)), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)) - 1)
    both = F.size(F.array_intersect(a, b)) + more
    return both / (F.size(a) + F.size(b) - both)


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """item (a number), item_id, width and values (shingles), n of them."""
    rows = benchmark.select("item_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).dropDuplicates().where(F.size("h") > 0)
    rows = rows.withColumn("width", F.least(F.size("h"), F.lit(width)))
    own = reduce(lambda c, k: c.when(F.col("width") == k, shingles(F.col("h"), k)), range(1, width + 1), F.when(F.lit(False), F.lit(None)))
    return materialize(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "width", own.alias("values")).withColumn("n", F.size("values")), "benchmark-items")


def matches(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_words, distance, similarity): the best window of each document and item."""
    items = _items(benchmark, width)
    found = []
    for k in range(1, width + 1):
        of_width = items.where(F.col("width") == k)
        size = of_width.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
        if size.total:
            parts = max(1, -(-size.total // broadcast))
            for part in range(parts):
                block = of_width.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else of_width
                found.append(_matches(docs, block, k, similarity, radius, size.most))
    if not found:
        found = [_matches(docs, items, width, similarity, radius, 1)]
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("distance")).alias("near"), "n_words")).alias("best")
    out = reduce(DataFrame.unionAll, found).groupBy("doc_id", "text_hash", "item_id").agg(best)
    return out.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("start"), "best.n_words", (-F.col("best.near")).alias("distance"), "best.similarity")


def windows_of(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, start, n (an item size), window (shingles): those that may match an item of that size."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") >= width)
    listed = hashed.select("doc_id", "text_hash", shingles(F.col("h"), width).alias("own"))
    begins = items.select("n", F.explode("values").alias("shingle")).groupBy("shingle").agg(F.collect_set("n").alias("sizes"))
    # outer: else Spark infers a filter on the list and pushes it down, with the word hashes made anew for each shingle
    seen = listed.select("doc_id", "text_hash", "own", F.posexplode_outer("own").alias("at", "shingle")).join(F.broadcast(begins), "shingle")
    seen = seen.select("doc_id", "text_hash", "own", "at", F.explode("sizes").alias("n"))
    size = F.least(F.col("n"), F.size("own"))
    return seen.withColumn("start", F.least(F.col("at"), F.size("own") - size)).select("doc_id", "text_hash", "start", "n", F.slice("own", F.col("start") + 1, size).alias("window"))


def _matches(docs: DataFrame, items: DataFrame, width: int, similarity: float, radius: int, most: int) -> DataFrame:
    groups = items.agg(F.count("*").alias("items"), F.count_distinct("n").alias("sizes")).first()
    n_blocks = block_plan(groups.items / max(1, groups.sizes), radius)
    near = radius // n_blocks
    prints = windows_of(docs, items, width).withColumn("fp", fingerprint(F.col("window"), most))

    def asked(block: int, value: Column, bits: int) -> Column:
        masks = [sum(1 << b for b in own) for k in range(min(near, bits) + 1) for own in combinations(range(bits), k)]
        return F.transform(F.array(*(F.lit(_signed(m)).cast("bigint") for m in masks)), lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))

    probes = prints.select("*", F.explode(F.concat(*(asked(i, *own) for i, own in enumerate(blocks(F.col("fp"), n_blocks))))).alias("ask"))
    printed = items.select("item", "item_id", "n", fingerprint(F.col("values"), most).alias("item_fp"))
    has = F.array(*(F.struct(F.lit(i).alias("block"), value.alias("value")) for i, (value, _) in enumerate(blocks(F.col("item_fp"), n_blocks))))
    index = materialize(printed, "benchmark-prints").select("item", "item_id", "item_fp", F.col("n").alias("item_n"), F.explode(has).alias("has"))
    pairs = probes.join(F.broadcast(index), (F.col("n") == F.col("item_n")) & (F.col("ask.block") == F.col("has.block")) & (F.col("ask.value") == F.col("has.value")))
    # coalesce: else Spark infers that fp isn't null, and makes it twice
    apart = F.coalesce(F.col("fp"), F.lit(0)).bitwiseXOR(F.col("item_fp"))
    # a pair is found in each block that is near enough, and goes on from the first
    first = F.coalesce(*(F.when(F.bit_count(value) <= near, F.lit(i)) for i, (value, _) in enumerate(blocks(F.col("apart"), n_blocks))))
    pairs = pairs.withColumn("apart", apart).where((F.bit_count("apart") <= radius) & (first == F.col("ask.block")))
    pairs = pairs.select("doc_id", "text_hash", "item", "item_id", "start", "n", "window", F.bit_count("apart").alias("distance")).join(F.broadcast(items.select("item", "values")), "item")
    exact = pairs.withColumn("similarity", similarity_of(F.col("window"), F.col("values"))).where(F.col("similarity") >= similarity - 1e-12)
    return exact.select("doc_id", "text_hash", "item_id", "start", (F.col("n") + (width - 1)).alias("n_words"), "distance", "similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item."""
    found = materialize(matches(docs, benchmark, **options), "leaks").select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    rows = docs.select(packed(docs), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    return rows.join(found, F.col("own_id").eqNullSafe(F.col("leak_id")) & (F.col("own_hash") == F.col("leak_hash")), "left_anti").select(*unpacked(docs))
