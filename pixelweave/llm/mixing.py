"""Operator 7 [native]: mixing sources to target weights by hierarchical budgets.

The token budget is dealt out from the root through a tree (domain, language, source): each node's budget goes to its
children by weight, none getting more than it holds (its tokens times ``max_epochs``). What a child can't take goes to its
siblings by weight, and to the parent's siblings only once these are full: a node never gets more than its leaves hold, so
a shortage leaves a group only when the group is used up. Per group, the level at which the budget is spent is found by one
ordered pass over its children's fill ratios.

A leaf's budget is served in epochs: whole passes over its documents, then the token-prefix of one more pass in the seeded
order of that epoch (md5 of seed, epoch and id). The prefix of a leaf is found through 256 hash buckets, whose sums tell the one
in which the budget ends, and 256 finer ones in that; only the rows of the last bucket are ordered. So a leaf with a third of all rows is
never sorted as one group. A document is in the prefix if the order's tokens up to and with it (and its equals) fit.

Null names are the name "" at their level; null text has no tokens; repeated rows are taken together; names without a
weight get the default weight 1; zero or negative weights get nothing. Columns of any names go with the chosen documents. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, join_hot, materialize, packed, unpacked

LEVELS = ("domain", "lang", "source")
SEED = 42
#: Hex digits of the order key that name a bucket, coarse to fine.
BUCKET_DIGITS = (2, 4)


def count_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def _weights(frame: DataFrame, weights: dict[str, float]) -> Column:
    """weights: by the path of a node, names joined by "/"; anything else has 1."""
    path = F.concat_ws("/", *(c for c in frame.columns if c in LEVELS))
    if not weights:
        return F.lit(1.0)
    given = F.from_json(F.lit(json.dumps(weights)), "map<string,double>")
    return F.greatest(F.coalesce(given[path], F.lit(1.0)), F.lit(0.0))


def budgets(leaves: DataFrame, total: int, weights: dict[str, float], max_epochs: int) -> DataFrame:
    """leaves: LEVELS and tokens. Adds budget (double), the same as dealt out at every level."""
    nodes = None
    for depth in range(1, len(LEVELS) + 1):
        own = list(LEVELS[:depth])
        level = leaves.groupBy(*own).agg((F.sum("tokens") * max_epochs).cast("double").alias("cap"))
        level = level.withColumn("w", _weights(level, weights)).withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0))
        parent = own[:-1]
        level = level.join(nodes, parent) if parent else level.withColumn("given", F.lit(float(total)))
        # children in the order in which they are full; x is full if the level at its turn reaches its ratio
        group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        turn = group.orderBy(F.col("cap") / F.nullif(F.col("w"), F.lit(0.0)), *own)
        before = turn.rowsBetween(Window.unboundedPreceding, -1)
        after = turn.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        left = F.greatest(F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.lit(0.0))
        level = level.withColumn("share", left * F.col("w") / F.nullif(F.sum("w").over(after), F.lit(0.0)))
        level = level.withColumn("full", F.coalesce(F.col("share") >= F.col("cap"), F.lit(True)).cast("int"))
        # the first child that isn't full has the level; it falls for those after it
        level = level.withColumn("level", F.max(F.when(F.col("full") == 0, F.col("share") / F.col("w"))).over(group))
        budget = F.when(F.col("w") <= 0, 0.0).when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
        nodes = level.select(*own, budget.alias("given"))
    return leaves.join(nodes, list(LEVELS)).withColumnRenamed("given", "budget")


def plan(rows: DataFrame, *, fraction: float, weights: dict[str, float], max_epochs: int, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """rows: LEVELS, id and tokens. A row per leaf: epochs (whole passes), last (the last order key of the next pass that
    is taken; null if none). Each leaf's part of the work is spread over its hash buckets."""
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    have = leaves.agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).first()
    dealt = budgets(leaves, int((have.tokens or 0) * fraction), weights, max_epochs)
    whole = F.floor(F.col("budget") / F.nullif(F.col("tokens"), F.lit(0))).cast("bigint")
    dealt = dealt.withColumn("epochs", F.coalesce(whole, F.lit(0).cast("bigint"))).withColumn("rest", (F.floor("budget") - F.col("epochs") * F.col("tokens")).cast("bigint"))
    dealt = materialize(dealt, "leaf-budgets")
    epochs = join_hot(rows, dealt.select(*LEVELS, "n", "epochs"), list(LEVELS), have.n or 0)
    keyed = materialize(epochs.select(*LEVELS, "tokens", order_key(seed, F.col("epochs"), F.col(id_col)).alias("h")), "ordered")
    # first bucket by bucket, then in the one bucket in which the budget ends, by ever finer buckets; at last by rows
    edge, taken, before = dealt.select(*LEVELS, F.col("rest").alias("room")), [], 0
    upto = Window.partitionBy(*LEVELS).orderBy("bucket")  # at most 16 ** BUCKET_DIGITS[0] rows of a leaf
    for digits in BUCKET_DIGITS:
        inside = keyed.withColumn("prefix", F.substring("h", 1, before)).join(edge, [*LEVELS, "prefix"]).drop("room") if before else keyed
        sums = inside.groupBy(*LEVELS, F.substring("h", 1, digits).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.max("h").alias("h"))
        sums = materialize(sums.join(edge.drop("prefix"), list(LEVELS)).withColumn("upto", F.sum("tokens").over(upto)), "bucket-sums")
        taken.append(sums.where("upto <= room").groupBy(*LEVELS).agg(F.max("h").alias("h")))
        edge = sums.where("upto > room and upto - tokens <= room").select(*LEVELS, (F.col("room") - F.col("upto") + F.col("tokens")).alias("room"), F.col("bucket").alias("prefix"))
        before = digits
    # the order's equals count together
    order = Window.partitionBy(*LEVELS, "prefix").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = keyed.withColumn("prefix", F.substring("h", 1, before)).join(edge, [*LEVELS, "prefix"]).withColumn("upto", F.sum("tokens").over(order))
    taken.append(inside.where("upto <= room").groupBy(*LEVELS).agg(F.max("h").alias("h")))
    last = reduce(DataFrame.unionByName, taken).groupBy(*LEVELS).agg(F.max("h").alias("last"))
    return materialize(dealt.join(last, list(LEVELS), "left").select(*LEVELS, "tokens", "n", "budget", "epochs", "last"), "leaf-plan")


def named(docs: DataFrame, domain: Column) -> list[Column]:
    """The levels of documents; null names are ""."""
    return [F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source")]


def domain_of_source() -> Column:
    """The domain of the test tables' sources: their number's rest by 4."""
    number = F.coalesce(F.nullif(F.regexp_extract("source", r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, ("web", "books", "forum", "news"))), (F.pmod(number, F.lit(4)) + 1).cast("int"))


def mix(docs: DataFrame, *, domain: Column | None = None, fraction: float = 0.6, weights: dict[str, float] | None = None, max_epochs: int = 2, seed: int = SEED, only_rows: bool = False, most_leaves: int = HOT_KEYS) -> DataFrame:
    """The chosen documents with their own columns, one row for each epoch that takes them; unless only_rows, also __domain,
    __tokens and __epoch (columns of these names in the input give way).

    The texts aren't shuffled: the plan of the leaves is broadcast. Where it has over ``most_leaves`` leaves, that holds for the rows of
    the largest, and the others' are joined by leaf.
    """
    levels = named(docs, domain if domain is not None else domain_of_source())
    rows = materialize(docs.select("doc_id", *levels, count_words(F.col("text")).alias("tokens")), "mix-tokens")
    leaf = plan(rows, fraction=fraction, weights=weights or {}, max_epochs=max_epochs, seed=seed)
    own = docs if only_rows else docs.drop("__domain", "__tokens", "__epoch")
    whole = docs.select(packed(own), F.col("doc_id").alias("own_id"), *levels, count_words(F.col("text")).alias("own_tokens"))
    leaves = leaf.select(*LEVELS, "n", "epochs", "last")
    if leaves.count() <= most_leaves:
        kept = whole.join(F.broadcast(leaves), list(LEVELS))
    else:
        kept = join_hot(whole, leaves, list(LEVELS), rows.count())
    more = F.coalesce(order_key(seed, F.col("epochs"), F.col("own_id")) <= F.col("last"), F.lit(False)).cast("bigint")
    out = kept.withColumn("passes", F.col("epochs") + more).where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)))
    if only_rows:
        return out.select(*unpacked(own))
    return out.select(*unpacked(own), F.col("domain").alias("__domain"), F.col("own_tokens").alias("__tokens"), F.col("epoch").alias("__epoch"))
