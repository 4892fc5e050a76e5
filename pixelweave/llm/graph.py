"""Connected components of link tables, by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """One round. large: each node hands its larger neighbours to its least one; else its smaller neighbours and itself.
    total: the links, at most; a node with a large share of them is joined by broadcast."""
    both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links.select("v", "u")) if large else links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"), "n")
        out = join_hot(both.where("b > a"), least, "a", total).select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = join_hot(both, least, "a", total).select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select("a", "m"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v) of one ordered type, root being its component's least node."""
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen, total = None, links.count()
    for _ in range(MAX_ROUNDS):
        if not total:
            break
        # the first half of a round at most doubles the links
        links = materialize(_star(materialize(_star(links, True, 2 * total), "stars"), False, total), "stars")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, total = now, now[0]
    else:
        raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v"), F.col("v")).distinct())
