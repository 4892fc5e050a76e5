"""Operator 6: dated URL lists, joined as of the time of each capture.

A list is a log of dated entries: key, day, action ``add`` or ``remove``. A key is a host (which covers its subdomains, down to
a single label) or a host with leading path segments, of any number. Each ``add`` opens a validity interval that the key's next
entry closes. A capture asks for its host, that host's parent domains, and host/segment prefixes; it is listed if one of these has
an interval [first day, end day) with the day of the fetch in it. Hosts are lower-case, without a port, user or last dot. An IP
address, dotted or in brackets, has no parent domains.

Only the depths (numbers of labels, of segments) that the list's keys have are asked for, so a very long URL asks for few keys.
A list's intervals are one row a key. Keys with a large share of the captures are joined by broadcast, so that one host with a third
of all captures is no hot task. Entries of one key and day count as one: ``remove`` wins. Null keys, days or actions are
ignored. Null or odd URLs have no keys and are never listed; a null fetch day is never in an interval. Repeated captures give
one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize

HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?(\[[^/?#\]]*\]|[^/?#:@\[]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+/([^?#]*)"
ADDRESS = r"^(\d+\.\d+\.\d+\.\d+|\[.*)$"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def _depths(most: Column, asked: list[int] | None) -> Column:
    """1 to most, of these the ones asked for."""
    if asked is None:
        return F.when(most >= 1, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.array(*map(F.lit, asked)).cast("array<int>"), lambda i: i <= most)


def keys_of(url: Column, labels: list[int] | None = None, segments: list[int] | None = None) -> Column:
    """The keys under which a URL may be listed, without repeats; only parents and prefixes of the given numbers, if given."""
    host = host_of(url)
    own = F.split(host, r"\.")
    parents = F.transform(_depths(F.when(host.rlike(ADDRESS), 0).otherwise(F.size(own) - 1), labels), lambda i: F.array_join(F.slice(own, F.size(own) - i + 1, i), "."))
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    prefixes = F.transform(_depths(F.size(parts), segments), lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host != "", F.array_distinct(F.concat(F.array(host), parents, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, first, end): end is null while the entry stands."""
    daily = entries.where("key is not null and day is not null and action in ('add', 'remove')").groupBy("key", "day").agg(F.max("action").alias("action"))
    ahead = Window.partitionBy("key").orderBy("day")
    return daily.withColumn("end", F.lead("day").over(ahead)).where("action = 'add'").select("key", F.col("day").alias("first"), "end")


def judge(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """id, url, fetched, listed (boolean) and listed_by (the first of the matching keys in order) for each capture."""
    spans = materialize(intervals(entries).groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "url-intervals")
    depth = spans.select((F.size(F.split("key", "/")) - 1).alias("segments"), F.size(F.split(F.substring_index("key", "/", 1), r"\.")).alias("labels"))
    labels, segments = (sorted(r[0] for r in depth.select(c).distinct().collect()) for c in ("labels", "segments"))  # a few numbers
    rows = captures.select(F.col(id_col), "url", "fetched").groupBy(id_col, "url", "fetched").agg(F.count("*").alias("copies"))
    rows = materialize(rows.withColumn("capture", F.monotonically_increasing_id()), "captures")
    asked = rows.select("capture", "fetched", F.explode(keys_of(F.col("url"), labels, segments)).alias("key"))
    counts = asked.groupBy("key").agg(F.count("*").alias("n"))
    list_rows = materialize(spans.join(counts, "key"), "url-asked")
    total = list_rows.agg(F.sum("n").alias("n")).first().n or 0
    at = lambda x: (F.col("fetched") >= x["first"]) & (x["end"].isNull() | (F.col("fetched") < x["end"]))
    hits = join_hot(asked, list_rows, "key", total).where(F.exists("spans", at)).groupBy("capture").agg(F.min("key").alias("listed_by"))
    judged = rows.join(hits, "capture", "left")
    return judged.select(id_col, "url", "fetched", F.col("listed_by").isNotNull().alias("listed"), "listed_by", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).drop("copy")
