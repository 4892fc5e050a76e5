"""Operator 3: token ids in Parquet list columns.

A dataset is a folder with ``tokens`` (one row per document in ascending id order over the files: doc_id, shard,
local_start, local_end, n_tokens, tokens) and ``manifest`` (one row per file: shard, first and last id, documents, tokens, start).
Token lists are dictionary-encoded while the ids of a row group fit a dictionary page; ids and positions are
delta-encoded (Parquet format v2). Row groups and pages have set sizes and page indexes, so that readers fetch only the
rows and columns they ask for: metadata without tokens, or the documents that hold a range of positions.

Texts are range-partitioned by id and encoded after that, so that the ids written are never shuffled. Words (whitespace
separates tokens in the tokenizers this is for) are encoded once for some MB of text, and their parts kept in a worker's bounded cache.

Null text is empty; each document ends with the end id. Rows with one id keep apart, ordered by the hash of their text;
null ids come first. Other columns aren't written. An empty table gives an empty dataset.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import holds, more_partitions, pieces, working

ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Bytes of the input's files that make a file of tokens, where the session's number of partitions would make them larger.
FILE = 128 << 20
#: Bytes of text whose distinct words are encoded together.
PIECE = 4 << 20
#: Parts of words in a worker's cache; where it would hold more, only those of the latest texts stay. Of a call of the tokenizers library.
CACHE_WORDS, SOME = 250_000, 1000
SCHEMA = "doc_id bigint, shard int, local_start bigint, local_end bigint, n_tokens bigint, tokens array<int>"
MANIFEST = "shard int, first_id bigint, last_id bigint, documents bigint, tokens bigint, start bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Latin letters whose lower-casing is a matter of single letters; the lower-case ones.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
SMALL = "".join(c for c in LETTERS if c.lower() == c)


def lists_of(ids: list[list[int]]) -> pa.ListArray:
    cuts = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, cuts[-1])))


class Encoder:
    """Ids of whole texts, by their distinct words. A word of Latin letters and punctuation after them has two parts, the letters in lower
    case and the rest; any other word is one part. Parts that the cache lacks go to the tokenizers library, many a call: runs of
    letters at once to the vocabulary's model, others the tokenizer's whole way. Words are split and runs of letters taken only if the
    vocabulary marks the ends of words and the tokenizer gives the same ids on a probe."""

    _loaded: dict[int, Encoder] = {}

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.runs = Tokenizer.from_str(content), Tokenizer.from_str(content)
        for each in (self.tokenizer, self.runs):
            each.no_truncation()
            each.no_padding()
        self.runs.normalizer = normalizers.Sequence([])
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        marked = {t[0] for t in special}  # case and neighbours matter in special tokens
        self.ends = "".join(c for c in string.punctuation if c not in marked)
        probe = ["abcdefghij", "élève", "straße", "ñandú", "x"]
        self.short = bool(self.last.any()) and not any(c.isalpha() for c in marked) and self.letters(probe) == self.wholes(probe) == self.wholes([w[0].upper() + w[1:] for w in probe]) and all(self.whole(f"{w}{c}") == self.whole(w) + self.whole(c) for w in probe for c in (*self.ends, ".)", "!!!", "%%%"))
        self.names, self.ids = pa.array([], pa.string()), lists_of([])  # the cache

    def whole(self, word: str) -> bytes:
        return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def wholes(self, words: list[str]) -> pa.ListArray:
        return lists_of([x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def letters(self, words: list[str]) -> pa.ListArray:
        """Of runs of lower-case letters: nothing is left to normalize or to split, only bytes to name."""
        ids = np.array(self.runs.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.r_[0, np.flatnonzero(self.last[ids]) + 1].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids)) if len(cuts) == len(words) + 1 else self.wholes(words)

    def made(self, names: pa.Array) -> pa.ListArray:
        """Of parts: their ids, from the cache or as they are made. The cache then has them."""
        at = pc.index_in(names, value_set=self.names)
        new = names.filter(at.is_null())
        plain = pc.match_substring_regex(new, f"^[{SMALL}]+$") if self.short else pa.array(np.zeros(len(new), bool))
        runs, others = (new.filter(x).to_numpy(zero_copy_only=False).tolist() for x in (plain, pc.invert(plain)))
        parts = [f(x[i : i + SOME]) for f, x in ((self.letters, runs), (self.wholes, others)) for i in range(0, len(x), SOME)]
        known, is_run = at.fill_null(-1).to_numpy().copy(), plain.to_numpy(zero_copy_only=False)
        known[known < 0] = len(self.ids) + np.where(is_run, np.cumsum(is_run) - 1, len(runs) + np.cumsum(~is_run) - 1)
        ids = pa.concat_arrays([self.ids, *parts])
        out = ids.take(pa.array(known))
        unused = np.ones(len(self.names), bool)
        unused[at.drop_null().to_numpy()] = False
        if 0 < unused.sum() <= CACHE_WORDS - len(names):
            unused = pa.array(unused)
            self.names, self.ids = pa.concat_arrays([names, self.names.filter(unused)]), pa.concat_arrays([out, self.ids.filter(unused)])
        else:
            self.names, self.ids = names, out
        return out

    @classmethod
    def load(cls, content: str) -> Encoder:
        if (key := hash(content)) not in cls._loaded:
            cls._loaded[key] = cls(content)
        holds("tokens", cls._loaded.clear)
        return cls._loaded[key]

    def lists(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """Ids of texts, the end id after those of each."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.string())
        n, cuts = len(words), split.offsets.to_numpy() - split.offsets[0].as_py()
        heads, tails = words, pa.array([""] * n, pa.string())
        if self.short:
            fit, low = pc.match_substring_regex(words, f"^[{LETTERS}]+[{re.escape(self.ends)}]*$"), pc.utf8_lower(words)
            heads, tails = pc.if_else(fit, pc.ascii_rtrim(low, characters=self.ends), words), pc.if_else(fit, pc.utf8_ltrim(low, characters=SMALL), "")
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        pairs = self.made(parts.dictionary).take(pa.array(parts.indices.to_numpy().reshape(2, n).T.ravel()))
        ids = pa.ListArray.from_arrays(pa.array(pairs.offsets.to_numpy()[::2]), pairs.values)  # of each word
        order = coded.indices.to_numpy()
        if end_id is not None:
            ids, order, cuts = pa.concat_arrays([ids, lists_of([[end_id]])]), np.insert(order, cuts[1:], n), cuts + np.arange(len(cuts))
        every = ids.take(pa.array(order))
        return pa.ListArray.from_arrays(pa.array(every.offsets.to_numpy()[cuts]), every.values)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers."""
        return [np.array(x, "<i4").tobytes() for x in self.lists(pa.array(texts, pa.string())).to_pylist()]


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int | None = 2) -> None:
    """Encode (doc_id, text) and write the dataset. tokenizer: path of a tokenizer file that splits words at white space."""
    spark = docs.sparkSession
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("tokens")
        encoder, shard, at = Encoder.load(content.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, 1, PIECE):
                tokens = encoder.lists(piece.column(1).fill_null(""), end_id)
                ends = tokens.offsets.to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(tokens), shard, np.int32)), pa.array(at + ends[:-1]), pa.array(at + ends[1:]), pa.array(np.diff(ends)), tokens], names=["doc_id", "shard", "local_start", "local_end", "n_tokens", "tokens"])
                at += int(ends[-1])

    order = ["doc_id", "h"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(*more_partitions(docs.select("doc_id", "text"), FILE), *order).sortWithinPartitions(*order)
    options = {"parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "compression": "zstd"}
    dealt.select("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**options).parquet(f"{path}/tokens")
    files = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").groupBy("shard").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, *, tokens: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, if asked for, tokens."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("shard", "start")
    out = rows.join(files, "shard").select("doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "tokens")
    return out if tokens else out.drop("tokens")


def read_span(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """The documents that hold positions first to end - 1. Files of other spans give no rows; of the two files at its ends only the
    row groups and pages that may hold them are read (local_start and local_end have page indexes)."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("shard", "start", (F.col("start") + F.col("tokens")).alias("end")).where((F.col("start") < end) & (F.col("end") > first))
    edge = files.agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.min("start").alias("start"), F.max("start").alias("last")).first()
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    if edge.low is None or first >= end:
        return rows.where("false").select("doc_id", F.lit(0).cast("bigint").alias("start"), "n_tokens", "tokens")
    mine = rows.where(F.col("shard").between(edge.low, edge.high))
    mine = mine.where(((F.col("shard") > edge.low) | (F.col("local_end") > first - edge.start)) & ((F.col("shard") < edge.high) | (F.col("local_start") < end - edge.last)))
    return mine.join(files.select("shard", F.col("start").alias("of_file")), "shard").select("doc_id", (F.col("of_file") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows as read_tokens gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("checksums")
        for batch in batches:
            lists = batch.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
            cuts = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
