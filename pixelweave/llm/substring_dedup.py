"""Operator 2: removal of repeated word windows, by FM-indexes over shards.

A window is ``size`` consecutive words. An FM-index over a wavelet matrix of a shard's texts, in order of document and place, has
them streamed through it backwards: the matching statistic of a window that reaches the threshold ``size`` at an earlier place
marks it as a repeat. Which texts share a shard is settled by anchors: a window's anchor is the least hash of the ``size - GRAM + 1``
word GRAM-grams in it, so that equal windows have equal anchors wherever they are. A document's consecutive windows with one anchor
(at one place) form a segment; segments whose anchor occurs once hold no repeats and go no further.

First each batch of the scan is a shard: its segments with an anchor that the batch repeats go through an index of their own, and
what repeats there goes no further (a passage in a third of all documents is one segment a batch before anything is shuffled).
Equal segments that are left, of several batches, have the same matching statistics, so the earliest stands for all, and the windows
of the others are repeats. Anchors that still have several segments are dealt to shards of about SHARD_WORDS words, and streamed
through the shards' indexes.

An anchor with over HOT different segments would make a shard too large. Its windows are dealt by their own hash, each a segment,
and equal ones are put together in the same way.

Documents order by id; rows that share an id, or have none, order by the hash of their text (nulls first), rows that
repeat in id and text count as one document and all get its result. Null or empty text has no words: nothing is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, mix, more_partitions, pieces, windows_hash, word_hashes, working
from .fm_index import FMIndex

SIZE, GRAM = 20, 8
SHARD_WORDS, HOT = 400_000, 20_000
#: Bytes of the input's files whose segments make a partition, where the session's number would make them larger.
PART = 64 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEGMENT = "anchor bigint, seg bigint, key bigint, at bigint"
#: at: (start << 24 | windows << 1 | 1 if the windows are known to be repeats)
_AT = 24
_MOST = (1 << (_AT - 1)) - 1


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _runs(at: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of each run of consecutive values at which the other arrays don't change."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = at[1:] != at[:-1] + 1
    for x in more:
        new = new | (x[1:] != x[:-1])
    first = np.flatnonzero(np.r_[True, new])
    return first, np.diff(np.r_[first, len(at)])


def windows(h: np.ndarray, lengths: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: where their windows start, where each one's anchor is, and the anchor."""
    none = np.zeros(0, np.int64)
    if len(h) < size:
        return none, none, none.view(np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(owner[: len(h) - size + 1] == owner[size - 1 :])
    if not len(at):
        return none, none, none.view(np.uint64)
    g = windows_hash(h, gram)
    place = np.lib.stride_tricks.sliding_window_view(g, size - gram + 1)[at].argmin(axis=1) + at
    return at, place, g[place]


def contents(h: np.ndarray, begin: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the words of segments, by prefix sums."""

    def powers(x: np.uint64) -> np.ndarray:
        out = np.full(len(h) + 1, x, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(_ODD)[: len(h)], dtype=np.uint64)])
    return mix((sums[begin + count + size - 1] - sums[begin]) * powers(_INVERSE)[begin] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def local_repeats(h: np.ndarray, at: np.ndarray, place: np.ndarray, anchor: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows occur earlier in the same texts, whose order is that of their documents."""
    first, count = _runs(at, place)
    own = anchor[first]
    number, often = np.unique(own, return_inverse=True, return_counts=True)[1:]
    some = np.flatnonzero(often[number] > 1)
    out = np.zeros(len(at), bool)
    if len(some):
        begin = at[first[some]]
        _, found = shard_repeats(some, begin, [h[a : a + n + size - 1] for a, n in zip(begin.tolist(), count[some].tolist(), strict=True)], size)
        out[np.searchsorted(at, found)] = True
    return out


def _words(piece: pa.RecordBatch, column: int):
    words = [x.split() for x in as_bytes(piece.column(column))]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return words, lengths, word_hashes([w for x in words for w in x])


def _cut(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("substrings")
        for batch in batches:
            for piece in pieces(batch, 1, 3 << 20):
                piece = piece.take(pc.sort_indices(piece.column(0)))
                _, lengths, h = _words(piece, 1)
                at, place, anchor = windows(h, lengths, size, gram)
                again = local_repeats(h, at, place, anchor, size)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                key, begin = piece.column(0).to_numpy(), _starts(lengths)
                out = []
                for known in (1, 0):
                    w = np.flatnonzero(again == known)
                    first, count = _runs(at[w], owner[at[w]], *(() if known else (place[w],)))
                    a = at[w][first]
                    # rows known to be repeats have no anchor
                    what = [np.zeros(len(a), np.int64)] * 2 if known else [anchor[w][first].view(np.int64), contents(h, a, count, size).view(np.int64)]
                    out.append((*what, key[owner[a]], (a - begin[owner[a]] << _AT) | (count << 1) | known))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["anchor", "seg", "key", "at"])

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of all segments to repeats (kind 0) and the first ones of anchors with several contents (kind 1, with
    their number in the anchor). Only two rows are carried from batch to batch."""
    carry = None  # anchor, seg, key, at, done (passed on already), number
    for batch in batches:
        anchor, seg, key, at = (batch.column(i).to_numpy() for i in range(4))
        known = (at & 1).astype(bool)
        out = [(np.zeros(int(known.sum()), np.int64), anchor[known], key[known], at[known])]
        anchor, seg, key, at = anchor[~known], seg[~known], key[~known], at[~known]
        done, number = np.zeros(len(anchor), bool), np.zeros(len(anchor), np.int64)
        if carry is not None:
            anchor, seg, key, at, done, number = (np.concatenate(x) for x in zip(carry, (anchor, seg, key, at, done, number), strict=True))
        if len(anchor):
            new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
            first = np.r_[True, new_anchor[1:] | (seg[1:] != seg[:-1])]
            again = ~first & ~done
            out.append((np.zeros(int(again.sum()), np.int64), anchor[again], key[again], at[again]))
            group = np.cumsum(new_anchor) - 1
            contents = np.bincount(group[first])
            # numbers go on from the carried ones
            rank = np.cumsum(first) - 1
            rank = rank - rank[np.flatnonzero(new_anchor)][group]
            if carry is not None and len(carry[0]) == 2:
                rank = np.where(group == 0, rank + carry[5][1] - 1, rank)
            passed = first & ~done & (contents[group] > 1)
            out.append((1 + rank[passed], anchor[passed], key[passed], at[passed]))
            last = np.flatnonzero(first & (group == group[-1]))
            head, tail = last[0], last[-1]
            some = contents[group[-1]] > 1
            if head == tail:
                carry = (anchor[[head]], seg[[head]], key[[head]], at[[head]], np.array([some]), rank[[head]])
            else:
                keep = [head, tail]
                carry = (anchor[keep], seg[keep], key[keep], at[keep], np.array([True, True]), rank[keep])
        kind, a, k, p = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(kind):
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(k), pa.array(p)], names=["kind", "anchor", "key", "at"])


def _sorted_by_anchor(rows: DataFrame, parts: list[int]) -> DataFrame:
    # rows known to be repeats only pass through, so they are dealt evenly
    deal = F.when(F.col("at").bitwiseAND(F.lit(1)) == 1, F.xxhash64("key", "at")).otherwise(F.col("anchor"))
    return rows.repartition(*parts, deal).sortWithinPartitions("anchor", "seg", "key", "at")


def _shard_rows(size: int, shards: int):
    """(key, text, list of (anchor, at)) to segments' word hashes by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, 4 << 20):
                shard, key, start, cells, sizes = [], [], [], [], []
                for k, text, parts in zip(piece.column(0).to_pylist(), as_bytes(piece.column(1)), piece.column(2).to_pylist(), strict=True):
                    h = word_hashes(text.split()).view(np.int64)
                    for p in parts:
                        a = p["at"] >> _AT
                        n = ((p["at"] >> 1) & _MOST) + size - 1
                        shard.append(p["anchor"])
                        key.append(k)
                        start.append(a)
                        cells.append(h[a : a + n])
                        sizes.append(n)
                if shard:
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(cells)))
                    number = (mix(np.array(shard, np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(key, pa.int64()), pa.array(start, pa.int64()), lists], names=["shard", "key", "start", "words"])

    return run


def shard_repeats(key: np.ndarray, start: np.ndarray, lists: list[np.ndarray], size: int):
    """Windows (key, start) of one shard's segments, in order, that occur earlier in it."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    # a 0 ends each segment
    words = np.unique(np.concatenate(lists), return_inverse=True)[1] + 1
    text = np.zeros(len(words) + len(lists), np.int64)
    begin = _starts(lengths + 1)
    inside = np.ones(len(text), bool)
    inside[begin + lengths] = False
    text[inside] = words
    index = FMIndex(text, size)
    count = lengths - size + 1
    origin = np.repeat(np.arange(len(lists)), lengths + 1)
    found = [at[(where >= 0) & (where < at)] for at, where in index.first_occurrences(text, begin + count - 1, count)]
    at = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key[origin[at]], start[origin[at]] + at - begin[origin[at]]


def _search(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        current = None

        def work():
            order = sorted(range(len(held)), key=lambda i: held[i][:2])
            key = np.array([held[i][0] for i in order], np.int64)
            start = np.array([held[i][1] for i in order], np.int64)
            k, s = shard_repeats(key, start, [held[i][2] for i in order], size)
            if len(k):  # runs of windows
                cut = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1)])
                n = np.diff(np.r_[cut, len(k)])
                yield pa.RecordBatch.from_arrays([pa.array(k[cut]), pa.array((s[cut] << _AT) | (n << 1) | 1)], names=["key", "at"])

        for batch in batches:
            offsets, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy()
            for i, (shard, key, start) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if shard != current:
                    if held:
                        yield from work()
                    held, current = [], shard
                held.append((key, start, values[offsets[i] : offsets[i + 1]].copy()))
        if held:
            yield from work()

    return run


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """docs: unique key and text. Runs of repeated windows: key and at."""
    many = more_partitions(docs.select("key", "text"), PART)
    rows = docs.select("key", "text").where("text is not null").mapInArrow(_cut(size, gram), SEGMENT)
    kinds = "kind bigint, anchor bigint, key bigint, at bigint"
    found = materialize(_sorted_by_anchor(rows, many).mapInArrow(_resolve, kinds), "segments")
    done = [found.where("kind = 0").select("key", "at")]
    first = found.where("kind > 0")
    often = materialize(first.where(F.col("kind") > hot).select("anchor").distinct(), "hot-anchors")
    if not often.isEmpty():  # one window a segment, dealt by its own hash
        split = docs.select("key", "text").join(first.join(often, "anchor", "left_semi").groupBy("key").agg(F.collect_list("at").alias("parts")), "key")
        again = materialize(_sorted_by_anchor(split.mapInArrow(_windows(size), SEGMENT), many).mapInArrow(_resolve, kinds), "hot-windows")
        done.append(again.where("kind = 0").select("key", "at"))
        first = first.join(often, "anchor", "left_anti").union(again.where("kind > 0"))
    words = first.agg(F.sum(F.shiftright("at", 1).bitwiseAND(F.lit(_MOST)) + size).alias("n")).first().n or 0
    shards = max(1, -(-words // shard_words))
    parts = first.groupBy("key").agg(F.collect_list(F.struct("anchor", "at")).alias("parts"))
    cut = docs.select("key", "text").join(parts, "key").mapInArrow(_shard_rows(size, shards), "shard int, key bigint, start bigint, words array<bigint>")
    done.append(cut.repartition(*many, "shard").sortWithinPartitions("shard").mapInArrow(_search(size), "key bigint, at bigint"))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def _collapse(anchor, seg, key, start, count):
    """Rows in order of (anchor, seg, key, start), those after the first of their anchor and content marked as repeats."""
    order = np.lexsort((start, key, seg, anchor))
    anchor, seg, key, start, count = (x[order] for x in (anchor, seg, key, start, count))
    again = np.r_[False, (anchor[1:] == anchor[:-1]) & (seg[1:] == seg[:-1])] if len(anchor) else np.zeros(0, bool)
    at = (start << _AT) | (count << 1) | again
    return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(key), pa.array(at)], names=["anchor", "seg", "key", "at"])


def _windows(size: int):
    """(key, text, list of at) to one segment for each window, its own hash being the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1, 4 << 20):
                out = [[], [], [], []]
                for k, text, parts in zip(piece.column(0).to_pylist(), as_bytes(piece.column(1)), piece.column(2).to_pylist(), strict=True):
                    h = word_hashes(text.split())
                    own = windows_hash(h, size)
                    other = mix(windows_hash(h[::-1], size)[::-1] + np.uint64(1))
                    for p in parts:
                        a, n = p >> _AT, (p >> 1) & _MOST
                        out[0].append(own[a : a + n])
                        out[1].append(other[a : a + n])
                        out[2].append(np.full(n, k, np.int64))
                        out[3].append(np.arange(a, a + n))
                if out[0]:
                    anchor, seg, key, start = map(np.concatenate, out)
                    yield _collapse(anchor, seg, key, start, np.ones(len(key), np.int64))

    return run


def _strip(size: int, columns: int):
    """Adds n_words, n_removed and the kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_at = columns - 2
            for piece in pieces(batch, text_at, 4 << 20):
                total, removed, kept = [], [], []
                for text, parts in zip(as_bytes(piece.column(text_at)), piece.column(text_at + 1).to_pylist(), strict=True):
                    words = text.split()
                    total.append(len(words))
                    if parts:
                        gone = np.zeros(len(words) + 1, np.int64)
                        p = np.array(parts, np.int64)
                        a, n = p >> _AT, (p >> 1) & _MOST
                        np.add.at(gone, a, 1)
                        np.add.at(gone, a + n + size - 1, -1)
                        stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                        words = [words[i] for i in stay]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                sha = [hashlib.sha256(x).hexdigest() for x in kept]
                text = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(text_at)), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), text], names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    names = ["doc_id"]
    return run


def strip_repeats(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for each row."""
    docs = docs.select("doc_id", "text")
    ids = docs.select("doc_id").groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if ids.isEmpty():
        keyed = docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
    else:  # keys in order of id and text hash
        hashed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
        order = hashed.select("doc_id", "h").distinct().repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "h", F.monotonically_increasing_id().alias("key"))
        order = materialize(order, "keys").select(F.col("doc_id").alias("i"), F.col("h").alias("j"), "key")
        keyed = materialize(hashed.join(order, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))).select("key", "doc_id", "text"), "keyed")
    runs = repeats(keyed.select("key", "text").dropDuplicates(["key"]) if not ids.isEmpty() else keyed.select("key", "text"), size, **options)
    per = runs.groupBy(F.col("key").alias("k")).agg(F.collect_list("at").alias("parts"))
    both = keyed.join(per, F.col("key") == F.col("k"), "left").select("doc_id", "text", "parts")
    return both.mapInArrow(_strip(size, 3), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
