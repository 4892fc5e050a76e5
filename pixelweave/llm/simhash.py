"""Operator 1: SimHash near-duplicates, compared by bit-sliced counters.

Fingerprints: bit i is set where over half of the shingles' hashes (repeats included) have it. Distinct fingerprints are
compared only within buckets that are certain to hold every pair within the radius: 64 bits are cut into B blocks, two
fingerprints with r differing bits agree on B - r blocks at least, and each choice of so many blocks is a bucket key. B
is the one whose keys cost least for the number of fingerprints (the result is the same for all).

In a bucket the fingerprints lie as 64 vertical bit planes, 64 fingerprints a word. Each shift of the planes by d compares
all pairs at distance d in the bucket at once: seven planes go through a tree of carry-save full adders into the bitwise
counters 1, 2, 4 and a sticky 8; words of which all 64 pairs exceed the radius are abandoned before the next seven planes.
Matches are merged at once, so a bucket yields a spanning forest, never all its pairs. Buckets of over HOT fingerprints
are split into parts, and each pair of parts is a task of its own: nothing is dropped, memory stays bounded.

By similarity (the share of common shingles, repeats left out, of 0.8 say) bits that guarantee the radius would make keys
that all documents share, so there buckets are bands of ROWS min-hashes each: a pair of similarity s shares one of BANDS with
probability 1 - (1 - s^ROWS)^BANDS, 99.8 % at 0.8. Fingerprints, bands and sketches are of the distinct shingles there. Pairs
within the bit-sliced radius whose sketches (the least hash of each of BINS bins, 4 bits of it) agree to the similarity less
SLACK, four deviations of the estimate, are candidates, and only these are decided, by their exact shingle sets: the sets of
texts with a candidate are made again and brought together by loose component (by band where a component is hot), and every
candidate pair there that verified links don't join yet is compared. A pair that fails ends nothing, so no link is lost by it.

A null text has no words; texts without words have fingerprint 0 and are linked like any other. A document with a null id
gets a component by the other ids (null if there are none). The row that stays of a group is the one with the least (id, hash of
the text), null ids last, so groups without ids and unlike texts under one id keep a row each. Repeated rows give repeated results; empty in, empty out. Further columns, of any names, go with the rows that stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import as_bytes, join_hot, materialize, mix, packed, pieces, unpacked, working
from .graph import components

#: Largest bucket that one task compares at once; rows, and bytes of shingle sets, that a task holds.
HOT, HELD, HELD_BYTES = 4096, 1 << 18, 48 << 20
BITS = 64
#: Min-hash bands, min-hashes a band, bins of the sketch; bits of 64 that a pair by similarity may differ in.
BANDS, ROWS, BINS = 12, 4, 256
NEAR = 24
#: What a sketch's estimate may lie under the similarity; bits of the bitmap that finds the texts with a candidate.
SLACK, MARKS = 0.1, 1 << 25


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    words = text.lower().split()
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list of hashes."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    flat = np.concatenate([np.array(hashes[i], np.uint64) for i in some])
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[some], axis=0, dtype=np.int32)
    over = 2 * counts > sizes[some][:, None]
    out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def min_bands(hashes: list[list[int]], seed: int) -> np.ndarray:
    """BANDS keys for each list of hashes: equal where ROWS min-hashes are."""
    out = np.zeros((len(hashes), BANDS), np.uint64)
    some, flat, starts = _flat(hashes)
    if len(some):
        factors = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(BANDS * ROWS)) | np.uint64(1)
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for factor in factors[band * ROWS : (band + 1) * ROWS]:
                key = mix(key * np.uint64(31) + np.minimum.reduceat(flat * factor, starts))
            out[some, band] = key
    return out


def sketches(hashes: list[list[int]]) -> np.ndarray:
    """BINS values of 4 bits for each list of hashes: 0 for an empty bin, else 1 to 15 from its least hash."""
    some, flat, starts = _flat(hashes)
    least = np.full(len(hashes) * BINS, ~np.uint64(0))
    if len(some):
        mixed = mix(flat)
        row = np.repeat(some, np.diff(np.r_[starts, len(flat)]))
        np.minimum.at(least, row * BINS + (mixed >> np.uint64(56)).astype(np.int64), mixed & np.uint64((1 << 56) - 1))
    values = np.where(least == ~np.uint64(0), 0, 1 + (least & np.uint64(0xFFFFFF)) % np.uint64(15)).astype(np.uint8).reshape(-1, BINS)
    return values[:, ::2] | values[:, 1::2] << 4


def _flat(hashes: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists that hold something, all their hashes in one array, and where each starts."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    some = np.flatnonzero(sizes)
    flat = np.concatenate([np.array(hashes[i], np.uint64) for i in some]) if len(some) else np.zeros(0, np.uint64)
    return some, flat, (np.cumsum(sizes) - sizes)[some]


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of sketches of which at least that share of the bins used by either agree."""
    same = used = 0
    for shift in (0, 4):
        p, q = x >> shift & 15, y >> shift & 15
        same = same + ((p == q) & (p > 0)).sum(axis=1)
        used = used + ((p | q) > 0).sum(axis=1)
    return same >= similarity * used


def share(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two shingle sets, as sorted arrays of distinct hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def fingerprints(docs: DataFrame, *, width: int = 5, seed: int = 42, sets: bool = False, text_hash: bool = False, only: np.ndarray | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long).

    sets: of distinct shingles; also the band keys, the sketch, and node, a hash of the set. text_hash: also a hash of the text.
    only: the rows whose nodes are in this bitmap, with their sets (shingles).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        for batch in batches:
            for piece in pieces(batch, 1, 1 << 20):
                hashes = [shingle_hashes(x, width, seed) for x in as_bytes(piece.column(1))]
                columns = {}
                if sets:
                    hashes = [np.unique(np.array(x, np.uint64)) for x in hashes]
                    node = np.array([xxh64_intdigest(x.tobytes()) for x in hashes], np.uint64)
                    if only is not None:
                        slot = (node & np.uint64(MARKS - 1)).astype(np.int64)
                        marked = np.flatnonzero(only[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                        if not len(marked):
                            continue
                        piece, hashes, node = piece.take(pa.array(marked)), [hashes[i] for i in marked], node[marked]
                    bands, sketch = min_bands(hashes, seed), sketches(hashes)
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
                    columns = {"node": pa.array(node.view(np.int64)), "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()), "keys": keys}
                    if only is not None:
                        columns["shingles"] = pa.array([x.tobytes() for x in hashes], pa.binary())
                columns = {"doc_id": piece.column(0), "fp": pa.array(majority(hashes).view(np.int64))} | columns
                if text_hash:
                    columns["text_hash"] = piece.column(2)
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, fp bigint" + ", node bigint, sketch binary, keys array<bigint>" * sets + ", shingles binary" * (only is not None) + ", text_hash bigint" * text_hash
    return docs.select("doc_id", "text", *[F.xxhash64("text").alias("text_hash")] * text_hash).mapInArrow(run, schema)


def block_plan(n: int, radius: int) -> list[tuple[list[tuple[int, int]], ...]]:
    """Bucket keys, each a list of (first bit, bits): the plan that costs least for n fingerprints."""
    best, plan = math.inf, []
    for blocks in range(radius + 1, radius + 6):
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        cut = list(zip(edges, np.diff(edges).tolist(), strict=False))
        keys = list(combinations(cut, blocks - radius))
        bits = min(sum(b for _, b in k) for k in keys)
        if bits > 40:
            break
        cost = len(keys) * n * (1e-6 + 5e-9 * n / 2**bits)
        if cost < best:
            best, plan = cost, keys
    return plan


def _add(a, b, c):
    """Full adder: sum and carry."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _planes(fp: np.ndarray) -> np.ndarray:
    n = -(-len(fp) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(np.concatenate([packed, np.zeros((64, 16), np.uint8)], axis=1)).view(np.uint64)


def _close(planes: np.ndarray, d: int, left: np.ndarray, radius: int) -> np.ndarray:
    """Rows i of which row i + d is in the same bucket and within the radius."""
    n = planes.shape[1] - 2
    flags = np.zeros(n * 64, np.uint8)
    flags[: len(left)] = left > d
    live = np.packbits(flags, bitorder="little").view(np.uint64)
    at = np.flatnonzero(live)
    live = live[at]
    q, r = divmod(d, 64)
    over = np.zeros(len(at), np.uint64)
    counters = [over] * max(3, radius.bit_length())
    for first in range(0, BITS, 7):
        lo = np.minimum(at + q, n)
        x = []
        for plane in planes[first : first + 7]:
            other = plane[lo]
            if r:
                other = (other >> np.uint64(r)) | (plane[lo + 1] << np.uint64(64 - r))
            x.append(plane[at] ^ other)
        if len(x) == 7:
            s, c1 = _add(x[0], x[1], x[2])
            s, c2 = _add(s, x[3], x[4])
            s, c3 = _add(s, x[5], x[6])
            t, f = _add(c1, c2, c3)
        else:
            s, t, f = x[0], np.zeros_like(x[0]), np.zeros_like(x[0])
        carry = np.zeros_like(over)
        for i, count in enumerate(counters):
            if i == 0:
                counters[i], carry = count ^ s, count & s
            elif i < 3:
                counters[i], carry = _add(count, (t, f)[i - 1], carry)
            else:
                counters[i], carry = count ^ carry, count & carry
        over = over | carry
        live = live & ~(over | _above(counters, radius))
        keep = np.flatnonzero(live)
        if not len(keep):
            return keep
        if len(keep) < len(live):  # abandoned blocks
            at, live, over, *counters = (y[keep] for y in (at, live, over, *counters))
    lanes = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(lanes)
    return at[word] * 64 + bit


def _above(counters: list[np.ndarray], radius: int):
    """Counters over the radius, bit by bit from the top."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same = same & counters[i]
        else:
            more = more | (same & counters[i])
            same = same & ~counters[i]
    return more


def forest(key: np.ndarray, fp: np.ndarray, radius: int, sketch: np.ndarray | None = None, similarity: float = 0.0, shingles: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root) that join what is within the radius in each bucket, and with sketches, candidates for the similarity;
    with shingles (each row's set as bytes), just what has the similarity. Rows are sorted by key."""
    n = len(key)
    root = np.arange(n)
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(cuts)
    rows = np.flatnonzero(np.repeat(size, size) > 1)
    end = np.repeat(cuts[1:], size)
    d = 1
    while len(rows):
        # rows of a bucket stay together, so the distance in the bucket is the distance here
        planes, left = _planes(fp[rows]), end[rows] - rows
        whole = np.repeat(size, size)[rows]
        limit = max(2 * d, 16)
        top = int(whole.max())
        while d < min(limit, top):
            i = _close(planes, d, left, radius)
            for some in np.array_split(i, -(-len(i) // (1 << 14))) if len(i) else ():
                a, b = rows[some], rows[some + d]
                if sketch is not None:
                    apart = np.flatnonzero(root[a] != root[b])
                    apart = apart[alike(sketch[a[apart]], sketch[b[apart]], similarity - SLACK)]
                    if shingles is not None:
                        exact = (share(np.frombuffer(shingles[x], np.uint64), np.frombuffer(shingles[y], np.uint64)) for x, y in zip(a[apart], b[apart], strict=True))
                        apart = apart[np.fromiter(exact, float, len(apart)) >= similarity - 1e-12]
                    a, b = a[apart], b[apart]
                _merge(root, a, b)
            d += 1
        rows = rows[whole > d]
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _links(radius: int, hot: int, similarity: float | None = None, exact: bool = False, most_bytes: int = HELD_BYTES):
    """Rows (key, fp), (key, node, fp, sketch) or with exact, (key, node, fp, sketch, shingles), sorted by key, to links (u, v) of
    kind 0, and the rows of hot buckets as kind 1."""
    names = (["u", "v"] if similarity is None else ["u", "v", "fp", "sketch"]) + ["shingles"] * exact
    held_most = HELD if similarity is None else HELD // 4

    def emit(kind, rows):
        columns = [pa.array(x, pa.binary() if x.dtype == object else None) if x.ndim == 1 else pa.array([y.tobytes() for y in x], pa.binary()) for x in rows]
        n = len(rows[0])
        columns += [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())[len(columns) : len(names)]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *columns], names=["kind", *names])

    def join(kept):
        return [np.concatenate(x) for x in zip(*kept, strict=True)]

    def weigh(rows):
        return np.fromiter(map(len, rows[4]), np.int64, len(rows[4]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        kept, held, held_bytes = [], 0, 0
        passed = None  # a hot key of which rows have already been passed on

        def work(rows):
            key = rows[0]
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            size = np.diff(cuts)
            large = size > hot
            if exact and len(key):
                large |= (size > 1) & (np.add.reduceat(weigh(rows), cuts[:-1]) > most_bytes)
            big = np.repeat(large, size)
            if passed is not None:
                big |= key == passed
            if big.any():
                yield emit(1, [x[big] for x in rows])
                rows = [x[~big] for x in rows]
            if len(rows[0]):
                if similarity is None:
                    u, v = forest(rows[0], rows[1].view(np.uint64), radius)
                else:
                    u, v = forest(rows[0], rows[2].view(np.uint64), radius, rows[3], similarity, *rows[4:])
                yield emit(0, [rows[1][u], rows[1][v]])

        for batch in batches:
            rows = [x.to_numpy() for x in batch.columns[:3]]
            if similarity is not None:
                rows.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, BINS // 2))
            if exact:
                rows.append(batch.column(4).to_numpy(zero_copy_only=False))
                held_bytes += int(weigh(rows).sum())
            kept.append(rows)
            held += batch.num_rows
            if held >= held_most or held_bytes >= most_bytes:
                rows = join(kept)
                k = rows[0]
                cut = int(np.searchsorted(k, k[-1]))  # the last key's rows may go on
                yield from work([x[:cut] for x in rows])
                rest = [x[cut:] for x in rows]
                left = int(weigh(rest).sum()) if exact else 0
                if len(k) - cut > hot or (left > most_bytes and len(k) - cut > 1) or k[-1] == passed:
                    passed = k[-1]
                    yield emit(1, rest)
                    rest, left = [x[:0] for x in rest], 0
                kept, held, held_bytes = [rest], len(rest[0]), left
        if held:
            yield from work(join(kept))

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 4, hot: int = HOT) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) within the radius."""
    if not 0 <= radius <= 7:
        raise ValueError("radii of 0 to 7 have keys of useful length")
    keys = []
    for i, blocks in enumerate(block_plan(max(1, distinct.count()), radius)):
        value = F.lit(i).cast("bigint")
        for first, bits in blocks:
            value = F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)))
        keys.append(value)
    return _bucket_links(distinct.select(F.explode(F.array(*keys)).alias("key"), "fp"), radius, hot, None)


def _bucket_links(keyed: DataFrame, radius: int, hot: int, similarity: float | None) -> DataFrame:
    """Links (u, v) from rows (key, fp), (key, node, fp, sketch) or (key, node, fp, sketch, shingles)."""
    node, *more = keyed.columns[1:]
    exact = "shingles" in more
    schema = "kind int, u bigint, v bigint" + ", fp bigint, sketch binary" * bool(more) + ", shingles binary" * exact

    def search(rows, *most):
        return rows.repartition("key").sortWithinPartitions("key", node).mapInArrow(_links(radius, most[0], similarity, exact, *most[1:]), schema)

    found = materialize(search(keyed, hot), "simhash-links")
    links = found.where("kind = 0").select("u", "v")
    rows = found.where("kind = 1").select(F.col("u").alias("key"), F.col("v").alias(node), *more)
    if rows.isEmpty():
        return links
    load = F.greatest(F.count("*") / hot, F.sum(F.octet_length("shingles")) / HELD_BYTES) if exact else F.count("*") / hot
    parts = materialize(rows.groupBy("key").agg(F.ceil(load * 2).cast("int").alias("parts"), F.count("*").alias("of_key")), "simhash-parts")
    part = F.pmod(F.xxhash64(node), F.col("parts")).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, "part").alias("a"), F.greatest(j, "part").alias("b"))))
    split = join_hot(rows, parts, "key", rows.count(), "of_key").withColumn("part", part).select("key", node, *more, "part", pairs.alias("p")).where("p.a < p.b or parts = 1")
    return links.union(search(split.select(F.xxhash64("key", "p.a", "p.b").alias("key"), node, *more), 1 << 62, 1 << 62).select("u", "v"))


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """MARKS bits, those of the nodes' last bits set: never misses one, however many there are."""
    slot = F.col("node").bitwiseAND(F.lit(MARKS - 1)) + 1
    out = np.zeros(MARKS >> 3, np.uint8)
    for r in nodes.groupBy(F.bitmap_bucket_number(slot).alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect():
        out[(r.i - 1) * len(r.bits) : r.i * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def similar_links(docs: DataFrame, prints: DataFrame, similarity: float, hot: int, **options) -> DataFrame:
    """Links (u, v) between the nodes of texts, that connect those whose shingle sets have the similarity."""

    def distinct(rows, *columns):
        return rows.groupBy("node").agg(*(F.first(c).alias(c) for c in columns))

    loose = distinct(prints, "fp", "sketch", "keys").select(F.explode("keys").alias("key"), "node", "fp", "sketch")
    roots = materialize(components(_bucket_links(loose, NEAR, hot, similarity)), "simhash-candidates")
    if roots.isEmpty():
        return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    again = distinct(fingerprints(docs, sets=True, only=_bitmap(roots), **options), "fp", "sketch", "keys", "shingles")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    key = F.explode(F.when(F.col("n") > hot, F.col("keys")).otherwise(F.array("root"))).alias("key")
    held = join_hot(again.join(roots, "node"), sizes.withColumn("count", F.col("n")), "root", roots.count(), "count").select(key, "node", "fp", "sketch", "shingles")
    return _bucket_links(held, NEAR, hot, similarity)


def _linked(docs: DataFrame, *, width: int = 5, radius: int = 4, seed: int = 42, hot: int = HOT, similarity: float | None = None, text_hash: bool = False) -> tuple[DataFrame, str, DataFrame]:
    """Fingerprints of all rows, the name of their node column, and (node, root) of linked nodes."""
    prints = materialize(fingerprints(docs, width=width, seed=seed, sets=similarity is not None, text_hash=text_hash), "fingerprints")
    if similarity is None:
        node, links = "fp", fingerprint_links(prints.select("fp").distinct(), radius, hot)
    else:
        node, links = "node", similar_links(docs, prints, similarity, hot, width=width, seed=seed)
    return prints, node, components(links).select(F.col("node").alias(node), "root")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every row.

    Links are fingerprints within the radius, or with a similarity, texts whose shingle sets have at least that one.
    """
    prints, node, roots = _linked(docs, **options)
    nodes = materialize(prints.groupBy(node).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    linked = materialize(nodes.join(roots, node), "simhash-linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("of_root"))
    named = join_hot(linked, least, "root", linked.count(), "of_root").select(node, "component_id", "n")
    alone = nodes.join(roots, node, "left_anti").select(node, F.col("first").alias("component_id"), "n")
    named = materialize(named.unionByName(alone), "simhash-components")
    return join_hot(prints, named, node, prints.count()).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: the one with the smallest id (null last) and hash of its text, once (of rows that have both in
    common any one, whole)."""
    prints, node, roots = _linked(docs, text_hash=True, **options)
    nodes = prints.groupBy(node).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    first = nodes.join(roots, node, "left").groupBy(F.coalesce("root", node)).agg(F.min("first").alias("first"))
    kept = materialize(first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash")), "simhash-kept")
    rows = docs.select(packed(docs), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_hash"]).select(*unpacked(docs))


def hex_print(fp="fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
