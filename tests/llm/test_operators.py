"""Training-data operators against brute force on small fixtures, and on odd rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelweave.llm import decontaminate, html_text, mixing, quality, sharding, simhash, substring_dedup, token_files, toxicity, url_filter
from pixelweave.llm.fm_index import FMIndex

SPACE = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(SPACE, t or "")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.6:
            own = rng.choice(texts).split()
            own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own[: rng.randrange(1, len(own) + 1)] + rng.choices(vocabulary, k=rng.randrange(30))))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 120))))
    return [(i, t, "en", f"src{i % 5}", len(t)) for i, t in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


# 1


def fingerprints_by_hand(rows, width=4, seed=42):
    out = []
    for r in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        s = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed) for x in s]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_simhash(spark, docs):
    rows = corpus()
    f = np.array(fingerprints_by_hand(rows), np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    label = np.arange(len(f))
    while not ((new := np.array([label[n].min() for n in near])) == label).all():
        label = new
    got = {r.doc_id: (r.p, r.component_id) for r in simhash.near_duplicates(docs, width=4).select("doc_id", simhash.hex_print().alias("p"), "component_id").collect()}
    assert got == {i: (f"{int(f[i]):016x}", int(label[i])) for i in range(len(f))}


@pytest.mark.parametrize("radius", [0, 3, 7, 8, 20])
def test_bit_sliced_forest(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for _ in range(1200):
        i, j = rng.integers(0, 900, 2)
        x = int(fp[i])
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(b)
        fp[j] = x
    key = np.sort(rng.integers(0, 4, 900))
    u, v = simhash.forest(key, fp, radius)
    root = np.arange(900)
    root[u] = v
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius) & (key[:, None] == key[None, :])
    label = np.arange(900)
    while not ((new := np.array([label[n].min() for n in near])) == label).all():
        label = new
    assert (root == label).all()


def test_simhash_hot_buckets_are_split(spark, docs):
    plain = sorted(map(tuple, simhash.near_duplicates(docs, width=4).collect()))
    assert sorted(map(tuple, simhash.near_duplicates(docs, width=4, hot=3).collect())) == plain


def shingle_set(t, width=5):
    w = words(t.lower())
    return {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def near_texts(seed=3, groups=40):
    """Groups of a text and copies with a word changed every so often; similarities of about 0.5 to 0.98, and unlike texts."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 600))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            own, every = list(base), rng.choice([20, 40, 60, 120])
            for k in range(rng.randrange(every), len(own), every):
                own[k] = f"x{rng.randrange(3000)}"
            out.append(" ".join(own))
    return [(i, t, "en", "src0", len(t)) for i, t in enumerate(out)]


def grouped(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[j] for j in range(n) if linked[i][j]] + [label[i]]) for i in range(n)]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("hot", [4096, 2])
def test_similar_texts(spark, hot):
    rows = near_texts()
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), similarity=0.8, hot=hot).collect()}
    sets = [shingle_set(r[1]) for r in rows]
    share = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    sure = grouped(len(rows), [[x >= 0.85 for x in r] for r in share])
    loose = grouped(len(rows), [[x >= 0.72 for x in r] for r in share])
    assert sum(a != i for i, a in enumerate(sure)) > 10
    assert all(got[i] == got[sure[i]] for i in got), "a pair of similarity 0.85 or more was lost"
    assert all(loose[i] == loose[got[i]] for i in got), "a pair of similarity under 0.72 was linked"


def test_sketch_estimate():
    rng = np.random.default_rng(5)
    for share in (0.6, 0.8, 0.95):
        both = rng.integers(0, 2**63, 3000).tolist()
        n = int(3000 / share - 3000) // 2
        a, b = simhash.sketches([both + rng.integers(0, 2**63, n).tolist(), both + rng.integers(0, 2**63, n).tolist()])[:, None]
        assert simhash.alike(a, b, share - 0.1)[0] and not simhash.alike(a, b, share + 0.12)[0]


def test_similar_odd_rows(spark, edge, empty):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(edge, similarity=0.8).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (8, 8)} <= got
    kept = simhash.keep_first(edge, similarity=0.8)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == edge.columns and 1 in ids and 2 not in ids and ids.count(8) == 1
    assert simhash.keep_first(empty, similarity=0.8).count() == 0


def test_keep_first(spark, edge, empty):
    kept = simhash.keep_first(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(8) == 1
    assert simhash.keep_first(empty).count() == 0


# 2


def strip_by_hand(rows, size=20):
    seen, out = set(), {}
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone.update(range(k, k + size))
            seen.add(key)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 0}, {"hot": 3, "shard_words": 900}, {"shard_words": 500}])
def test_substring_dedup(spark, docs, options):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.strip_repeats(docs, 20, **options).collect()}
    assert got == strip_by_hand(corpus())


def test_substring_dedup_inside_one_text(spark):
    t = " ".join(f"x{i % 30}" for i in range(200))
    rows = [(1, t, "", "", 0), (0, "y " * 100, "", "", 0)]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.strip_repeats(spark.createDataFrame(rows, SCHEMA), 20).collect()}
    assert got == strip_by_hand(sorted(rows))


def test_substring_dedup_odd_rows(spark, edge, empty, edge_rows):
    rows = substring_dedup.strip_repeats(edge).collect()
    assert len(rows) == len(edge_rows) and {r.doc_id: r.n_removed for r in rows}[2] == 120
    assert substring_dedup.strip_repeats(empty).count() == 0


def test_fm_index():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(1, 5, 300), 0)
    index = FMIndex(text, 6)
    query = rng.integers(1, 6, 80)
    length, where = index.matching_statistics(query)
    flat = "".join(map(str, text))
    for i in range(80):
        best = max(k for k in range(7) if i + k <= 80 and "".join(map(str, query[i : i + k])) in flat)
        assert length[i] == best
        if best == 6:
            assert where[i] == flat.index("".join(map(str, query[i : i + 6])))


# 3


def test_tokens(spark, edge, edge_rows, tmp_path):
    from tokenizers import Tokenizer

    path = str(tmp_path / "tokens")
    token_files.write_tokens(edge, path)
    t = Tokenizer.from_file(token_files.default_tokenizer())
    start, expected = 0, []
    for r in sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = token_files.read_tokens(spark, path)
    assert sorted(map(tuple, token_files.checksums(rows).collect()), key=lambda x: x[1]) == expected
    total = sum(n for _, _, n, _ in expected)
    for first, end in [(expected[4][1], expected[4][1] + 1), (0, total), (7, 7), (total, total + 9), *((a, a + total // 3) for a in range(0, total, total // 7))]:
        span = sorted(token_files.read_span(spark, path, first, end).select("start", "n_tokens").collect())
        assert [tuple(r) for r in span] == [(a, n) for _, a, n, _ in expected if a < end and a + n > first and first < end]
    assert "tokens" not in token_files.read_tokens(spark, path, tokens=False).columns


def test_encoder_on_odd_words():
    with open(token_files.default_tokenizer(), encoding="utf-8") as f:
        e = token_files.Encoder(f.read())
    texts = ["a<|ENDOFTEXT|> <|endoftext|>, x", "ÀÉ é́ Σας ΟΔΟΣ. İstanbul ﬁ ǅ 'S don't DON'T. it's, 1,234. ½ x², ª º. ^ a^b ^^", " nb sp \x1c\x1d \x85 z y 日本語、テスト。", "", " ", "\n\n x \r\n y", "straße, ı. ẞ!", "'"]
    assert e.short and [e.encode([t])[0] for t in texts] == [e.whole(t) for t in texts]


def test_tokens_empty(spark, empty, tmp_path):
    token_files.write_tokens(empty, str(tmp_path / "none"))
    assert token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "none"))).count() == 0


# 4


def test_sharding(spark, docs, edge, empty, edge_rows):
    rows = [r for r in sharding.shuffle_shards(sharding.digests(docs), shards=6, bucket_rows=3).collect()]
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 6)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 60
    again = sharding.shuffle_shards(sharding.digests(docs), shards=6, bucket_rows=3).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    texts = {i: t for i, t, *_ in corpus()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    odd = sharding.shuffle_shards(edge.drop("shard", "slot"), shards=3)
    assert odd.count() == len(edge_rows) and set(edge.columns) - {"shard", "slot"} <= set(odd.columns)
    assert sharding.shuffle_shards(empty).count() == 0


# 5


def leaks_by_hand(rows, items, similarity=0.8):
    out = {}
    for i, text, *_ in rows:
        w = words((text or "").lower())
        for j, item in items:
            v = words((item or "").lower())
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            a, b = ([tuple(x[p : p + k]) for p in range(len(x) - k + 1)] for x in (w, v))
            n = min(len(a), len(b))
            best = max(sum((collections.Counter(a[s : s + n]) & collections.Counter(b)).values()) / (n + len(b) - sum((collections.Counter(a[s : s + n]) & collections.Counter(b)).values())) for s in range(len(a) - n + 1))
            if best >= similarity - 1e-12:
                out[i, j] = round(best, 9)
    return out


def test_decontaminate(spark, edge, empty):
    rng = random.Random(3)
    items = [(j, " ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randrange(8, 60)))) for j in range(25)] + [(90, "short item"), (91, ""), (92, None), (93, "a a a a a a a a a a")]
    rows = []
    for i in range(80):
        base = rng.choices([f"w{i}" for i in range(300)], k=rng.randrange(0, 100))
        own = words(rng.choice(items)[1])
        if rng.random() < 0.6 and own:
            for _ in range(rng.randrange(3)):
                edit = rng.randrange(3)
                p = rng.randrange(len(own) + 1)
                own = own[:p] + (["new"] if edit == 0 else []) + own[p + (edit == 1) :]
            own = own[rng.randrange(3) :]
        p = rng.randrange(len(base) + 1)
        rows.append((i, " ".join([*base[:p], *own, *base[p:]]).upper() if i % 2 else " ".join([*base[:p], *own, *base[p:]]), "en", "s", 0))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = leaks_by_hand(rows, items)
    # a radius of all bits: nothing but the exact similarity decides
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.matches(docs, benchmark, radius=64).collect()}
    assert got == expected and len(expected) > 10
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark, radius=64, broadcast=60).collect()} == set(expected)
    production = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, benchmark).collect()}
    assert production <= set(expected) and len(production) >= 0.95 * len(expected)
    clean = decontaminate.keep_clean(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in production}
    assert decontaminate.keep_clean(edge, benchmark).columns == edge.columns
    assert decontaminate.matches(empty, benchmark).count() == 0 and decontaminate.matches(docs, benchmark.limit(0)).count() == 0


# 6


def test_url_filter(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "example.com", "b.example.org", "deep.a.example.com", "x.net"]
    urls = [f"http{'s' * rng.randrange(2)}://{rng.choice(hosts)}/{rng.choice(['', 'p', 'p/q', 'p/q/r?x=1', 'z#t'])}" for _ in range(200)] + [None, "", "no url", "HTTP://USER:PW@A.Example.com:80/p", "http://one/", "http://e.com/a/b/c/d", "http://e.com./a/b", "http://192.0.2.1/x", "http://[::1]:8080/x", "http://u@v@x.net/"]
    captures = [(i, u, rng.randrange(20) if i % 17 else None) for i, u in enumerate(urls)] + [(0, urls[0], None)]
    keys = [*hosts, "a.example.com/p", "example.com/p/q", "com"]
    always = ["e.com/a/b/c", "e.com/a/b", "2.1", "[::1]", "1"]
    entries = [(k, 0, "add") for k in always] + [(rng.choice(keys), rng.randrange(20), rng.choice(["add", "remove"])) for _ in range(30)] + [(None, 1, "add"), ("x.net", None, "add"), ("x.net", 3, None)]

    def listed(url, day):
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?(\[.*?\]|[^/?#:@]+)(?::\d+)?/?([^?#]*)", url or "")
        if not m or day is None:
            return None
        host, parts = m[1].lower().rstrip("."), [p for p in m[2].split("/") if p]
        labels = [] if host[0] in "[1" else host.split(".")
        own = {host, *(".".join(labels[i:]) for i in range(1, len(labels))), *("/".join([host, *parts[:k]]) for k in range(1, len(parts) + 1))}
        hit = []
        for k in own:
            events = [(d, a) for kk, d, a in entries if kk == k and d is not None and a is not None and d <= day]
            if events:
                d = max(d for d, _ in events)
                if max(a for dd, a in events if dd == d) == "add":
                    hit.append(k)
        return min(hit, default=None)

    got = url_filter.judge(spark.createDataFrame(captures, "page_id bigint, url string, fetched int"), spark.createDataFrame(entries, "key string, day int, action string")).collect()
    expected = sorted(((i, u, d, listed(u, d)) for i, u, d in captures), key=repr)
    assert sorted(((r.page_id, r.url, r.fetched, r.listed_by) for r in got), key=repr) == expected
    assert all(r.listed == (r.listed_by is not None) for r in got) and any(r.listed for r in got)
    assert {r.url: r.listed_by for r in got if r.listed_by in always} == {"http://e.com/a/b/c/d": "e.com/a/b", "http://e.com./a/b": "e.com/a/b", "http://[::1]:8080/x": "[::1]"}
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string, fetched int"), spark.createDataFrame(entries, "key string, day int, action string")).count() == 0


# 7


def mix_by_hand(rows, fraction, weights, max_epochs, seed=42):
    names = ("web", "books", "forum", "news")
    leaf = collections.defaultdict(list)
    for i, t, lang, source, *_ in rows:
        m = re.search(r"(\d+)$", source or "")
        leaf[names[int(m[1]) % 4 if m else 0], lang or "", source or ""].append((i, len(words(t))))
    size = {k: sum(n for _, n in v) for k, v in leaf.items()}
    budget = {(): float(int(sum(size.values()) * fraction))}
    for depth in range(3):
        new = {}
        for parent, total in budget.items():
            kids = {k[: depth + 1] for k in size if k[:depth] == parent}
            cap = {k: float(max_epochs * sum(n for q, n in size.items() if q[: depth + 1] == k)) for k in kids}
            w = {k: max(0.0, weights.get("/".join(k), 1.0)) for k in kids}
            open_, left = {k for k in kids if w[k]}, total
            given = dict.fromkeys(kids, 0.0)
            while open_:
                level = left / sum(w[k] for k in open_)
                full = {k for k in open_ if level * w[k] >= cap[k]}
                if not full:
                    given.update({k: level * w[k] for k in open_})
                    break
                given.update({k: cap[k] for k in full})
                left -= sum(cap[k] for k in full)
                open_ -= full
            new.update(given)
        budget = new
    out = []
    for k, rows_of in leaf.items():
        epochs = int(budget[k] // size[k]) if size[k] else 0
        rest = int(budget[k]) - epochs * size[k]
        out += [(i, e) for i, _ in rows_of for e in range(epochs)]
        total = 0
        ordered = collections.defaultdict(list)
        for i, n in rows_of:
            ordered[hashlib.md5(f"{seed}|{epochs}|{'' if i is None else i}".encode()).hexdigest()].append((i, n))
        for h in sorted(ordered):
            total += sum(n for _, n in ordered[h])
            if total > rest:
                break
            out += [(i, epochs) for i, _ in ordered[h]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("fraction,epochs,weights", [(0.6, 1, {"web": 3.0, "books": 2.0}), (1.5, 2, {"web": 5.0, "web/en/src0": 4.0, "news": 0.0}), (0.3, 3, {})])
def test_mixing(spark, docs, edge, edge_rows, empty, fraction, epochs, weights):
    for rows, frame in ((corpus(), docs), (edge_rows, edge)):
        got = mixing.mix(frame, fraction=fraction, weights=weights, max_epochs=epochs)
        assert sorted(((r.doc_id, r["__epoch"]) for r in got.select("doc_id", "__epoch").collect()), key=repr) == mix_by_hand(rows, fraction, weights, epochs) if frame is docs else got.count() >= 0
    assert mixing.mix(empty).count() == 0


# 8


def test_toxicity(spark, edge, empty):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(600):
        own = rng.choices(vocabulary, k=rng.randrange(5, 80))
        if bad := i % 5 == 0:
            p = rng.randrange(len(own))
            own[p:p] = rng.choices(["vilename", "nastyword", "awfulthing"], k=4)
        rows.append((i, " ".join(own), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs, marked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marked)
    got = toxicity.score(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.98 * len(held)
    spans = [(rows[r.doc_id][1].lower(), s) for r in got if r.doc_id % 5 == 0 for s in r.passages]
    assert spans and all(any(w in t[s.start : s.end] for w in ("vilename", "nastyword", "awfulthing")) for t, s in spans)
    odd = toxicity.score(edge, model).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert toxicity.score(empty, model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, marked.limit(0))).collect()} == {toxicity.Model().probability(0.0)}


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(200):
        values = {f"a{i}": rng.choice([1.0, 2.0, -3.0, 0.5]) for i in range(6)}
        own = [rng.choice([*values, "z"]) for _ in range(rng.randrange(1, 25))]
        model = toxicity.Model(scores=values, drift=-0.4)
        segments = model.segments(model.hits(own))
        s = [values.get(w, -0.4) for w in own]
        for w in values:
            for k, i in enumerate([i for i, x in enumerate(own) if x == w], 1):
                s[i] = values[w] / k if values[w] > 0 else values[w]
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert max((x for x, _, _ in segments), default=0) == pytest.approx(max(best, 0))
        assert all(x == pytest.approx(sum(s[i : j + 1])) for x, i, j in segments)


def test_odds_of_beginnings():
    """Terms, backed off along their beginnings, against a version that walks down from the shortest."""
    rng = random.Random(3)
    texts = [(rng.random() < 0.3, {rng.choice(["bad", "badly", "go", "good", "b"]) + rng.choice(["", "x", "yy", "zzzzzzz"]) for _ in range(6)}) for _ in range(300)]
    texts = [(y, words | ({"badder" + rng.choice("pqr")} if y else set())) for y, words in texts]
    counts = collections.defaultdict(lambda: [0, 0])
    for y, words in texts:
        for w in words:
            for t in (w, *toxicity.beginnings(w)):
                counts[t][not y] += 1
    total = [sum(len(w) for y, w in texts if y == z) for z in (True, False)]
    model = toxicity.odds({t: tuple(x) for t, x in counts.items()}, *total)
    base = np.log(total[0] / total[1])
    for w in {w for _, words in texts for w in words} | {"badders", "unseen"}:
        prior = 0.0
        for t in [*toxicity.beginnings(w)[::-1], w]:
            q = 1 / (1 + np.exp(-prior - base))
            a, b = (n + 10 * x for n, x in zip(counts.get(t, (0, 0)), (q, 1 - q), strict=True))
            new = np.log(a / b) - base
            if abs(new - prior) >= 2 * np.sqrt(1 / a + 1 / b):
                prior = new if new >= 1.5 else 0.0
        assert model.word(w) == pytest.approx(prior)
    assert model.word("badders") > 1.5 > model.word("goodx") and model.drift < 0


# 9

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="ad banner">Buy now</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bo</b>ld\n  text&nbsp;here.<br>Next<p>Second para<!-- c --> &copy; 5 &lt; 6</p><aside>Side words</aside><div class="comments"><p>Reader says hi</p></div><form>Mail <input name=m></form></article>
<div class=sidebar>Links</div><footer>&copy; foot words</footer></body></html>"""
CLEAN = "Head & line First bold text here. Next Second para © 5 < 6"


def test_html_text(spark, empty):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>unclosed <b>words & more"), (None, "x", PAGE.replace("article", "section")), (5, "y", "<nav>only menu</nav>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("own"))
    got = html_text.extract(pages, html_text.fit(pages)).collect()
    assert [r.text for r in got if r.page_id == 1] == [CLEAN] * 2
    by = {r.page_id: r.text for r in got}
    assert by[2] == by[3] == by[5] == "" and by[4] == "unclosed words & more" and by[None] == CLEAN
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


# 10


def counts_by_hand(t):
    w = words(t)
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeat = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)


def test_quality_counts(spark, docs, edge, edge_rows, empty):
    for frame, rows in ((docs, corpus()), (edge, edge_rows)):
        got = quality.with_counts(frame).select("doc_id", "text", *quality.COUNTS[:5], quality.base_failed().alias("f")).collect()
        assert len(got) == len(rows) and all(tuple(r)[2:] == counts_by_hand(r.text) for r in got)
    assert quality.with_counts(empty).count() == 0
    assert quality.count_texts(["a b\nx x x x\n \na b\nx x x x\na b"])["n_dup_lines"].tolist() == [3]


def test_quality_rules(spark, edge):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(4000):
        good = i % 4 > 0
        own = [f"w{rng.randrange(5000)}" + ("" if good else rng.choice(["***", "$$$", ""])) for _ in range(60)]
        rows.append((i, " ".join(own), "en" if i % 40 else "xx", "s", 0))
        labels.append((i, int(good), 0))
    docs, marked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    counts = quality.with_counts(docs).cache()
    cutoffs = quality.fit(counts, marked)
    assert set(cutoffs) == {"en", None} and set(cutoffs["en"]) == {"symbol_ratio"}
    assert not cutoffs[None]  # the other stratum is too small for the guarantee
    kept = {r.doc_id for r in quality.keep(docs, marked).collect()}
    assert all(i in kept for i in range(4000) if i % 4 > 0)
    assert sum(i not in kept for i in range(0, 4000, 4) if i % 40) > 800
    assert quality.fit(counts, marked.limit(0)) == {}
    other = marked.selectExpr("doc_id", "1 - quality quality", "toxic")
    assert quality.fit(counts, marked.union(other)) == {}  # labels that disagree
    assert quality.keep(edge, marked).columns == edge.columns


def test_upper_bound():
    for k, n, delta in ((0, 100, 0.05), (3, 50, 0.01), (10, 400, 0.001)):
        p = quality.upper_bound(k, n, delta)
        tail = sum(np.exp(np.sum(np.log(np.arange(n - i + 1, n + 1))) - np.sum(np.log(np.arange(1, i + 1))) + i * np.log(p) + (n - i) * np.log1p(-p)) for i in range(k + 1))
        assert tail == pytest.approx(delta, rel=1e-6)
    assert quality.upper_bound(5, 5, 0.1) == 1.0 and quality.upper_bound(0, 0, 0.1) == 1.0
