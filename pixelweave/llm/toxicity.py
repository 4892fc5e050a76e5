"""Operator 8: toxic passages by maximum-scoring segments.

Words (lower-cased runs of letters, digits and apostrophes) score their log-odds between labelled toxic and other texts, against
the odds of all words. The odds have Dirichlet priors along a word's beginnings: a term (a beginning of LOW to HIGH letters of a
longer word, or a whole word) has the counts of its words, once for each text, and PRIOR more words dealt out as the term before
it has them. A term has own odds where they differ from those by MIN_Z standard deviations; a word scores as its longest such
term. Odds under MIN_ODDS, and words without a term, are one class, whose common log-odds, at most DRIFT, is the score of its
words. The k-th time that a text has a word, a positive score counts by 1 / k.

One linear scan (Ruzzo and Tompa) per text finds all maximal segments. Karlin-Altschul statistics turn a segment's score S into
E = K n exp(-lambda S): lambda is solved from the words of the other texts, K fitted on them. A segment with E below ``MAX_E`` is
a significant passage. All passages of a text together have one extreme-value figure: minus the log of the chance that the r best
have their sum, for the r at which it is largest. A logistic curve maps it to a probability. Lambda, K and the curve are fitted
on scores of texts by a model that hasn't seen them: the sample is cut into FOLDS parts, each scored by the others' counts.

The classifier is fitted on a bounded sample of labelled rows: the ``MAX_FIT`` labelled ones first by a seeded hash of
the id. Scores cover whole texts of all rows. Labels, language, source and id are no inputs of a score. Empty, null and
neutral texts get the curve's lowest value; without labels of both kinds every score is 0. An id with several labels is toxic if
one says so. Repeated rows are scored alike; rows with a null id count as not held out and are never learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, mix, pieces, windows_hash, word_hashes, working

#: Bound of the labelled sample that the model is fitted on.
MAX_FIT = 20_000
#: Words that the prior of a term deals out; letters of the shortest and longest beginning that is a term.
PRIOR, LOW, HIGH = 10.0, 3, 8
#: Least z-score of a term's own odds, least log-odds that aren't neutral, most of the neutral words' score.
MIN_Z, MIN_ODDS, DRIFT = 2.0, 1.5, -0.02
MAX_E = 1e-2
FOLDS = 4
#: Labelled texts that a task counts.
TEXTS = 400
#: Words whose scores a worker remembers.
REMEMBERED = 500_000
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def beginnings(word: str) -> list[str]:
    """The terms that a word belongs to but for itself, longest first."""
    return [word[:k] + "*" for k in range(min(HIGH, len(word) - 1), LOW - 1, -1)]


def _before(term: str) -> str:
    """The term that the odds of a term start from; empty for the odds of all words."""
    return next(iter(beginnings(term.removesuffix("*"))), "")


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)  # by term; 0 for those that are neutral after all
    drift: float = -0.1
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = -50.0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        """The log-odds of a word; 0 if it is neutral."""
        s = self.scores.get(word)
        for term in beginnings(word) if s is None else ():
            s = self.scores.get(term)
            if s is not None:
                break
        s = s or 0.0
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = s
        return s

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(number of the word, score) of the words that aren't neutral."""
        out, seen, known = [], Counter(), self.known
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = self.word(w)
            if s:
                if s > 0:
                    seen[w] += 1
                    s /= seen[w]
                out.append((i, s))
        return out

    def segments(self, hits: list[tuple[int, float]]) -> list[tuple[float, int, int]]:
        """All maximal segments (score, first word, last word). Neutral runs are passed in one step."""
        out: list[list] = []  # sums at the start and at the end, first and last word
        total, seen = 0.0, -1
        for i, s in hits:
            total += self.drift * (i - 1 - seen)
            seen = i
            left, total = total, total + s
            if s <= 0:
                continue
            seg = [left, total, i, i]
            while True:  # join backwards as long as the sum grows
                j = len(out) - 1
                while j >= 0 and out[j][0] >= seg[0]:
                    j -= 1
                if j < 0 or out[j][1] >= seg[1]:
                    break
                seg = [out[j][0], seg[1], out[j][2], i]
                del out[j:]
            out.append(seg)
        return [(b - a, i, j) for a, b, i, j in out]

    def excess(self, best: float, n: int) -> float:
        """Minus the log of the E-value of a segment of this score in n words."""
        return self.lam * best - math.log(max(self.k * max(n, 1), 1e-9))

    def strength(self, scores: list[float], n: int) -> float:
        """Minus the log of the chance of the segments, at least 0: the best number of the highest of them is taken, each one
        more than one halving the chance of being looked at."""
        out = total = 0.0
        for r, best in enumerate(sorted(scores, reverse=True), 1):
            if (more := self.excess(best, n)) <= 0:
                break
            total += more
            out = max(out, total - (r - 1) * (math.log(max(total, 1.0)) + math.log(2)) + math.lgamma(r + 1) + math.lgamma(r))
        return out

    def probability(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * strength + self.bias))))

    def score(self, text: str) -> tuple[float, list[tuple[float, int, int]]]:
        """The text's probability and its significant passages (score, first character, end in the lower-cased text)."""
        low = text.lower()
        words = WORD.findall(low)
        segments = self.segments(self.hits(words))
        strong = [x for x in segments if self.excess(x[0], len(words)) >= -math.log(MAX_E)]
        if strong:
            spans = [m.span() for m in WORD.finditer(low)]
            strong = [(s, spans[i][0], spans[j][1]) for s, i, j in strong]
        return self.probability(self.strength([s for s, _, _ in segments], len(words))), strong


def held_out():
    """Column: true where crc32 of the id as text leaves 0 by 5; these rows are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two least hashes of each text's 3-word shingles; near copies mostly share them."""
    working("toxicity")
    for batch in batches:
        for piece in pieces(batch, 1):
            found = []
            for t in as_bytes(piece.column(1)):
                h = word_hashes(t.split())
                g = windows_hash(h, min(3, len(h))) if len(h) else np.zeros(1, np.uint64)
                found.append([int(x.min().view(np.int64)) for x in (g, mix(g + np.uint64(1)))])
            m = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(m[:, 0]), pa.array(m[:, 1])], names=["doc_id", "text", "toxic", "fold", "a", "b"])


def _counts(by: str) -> list[str]:
    return [f"{by}{f}" for f in range(FOLDS)]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, fold) to (term, toxic texts by fold, other texts by fold) of a few texts at a time; a beginning counts once for
    each of its words that the text has."""
    for batch in batches:
        for piece in pieces(batch, 0, 1 << 20):
            by = [Counter() for _ in range(2 * FOLDS)]
            for text, y, f in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                words = set(WORD.findall(text.lower()))
                own = by[f if y == 1 else FOLDS + f]
                own.update(words)
                own.update(b for w in words for b in beginnings(w))
            terms = list(set().union(*by))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in by)], names=["term", *_counts("n"), *_counts("m")])


def odds(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> Model:
    """The model of (toxic, other) counts by term, out of so many words of toxic and other texts."""
    if toxic <= 0 or other <= 0:
        return Model()
    base, own = math.log(toxic / other), {}
    left = {}  # counts of a term's words that have no longer term

    def nearest(term: str) -> str:
        while (term := _before(term)) and term not in own:
            pass
        return term

    for term in sorted(counts, key=lambda t: (len(t) if t.endswith("*") else math.inf, t)):
        n, m = counts[term]
        above = nearest(term)
        prior = own.get(above, 0.0)
        q = 1 / (1 + math.exp(-prior - base))
        a, b = n + PRIOR * q, m + PRIOR * (1 - q)
        value = math.log(a / b) - base
        if abs(value - prior) < MIN_Z * math.sqrt(1 / a + 1 / b):
            continue
        value = value if value >= MIN_ODDS else 0.0
        if value or prior:
            own[term] = value
            left[term] = [n, m]
            if above:
                left[above][0] -= n
                left[above][1] -= m
    hit = [sum(left[t][i] for t, s in own.items() if s) for i in (0, 1)]
    return Model(scores=own, drift=min(DRIFT, math.log((max(0, toxic - hit[0]) + 1) / (max(0, other - hit[1]) + 1)) - base))


def calibrate(model: Model, stats: list[tuple[list[float], list[float], int, int]]) -> Model:
    """Fits lambda, K and the curve to (scores of the segments, scores of the hits, words, 0 or 1) of the sample."""
    other = [x for x in stats if not x[3]]
    words = max(1, sum(n for _, _, n, _ in other))
    hits = np.array([s for _, h, _, _ in other for s in h], float)
    lo, hi = 1e-6, 20.0  # lambda: the mean of exp(lambda s) over the words of the other texts is 1
    for _ in range(60):
        mid = (lo + hi) / 2
        mean = (np.exp(np.minimum(500.0, mid * hits)).sum() + (words - len(hits)) * math.exp(mid * model.drift)) / words
        lo, hi = (lo, mid) if mean > 1 else (mid, hi)
    model.lam = min(max(lo, 0.05), 5.0)
    tails = [math.exp(min(50.0, model.lam * max(s))) / max(n, 1) for s, _, n, _ in other if s]
    model.k = min(1.0, max(1e-6, float(np.median(tails)) if tails else 1.0))
    x = np.array([model.strength(s, n) for s, _, n, _ in stats])
    y = np.array([y for _, _, _, y in stats], float)
    scale = max(1.0, float(np.quantile(x[y == 1], 0.5)))
    a, w = np.column_stack([np.minimum(x / scale, 10.0), np.ones_like(x)]), np.zeros(2)
    for _ in range(60):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
    model.slope, model.bias = max(0.0, float(w[0]) / scale), float(w[1])
    return model


def _terms(counts: DataFrame, toxic: int, other: int) -> DataFrame:
    """The terms that can have own odds: those with over half of MIN_ODDS, two toxic texts at least, and what lies under these."""
    n, m = (sum((F.col(c) for c in _counts(by)), F.lit(0)) for by in "nm")
    counts = counts.withColumn("n", n).withColumn("m", m)
    high = materialize(counts.where((F.col("n") >= 2) & (F.log((F.col("n") + 0.5) / (F.col("m") + 0.5)) - math.log(toxic / other) >= MIN_ODDS / 2)), "toxic-terms")
    stem = F.regexp_replace("term", r"\*$", "")
    above = F.explode(F.transform(F.sequence(F.lit(LOW), F.lit(HIGH)), lambda k: F.when(F.length(stem) > k, F.concat(F.substring(stem, 1, k), F.lit("*")))))
    under = counts.where("n + m >= 2").select("*", above.alias("above")).join(high.select(F.col("term").alias("above")), "above", "left_semi").drop("above")
    return high.unionByName(under).dropDuplicates(["term"])


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Words are counted on the executors; the driver gets the terms that may be toxic with their counts, and the segments of each of at
    most max_fit rows."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit), "toxic-labels")
    tasks = max(1, -(-sample.count() // TEXTS))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold"))
    rows = materialize(texts.mapInArrow(_marked, "doc_id bigint, text string, toxic int, fold int, a bigint, b bigint"), "toxic-sample")
    # near copies would make terms of their common words: one text of each label with the same least shingle hash
    apart = rows.groupBy("toxic", "a").agg(F.min("doc_id").alias("doc_id"), F.min_by("b", "doc_id").alias("b")).groupBy("toxic", "b").agg(F.min("doc_id").alias("doc_id"))
    single = materialize(rows.join(F.broadcast(apart.select("doc_id").distinct()), "doc_id").select("text", "toxic", "fold"), "toxic-texts")  # at most max_fit ids
    columns = [*_counts("n"), *_counts("m")]
    dealt = single.repartition(tasks, "text")
    counts = dealt.mapInArrow(_term_counts, "term string, " + ", ".join(f"{c} bigint" for c in columns)).groupBy("term").agg(*(F.sum(c).alias(c) for c in columns))
    counts = materialize(counts, "toxic-words")
    sizes = counts.where(~F.col("term").endswith("*")).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns)).first()
    toxic, other = (sum(sizes[c] for c in _counts(by)) for by in "nm")
    if not toxic or not other:
        return Model()
    found = _terms(counts, toxic, other).select("term", *columns).collect()

    def without(f: int | None) -> Model:
        ns, ms = ([c for i, c in enumerate(_counts(by)) if i != f] for by in "nm")
        return odds({r.term: (sum(r[c] for c in ns), sum(r[c] for c in ms)) for r in found}, sum(sizes[c] for c in ns), sum(sizes[c] for c in ms))

    model = without(None)
    if not model.scores:
        return Model()
    parts = docs.sparkSession.sparkContext.broadcast([without(f) for f in range(FOLDS)])  # as many terms as reach the driver

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, hits, n = [], [], []
            for text, y, f in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = WORD.findall(text.as_py().lower())
                own = parts.value[f].hits(words)
                segments.append([s for s, _, _ in parts.value[f].segments(own)])
                hits.append([s for _, s in own] if y != 1 else [])  # lambda is of the other texts
                n.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(segments, pa.list_(pa.float64())), pa.array(hits, pa.list_(pa.float64())), pa.array(n, pa.int64()), batch.column(1)], names=["segments", "hits", "n", "toxic"])

    seen = dealt.mapInArrow(stats, "segments array<double>, hits array<double>, n bigint, toxic int").collect()
    if len({r.toxic == 1 for r in seen}) < 2:
        return Model()
    return calibrate(model, [(r.segments, r.hits, r.n, int(r.toxic == 1)) for r in seen])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows' doc_id, held_out, score, predicted and passages (start, end, score) in the lower-cased text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of at most max_fit rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for piece in pieces(batch, 2, 2 << 20):
                got = [own.score(x.as_py() or "") for x in piece.column(2)]
                p = np.array([x for x, _ in got], float)
                spans = [[{"start": i, "end": j, "score": s} for s, i, j in seg] for _, seg in got]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "held_out", "score", "predicted", "passages"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, passages array<struct<start:int,end:int,score:double>>")
