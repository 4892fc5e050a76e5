"""Operator 10: quality rules with risk-controlled thresholds.

Every document gets counts over its whole text. Ratios of these counts are the rules; a rule rejects a document whose
ratio exceeds the rule's cutoff. Cutoffs come from labelled documents that pass the base rule, in two parts by a hash of the id.

One in SELECT makes the order in which cutoffs are tightened: of each rule's (false, true) rejections the steps of the concave
hull, all rules' steps together by how many more bad than good documents (as shares) they reject, at least GAIN times as many; a
cutoff is the middle one of those that reject the same documents. The order doesn't depend on the others, the holdouts, so these
test it as a fixed sequence: in each stratum (language), step by step, the false rejections of all rules together have an exact
(Clopper-Pearson) upper bound of at most ``max_false_rejection``, else the stratum stays at the step before. A fixed sequence
needs no correction over its steps; over the strata it is Bonferroni's. Strata with too few good holdouts for any guarantee are
one stratum together, which holds for every other document too; if that one is too small, only the base rule rejects there.

Defined results: null or empty text has no words and fails the base rule; a null language is the stratum "";
rows repeat as they come; labels of a null id, null labels, and ids whose labels disagree aren't used; an empty table gives an
empty result; without labels only the base rule rejects. Columns with the counts' names give way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, pieces, unpacked, working

#: Words of a document that passes the base rule, at least.
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_marks")
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio")
#: Cutoffs that may be chosen: k / GRID, for k from 1 to GRID - 1.
GRID = 256
#: One labelled document in so many orders the cutoffs; how many times the share of good ones a step rejects of the bad.
SELECT, GAIN = 4, 10.0


def _repeat_words(lengths: np.ndarray, words: list[bytes]) -> np.ndarray:
    """For each text, the words in a 3-word window that the text has twice or more."""
    n = len(words)
    out = np.zeros(len(lengths), np.int64)
    if n < 4:
        return out
    owner = np.repeat(np.arange(len(lengths)), lengths)
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + owner[:-2].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    hit = np.concatenate([order[1:][same], order[:-1][same]])
    for j in range(3):
        twice[hit + j] = True
    return np.bincount(owner[twice], minlength=len(lengths)).astype(np.int64)


def count_texts(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of COUNTS for whole texts."""
    rows, lengths, words = [], [], []
    for s in texts:
        own = s.encode().split()
        lengths.append(len(own))
        words += own
        seen, dup, lines = set(), 0, 0
        for line in s.split("\n"):
            if line.strip(BLANKS):
                lines += 1
                if line in seen:
                    dup += 1
                seen.add(line)
        chars = len(s) - sum(map(s.count, BLANKS))
        rows.append((chars, sum(map(s.count, SYMBOLS)), dup, _upper(s), lines, s.count("!")))
    lengths = np.array(lengths, np.int64)
    table = np.array(rows, np.int64).reshape(-1, 6)
    return {"n_words": lengths, "word_chars": table[:, 0], "n_symbols": table[:, 1], "n_dup_lines": table[:, 2], "n_repeat_words": _repeat_words(lengths, words), "n_upper": table[:, 3], "n_lines": table[:, 4], "n_marks": table[:, 5]}


def _upper(s: str) -> int:
    """Letters that lower-casing changes; one pass of the string's own methods, and exact where casing keeps length."""
    low = s.lower()
    if len(low) != len(s):
        return sum(a.lower() != a for a in s)
    a, b = np.frombuffer(s.encode("utf-32-le"), np.uint32), np.frombuffer(low.encode("utf-32-le"), np.uint32)
    return int(np.count_nonzero(a != b))


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The table with the columns of COUNTS; columns of these names in the input give way."""
    docs = docs.drop(*COUNTS)
    columns = docs.columns
    at = columns.index(text)
    kept = [i for i in range(len(columns)) if keep_text or i != at]
    names = [*(columns[i] for i in kept), *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            for piece in pieces(batch, at, 2 << 20):
                got = count_texts([x or "" for x in piece.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in kept), *(pa.array(got[c]) for c in COUNTS)], names=names)

    fields = [docs.schema.fields[i] for i in kept]
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} bigint" for c in COUNTS)]))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict:
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return {"symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"), "upper_ratio": per("n_upper", "word_chars"), "mark_ratio": per("n_marks", "word_chars")}


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p for which k or fewer of n have probability delta or more."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        below = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs)) if 0 < p < 1 else float(p == 0)
        lo, hi = (p, hi) if below > delta else (lo, p)
    return hi


def selects(key):
    """Column: whether a labelled document orders the cutoffs, by the md5 of its id."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 6), 16, 10).cast("bigint") % SELECT == 0


def least_holdouts(max_false_rejection: float, level: float) -> int:
    """Good holdouts that bound the false rejections when none is seen."""
    return math.ceil(math.log(level) / math.log1p(-max_false_rejection))


def hull_steps(hist: dict[int, tuple[int, int]], goods: int, bads: int) -> list[tuple[float, int]]:
    """(gain, cutoff) of the steps of one rule, from (good, bad) documents by bin: cutoffs fall, and gains too."""
    points, false, true = [(0, 0, GRID, GRID)], 0, 0
    for k in range(GRID - 1, 0, -1):
        good, bad = hist.get(k, (0, 0))
        false, true = false + good, true + bad
        if (false, true) == points[-1][:2]:
            points[-1] = (false, true, points[-1][2], k)  # the same documents: a run of cutoffs
        else:
            points.append((false, true, k, k))
    hull: list[tuple[int, int, int, int]] = []
    for x in points:
        while hull and (hull[-1][0] >= x[0] or (len(hull) > 1 and (x[1] - hull[-1][1]) * (hull[-1][0] - hull[-2][0]) >= (hull[-1][1] - hull[-2][1]) * (x[0] - hull[-1][0]))) and x[1] > hull[-1][1]:
            hull.pop()
        if not hull or x[1] > hull[-1][1]:
            hull.append(x)
    out, last = [], (0, 0)
    for false, true, top, low in hull:
        if true > last[1]:
            gain = math.inf if false == last[0] else (true - last[1]) / bads * goods / (false - last[0])
            out.append((gain, (top + low + 1) // 2))
            last = false, true
    return out


def cutoff_path(hists: dict[str, dict[int, tuple[int, int]]], gain: float = GAIN) -> list[tuple[str, int]]:
    """(rule, cutoff) in the order in which the rules are tightened."""
    steps = []
    for rule in RULES:
        own = hists.get(rule, {})
        goods, bads = (sum(x[i] for x in own.values()) for i in (0, 1))
        if goods and bads:
            steps += [(-g, RULES.index(rule), -k) for g, k in hull_steps(own, goods, bads) if g >= gain]
    return [(RULES[r], -k) for _, r, k in sorted(steps)]


def fixed_sequence(path: list[tuple[str, int]], steps: dict[int, int], n: int, level: float, risk: float) -> dict[str, float]:
    """The cutoffs after the last step of the path before one that fails; steps: good holdouts by the step that first rejects them."""
    cutoffs, false = {}, 0
    for t, (rule, k) in enumerate(path, 1):
        false += steps.get(t, 0)
        if upper_bound(false, n, level) > risk:
            break
        cutoffs[rule] = k / GRID
    return cutoffs


def fit(counts: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", stratum: str = "lang", good: str = "quality", max_false_rejection: float = 0.05, delta: float = 0.05) -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum and rule; None stands for all other strata.

    Only histograms reach the driver: GRID rows a rule, a row a step for each stratum with enough holdouts for a guarantee (so
    their number is bounded by the labels over that least number).
    """
    held = labels.select(F.col(id_col).alias("id"), (F.col(good) == 1).alias("good")).where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"), F.max("good").alias("also")).where("good = also").drop("also")
    bins = [F.least(F.ceil(v * GRID) - 1, F.lit(GRID - 1)).cast("int").alias(k) for k, v in ratios().items()]
    rows = counts.where(~base_failed()).select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *bins).join(held, "id")
    rows = materialize(rows.withColumn("selects", selects(F.col("id"))), "quality-holdouts")
    goods, bads = F.count_if("good").alias("goods"), F.count_if(~F.col("good")).alias("bads")
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES))).alias("x")
    hists: dict[str, dict[int, tuple[int, int]]] = {r: {} for r in RULES}
    for r in rows.where("selects").select("good", each).groupBy("x.rule", "x.bin").agg(goods, bads).collect():
        hists[r.rule][r.bin] = (r.goods, r.bads)
    path = cutoff_path(hists)
    if not path:
        return {}
    held = rows.where("not selects")
    sizes = held.groupBy("stratum").agg(goods)
    need = least_holdouts(max_false_rejection, delta)
    for _ in range(20):  # more strata need more holdouts each
        own = [r.stratum for r in sizes.where(F.col("goods") >= need).select("stratum").collect()]
        level = delta / (len(own) + 1)
        if need >= least_holdouts(max_false_rejection, level):
            break
        need = least_holdouts(max_false_rejection, level)
    step = F.least(F.lit(len(path) + 1), *(_first_step(path, rule) for rule in RULES))
    group = F.when(F.col("stratum").isin(own), F.col("stratum"))
    found: dict[str | None, dict[int, int]] = {}
    for r in held.groupBy(group.alias("group"), step.alias("step")).agg(goods).collect():
        found.setdefault(r.group, {})[r.step] = r.goods
    return {g: fixed_sequence(path, steps, sum(steps.values()), level, max_false_rejection) for g, steps in found.items()}


def _first_step(path: list[tuple[str, int]], rule: str):
    """Column: the first step of the path at which the rule rejects a row with that bin; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for t, (r, k) in enumerate(path, 1):
        if r == rule:
            out = out.when(F.col(rule) >= k, F.lit(t))
    return out


def verdict(cutoffs: dict[str | None, dict[str, float]], stratum: str = "lang"):
    """Column: true for documents that pass the base rule and every rule."""
    ok = ~base_failed()
    name = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    own = {s: c for s, c in cutoffs.items() if s is not None}
    for rule, value in ratios().items():
        cut = F.lit(cutoffs.get(None, {}).get(rule, math.inf))
        if own:
            given = F.create_map(*(x for s, c in sorted(own.items()) for x in (F.lit(s), F.lit(c.get(rule, math.inf)))))
            cut = F.coalesce(given[name], cut)
        ok = ok & ~F.coalesce(value > cut, F.lit(False))
    return ok


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns.

    Two narrow passes over the texts: one for the cutoffs, of which only counts are shuffled, one that filters.
    """
    cutoffs = fit(with_counts(docs.select("doc_id", "lang", "text"), keep_text=False), labels, **options)
    others = docs.drop("text")  # the text goes through the workers once
    passed = with_counts(docs.select(packed(others), "text", "lang")).where(verdict(cutoffs))
    back = dict(zip(others.columns, unpacked(others), strict=True))
    return passed.select(*(back.get(c, c) for c in docs.columns))
