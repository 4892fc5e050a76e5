"""The choice of cutoffs against plain versions over rows."""

import hashlib
import math
import random

from test_operators import SCHEMA

from pixelweave.llm import quality


def test_hull_steps():
    rng = random.Random(8)
    for _ in range(200):
        hist = {rng.randrange(quality.GRID): (rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(1, 12))}
        goods, bads = (max(1, sum(x[i] for x in hist.values())) for i in (0, 1))
        curve = {k: tuple(sum(x[i] for b, x in hist.items() if b >= k) for i in (0, 1)) for k in range(1, quality.GRID + 1)}
        steps = quality.hull_steps(hist, goods, bads)
        at = [(0, 0), *(curve[k] for _, k in steps)]
        assert at == sorted(at) and [k for _, k in steps] == sorted((k for _, k in steps), reverse=True)
        for (a, b), (c, d), (g, _) in zip(at, at[1:], steps, strict=False):
            assert g == (math.inf if a == c else (d - b) / bads * goods / (c - a))
            for false, true in curve.values():  # no cutoff lies above the line through the step
                assert (true - b) * (c - a) <= (d - b) * (false - a)
        assert max(true for _, true in curve.values()) == at[-1][1]


def test_fit_against_rows(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        good, lang = rng.random() < 0.8, rng.choices(["en", "de", "aa", "bb"], [20, 8, 1, 1])[0]
        n = rng.randrange(60, 90)
        marks = rng.randrange(0, 12) if good and rng.random() < 0.1 else 0 if good else rng.randrange(4, 30)
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        if not good and rng.random() < 0.4:
            words[10:30] = ["WORD" + w.upper() for w in words[10:30]]
        rows.append((i, " ".join(words) + " " + "#" * marks, lang, "s", 0))
        labels.append((i, int(good), 0))
    docs, marked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    counts = quality.with_counts(docs).cache()
    selects = {i for i in range(3000) if int(hashlib.md5(str(i).encode()).hexdigest()[:6], 16) % 4 == 0}
    ratio = {r.doc_id: r for r in counts.select("doc_id", "lang", (~quality.base_failed()).alias("ok"), *(v.alias(k) for k, v in quality.ratios().items())).collect()}
    good = {i: q == 1 for i, q, _ in labels}
    hists = {}
    for rule in quality.RULES:
        for i in selects:
            if ratio[i].ok:
                b = sum(ratio[i][rule] > k / quality.GRID for k in range(1, quality.GRID))
                g, x = hists.setdefault(rule, {}).get(b, (0, 0))
                hists[rule][b] = (g + good[i], x + (not good[i]))
    path = quality.cutoff_path(hists)
    got = quality.fit(counts, marked)
    assert {r for r, _ in path} >= {"symbol_ratio"} and set(got) == {"en", "de", None}
    for s, cutoffs in got.items():
        own = [i for i in good if i not in selects and good[i] and ratio[i].ok and (ratio[i].lang == s if s else ratio[i].lang in ("aa", "bb"))]
        now, best = {}, {}
        for rule, k in path:
            now[rule] = k / quality.GRID
            false = sum(any(ratio[i][r] > c for r, c in now.items()) for i in own)
            if quality.upper_bound(false, len(own), 0.05 / 3) > 0.05:
                break
            best = dict(now)
        assert cutoffs == best
    kept = {r.doc_id for r in quality.keep(docs, marked).select("doc_id").collect()}
    assert kept == {i for i, r in ratio.items() if r.ok and not any(r[k] > c for k, c in got[r.lang if r.lang in got else None].items())}
    assert sum(i not in kept for i in good if not good[i]) > 200
