"""The registered queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, mixing, quality, sharding, simhash, substring_dedup, token_files, toxicity, url_filter
from .common import materialize, run_dir, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4, seed=42)
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.strip_repeats(table(spark, sf_dir, "documents"), size=20).drop("kept_text")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.checksums(token_files.read_tokens(spark, path))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.write_shards(table(spark, sf_dir, "documents"), run_dir(spark, "shards"), shards=24)
    rows = sharding.digests(shards, "shard", "slot", "grown_shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


def _digits(text, digits: int = 6):
    """A number from the first hex digits of the md5; SQL has the same."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have neither fetch days nor lists: both are made from hashes of the URLs and of their keys."""
    pages = table(spark, sf_dir, "pages")
    first = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(first, (_digits(F.col("url")) % 360).cast("int")).alias("fetched"))
    keys = pages.select(F.explode(url_filter.keys_of(F.col("url"))).alias("key")).distinct().withColumn("n", _digits(F.col("key"))).where("n % 5 < 2")
    event = F.explode(F.array(*(F.struct(F.lit(a).alias("action"), d.cast("int").alias("d")) for a, d in (("add", F.col("n") % 180), ("remove", F.col("n") % 180 + 30 + F.col("n") % 60), ("add", 300 + F.col("n") % 40)))))
    entries = keys.select("key", "n", event.alias("e")).where("e.d < 300 or n % 2 = 0").select("key", F.date_add(first, F.col("e.d")).alias("day"), "e.action")
    return url_filter.judge(captures, entries)


#: Target weights of the mix: by path; all else has weight 1.
MIX_WEIGHTS = {"web": 4.0, "books": 3.0, "forum": 1.0, "news": 2.0, "web/en": 3.0, "books/de": 2.0, "web/en/src0": 2.0}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), fraction=0.6, weights=MIX_WEIGHTS, max_epochs=2)
    return rows.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__epoch").alias("epoch"), F.col("__tokens").alias("n_tokens"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages)).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counts = materialize(quality.with_counts(docs, keep_text=False), "quality-counts")
    cutoffs = quality.fit(counts, table(spark, sf_dir, "labels"))
    return counts.select("doc_id", *quality.COUNTS[:5], quality.base_failed().alias("base_failed"), quality.verdict(cutoffs).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_substring_dedup, op3_tokens, op4_sharding, op5_decontaminate, op6_url_filter, op7_mixing, op8_toxicity, op9_html_text, op10_quality_rules)}
SQL: dict[str, str] = {}


def _simhash_sql() -> str:
    """Operator 1: XXH64 by its rules in 128-bit numbers, majority bits, all pairs of fingerprints, and their closure."""
    # fixed values of XXH64
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    top, seed = 1 << 64, 42
    u = lambda v: f"{v}::UHUGEINT"
    mod = lambda e: f"(({e}) % {u(top)})"
    mul = lambda e, p: mod(f"{e} * {u(p)}")
    turn = lambda e, r: f"(({e}) % {u(1 << 64 - r)} * {u(1 << r)} + ({e}) // {u(1 << 64 - r)})"
    number = lambda text, n: f"CAST(CAST('0x' || " + " || ".join(f"substr({text}, {2 * k + 1}, 2)" for k in reversed(range(n))) + " AS UBIGINT) AS UHUGEINT)"
    fold = lambda e, k, r, p, q: mod(f"{turn(f'xor({e}, {k})', r)} * {u(p)} + {u(q)}")
    upper = "".join(map(chr, range(65, 91)))
    rounds = lambda j, start: f"list_reduce([{u(start % top)}] || list_transform(range({j}, n // 32 * 4 + {j}, 4), lambda i: lanes[i]), lambda v, x: {mul(turn(mod(f'v + x * {u(p2)} % {u(top)}'), 31), p1)})"
    parts = [
        rf"w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents)",
        "g AS (SELECT doc_id, unnest(CASE WHEN len(w) > 4 THEN list_transform(range(1, len(w) - 2), lambda x: array_to_string(w[x:x + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)",
        "b AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM (SELECT DISTINCT s FROM g))",
        f"l AS (SELECT s, x, n, list_transform(range(0, n // 8), lambda i: {number('substr(x, 16 * i + 1, 16)', 8)}) AS lanes FROM b)",
        f"v AS (SELECT *, {', '.join(f'{rounds(j + 1, a)} AS v{j}' for j, a in enumerate((seed + p1 + p2, seed + p2, seed, seed - p1)))} FROM l WHERE n >= 32)",
        f"v4 AS (SELECT s, x, n, lanes, {mod(' + '.join(turn(f'v{j}', r) for j, r in enumerate((1, 7, 12, 18))))} AS h, {', '.join(f'{mul(turn(mul(f'v{j}', p2), 31), p1)} AS k{j}' for j in range(4))} FROM v)",
    ]
    name = "v4"
    for j in range(4):
        parts.append(f"m{j} AS (SELECT s, x, n, lanes, {mod(f'xor(h, k{j}) * {u(p1)} + {u(p4)}')} AS h, k0, k1, k2, k3 FROM {name})")
        name = f"m{j}"
    parts += [
        f"h0 AS (SELECT s, x, n, lanes, {mod('h + n::UHUGEINT')} AS h FROM m3 UNION ALL SELECT s, x, n, lanes, {mod(f'{u(seed + p5)} + n::UHUGEINT')} FROM l WHERE n < 32)",
        f"h1 AS (SELECT s, x, n, list_reduce([h] || list_transform(range(n // 32 * 4 + 1, n // 8 + 1), lambda i: {mul(turn(mul('lanes[i]', p2), 31), p1)}), lambda h, k: {fold('h', 'k', 27, p1, p4)}) AS h FROM h0)",
        f"h2 AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {fold('h', mul(number('substr(x, 16 * (n // 8) + 1, 8)', 4), p1), 23, p2, p3)} ELSE h END AS h FROM h1)",
        f"h3 AS (SELECT s, list_reduce([h] || list_transform(range(n - n % 4, n), lambda i: {mul(number('substr(x, 2 * i + 1, 2)', 1), p5)}), lambda h, k: {mod(turn('xor(h, k)', 11) + f' * {u(p1)}')}) AS h FROM h2)",
        f"h4 AS (SELECT s, {mul(f'xor(h, h // {u(1 << 33)})', p2)} AS h FROM h3)",
        f"h5 AS (SELECT s, {mul(f'xor(h, h // {u(1 << 29)})', p3)} AS h FROM h4)",
        f"h6 AS (SELECT s, CAST(xor(h, h // {u(1 << 32)}) AS UBIGINT) AS h FROM h5)",
    ]
    bits = " + ".join(f"CASE WHEN 2 * sum(h >> {i} & 1) > count(*) THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END" for i in range(64))
    parts += [
        f"f AS (SELECT doc_id, CAST({bits} AS UBIGINT) AS fp FROM g JOIN h6 USING (s) GROUP BY doc_id)",
        "p AS (SELECT doc_id, coalesce(fp, 0) AS fp FROM w LEFT JOIN f USING (doc_id))",
        "k AS (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp)",
        "e AS (SELECT a.fp AS a, b.fp AS b FROM k a, k b WHERE bit_count(CAST(xor(a.fp, b.fp) AS HUGEINT)) <= 4)",
        "z(a, b) AS (SELECT a, b FROM e UNION SELECT z.a, e.b FROM z JOIN e ON z.b = e.a)",
        "c AS (SELECT z.a AS fp, min(least) AS component_id FROM z JOIN k ON k.fp = z.b GROUP BY z.a)",
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM p JOIN c USING (fp)"


SQL["op1_simhash"] = _simhash_sql()
SQL["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS k FROM d)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, k + j AS p FROM later, range(20) r(j)),
pos AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT pos.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN pos.word END, ' ' ORDER BY pos.p) AS t
  FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: Operator 5 without fingerprints: every window that may match, against every item of its size.
SQL["op5_decontaminate"] = r"""
WITH w AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS v FROM benchmark),
i AS (SELECT item_id, least(len(v), 5) AS k, list_transform(range(1, len(v) - least(len(v), 5) + 2), lambda x: array_to_string(v[x:x + least(len(v), 5) - 1], ' ')) AS item FROM v WHERE len(v) > 0),
d AS (SELECT doc_id, text, k, list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' ')) AS own FROM w, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
p AS (SELECT doc_id, text, k, own, unnest(range(1, len(own) + 1)) AS place, unnest(own) AS shingle FROM d),
f AS (SELECT DISTINCT k, len(item) AS n, unnest(item) AS shingle FROM i),
s AS (SELECT DISTINCT doc_id, text, k, own, n, least(place, len(own) - least(n, len(own)) + 1) AS start FROM p JOIN f USING (k, shingle)),
c AS (SELECT doc_id, text, item_id, start - 1 AS start, n + k - 1 AS n_words, own[start:start + least(n, len(own)) - 1] AS a, item AS b FROM s JOIN (SELECT *, len(item) AS n FROM i) USING (k, n)),
m AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS shared FROM c WHERE len(list_intersect(a, b)) > 0),
r AS (SELECT doc_id, text, item_id, start, n_words, shared::DOUBLE / (len(a) + len(b) - shared)::DOUBLE AS similarity FROM m)
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(n_words AS INT) AS n_words, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY similarity DESC, start, n_words DESC) AS rank FROM r WHERE similarity >= 0.8 - 1e-12) WHERE rank = 1
"""

_HEX = "CAST('0x' || substr(md5({}), 1, 6) AS BIGINT)"
SQL["op6_url_filter"] = rf"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST({_HEX.format("url")} % 360 AS INT) AS fetched,
  rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#]*@)?(\[[^/?#\]]*\]|[^/?#:@\[]+)', 1)), '.') AS host,
  list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
k0 AS (SELECT *, string_split(host, '.') AS labels FROM c),
keys AS (SELECT page_id, url, fetched, host AS key FROM k0 WHERE host <> ''
  UNION SELECT page_id, url, fetched, array_to_string(labels[i:], '.') FROM (SELECT *, unnest(range(2, len(labels) + 1)) AS i FROM k0) WHERE host <> '' AND NOT regexp_matches(host, '^(\d+\.\d+\.\d+\.\d+|\[.*)$')
  UNION SELECT page_id, url, fetched, host || '/' || array_to_string(parts[1:i], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM k0) WHERE host <> ''),
n AS (SELECT DISTINCT key, {_HEX.format("key")} AS n FROM keys),
e AS (SELECT key, n % 180 AS d, 'add' AS action, n FROM n WHERE n % 5 < 2 UNION ALL SELECT key, n % 180 + 30 + n % 60, 'remove', n FROM n WHERE n % 5 < 2
  UNION ALL SELECT key, 300 + n % 40, 'add', n FROM n WHERE n % 5 < 2 AND n % 2 = 0),
daily AS (SELECT key, DATE '2024-01-01' + CAST(d AS INT) AS day, max(action) AS action FROM e WHERE d < 300 OR n % 2 = 0 GROUP BY ALL),
spans AS (SELECT * FROM (SELECT key, day, action, lead(day) OVER (PARTITION BY key ORDER BY day) AS last FROM daily) WHERE action = 'add'),
hit AS (SELECT page_id, url, fetched, min(spans.key) AS listed_by FROM keys JOIN spans ON spans.key = keys.key AND fetched >= day AND (last IS NULL OR fetched < last) GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched, hit.listed_by IS NOT NULL AS listed, hit.listed_by FROM c LEFT JOIN hit ON hit.page_id = c.page_id AND hit.url = c.url AND hit.fetched = c.fetched
"""


def _quality_sql() -> str:
    """Operator 10: the counts, the hull of each rule's rejections, and the sequence of exact binomial tests."""
    grid, risk, delta = quality.GRID, 0.05, 0.05
    pairs = (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"), ("n_marks", "word_chars"))
    ratios = " UNION ALL ".join(f"SELECT r, doc_id, stratum, base_failed, {i} AS rule, CASE WHEN {b} = 0 THEN 0 ELSE {a}::DOUBLE / {b}::DOUBLE END AS ratio FROM m" for i, (a, b) in enumerate(pairs))
    needed = lambda level: f"CAST(ceil(ln({level}) / ln(1 - {risk})) AS BIGINT)"
    parts = [
        "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents)",
        r"w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)",
        "win AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM w))",
        "rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM (SELECT r, k, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1) GROUP BY r)",
        "c AS (SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(string_split(t, ''), lambda x: lower(x) <> x)) AS n_upper, len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_marks FROM d JOIN w USING (r) LEFT JOIN rep USING (r))",
        "m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)",
        f"ratios AS ({ratios})",
        "lab AS (SELECT doc_id, bool_and(quality = 1) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING bool_and(quality = 1) = bool_or(quality = 1))",
        f"held AS (SELECT *, CAST(least(ceil(ratio * {grid}) - 1, {grid - 1}) AS INT) AS bin, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) % {quality.SELECT} = 0 AS selects FROM ratios JOIN lab USING (doc_id) WHERE NOT base_failed)",
        "total AS (SELECT rule, count(*) FILTER (WHERE good) AS goods, count(*) FILTER (WHERE NOT good) AS bads FROM held WHERE selects GROUP BY rule)",
        f"curve AS (SELECT g.rule, k, count(*) FILTER (WHERE bin >= k AND good) AS f, count(*) FILTER (WHERE bin >= k AND NOT good) AS t FROM (SELECT rule, unnest(range(1, {grid + 1})) AS k FROM total) g JOIN held ON held.rule = g.rule AND selects GROUP BY g.rule, k)",
        "pts AS (SELECT rule, f, t, max(k) AS top, min(k) AS low FROM curve GROUP BY rule, f, t)",
        "best AS (SELECT * FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts q WHERE q.rule = p.rule AND q.f <= p.f AND q.t >= p.t AND (q.f < p.f OR q.t > p.t)))",
        "start AS (SELECT * FROM best UNION SELECT rule, 0, 0, 0, 0 FROM total WHERE rule NOT IN (SELECT rule FROM best WHERE f = 0))",
        "hull AS (SELECT * FROM start p WHERE NOT EXISTS (SELECT 1 FROM start l, start r WHERE l.rule = p.rule AND r.rule = p.rule AND l.f < p.f AND r.f > p.f AND (p.t - l.t) * (r.f - p.f) <= (r.t - p.t) * (p.f - l.f)))",
        "step AS (SELECT *, lag(f, 1, 0) OVER (PARTITION BY rule ORDER BY f) AS pf, lag(t, 1, 0) OVER (PARTITION BY rule ORDER BY f) AS pt FROM hull)",
        "gain AS (SELECT rule, (top + low + 1) // 2 AS cut, CASE WHEN f = pf THEN 'infinity'::DOUBLE ELSE (t - pt)::DOUBLE / bads * goods / (f - pf) END AS gain FROM step JOIN total USING (rule) WHERE t > pt AND goods > 0 AND bads > 0)",
        f"path AS (SELECT rule, cut, row_number() OVER (ORDER BY gain DESC, rule, cut DESC) AS step FROM gain WHERE gain >= {quality.GAIN})",
        "rows AS (SELECT r, stratum, good, min(step) AS step FROM (SELECT DISTINCT r, stratum, good FROM held WHERE NOT selects) LEFT JOIN (SELECT r, step FROM held JOIN path ON path.rule = held.rule AND bin >= cut) USING (r) GROUP BY ALL)",
        "sizes AS (SELECT stratum, count(*) FILTER (WHERE good) AS goods FROM rows GROUP BY stratum)",
        f"need(n, own, i) AS (SELECT {needed(delta)}, (SELECT count(*) FROM sizes WHERE goods >= {needed(delta)}), 0 UNION ALL SELECT n2, (SELECT count(*) FROM sizes WHERE goods >= n2), i + 1 FROM (SELECT n, i, {needed(f'{delta} / (own + 1)')} AS n2 FROM need) WHERE n < n2 AND i < 19)",
        f"final AS (SELECT n, {delta} / (own + 1) AS level FROM need ORDER BY i DESC LIMIT 1)",
        "grouped AS (SELECT rows.*, CASE WHEN goods >= n THEN stratum ELSE '\0' END AS grp FROM rows JOIN sizes USING (stratum), final)",
        "counted AS (SELECT grp, path.step, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND grouped.step <= path.step) AS wrong FROM grouped, path GROUP BY ALL)",
        f"tested AS (SELECT grp, step, list_sum(list_transform(range(0, wrong + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) > level AS fails FROM (SELECT counted.*, level FROM counted, final))",
        "safe AS (SELECT grp, path.rule, min(cut) AS cut FROM tested JOIN path USING (step) WHERE step < coalesce((SELECT min(x.step) FROM tested x WHERE x.grp = tested.grp AND fails), 1 << 30) GROUP BY ALL)",
        f"gone AS (SELECT DISTINCT r FROM (SELECT ratios.*, CASE WHEN goods >= n THEN ratios.stratum ELSE '\0' END AS grp FROM ratios LEFT JOIN sizes USING (stratum), final) x JOIN safe ON safe.grp = x.grp AND safe.rule = x.rule WHERE ratio > cut::DOUBLE / {grid})",
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM gone) AS kept FROM m"


SQL["op10_quality_rules"] = _quality_sql()


def _mix_sql() -> str:
    """Operator 7 without buckets: one ordered sum per leaf."""
    weight = "CASE concat_ws('/', {}) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MIX_WEIGHTS.items()) + " ELSE 1::DOUBLE END"
    parts = [
        r"d AS (SELECT doc_id, ['web', 'books', 'forum', 'news'][coalesce(TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS INT), 0) % 4 + 1] AS domain, lang AS own_lang, source AS own_source, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents)",
        "leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL)",
        "n0 AS (SELECT CAST(floor(sum(tokens) * 0.6::DOUBLE) AS DOUBLE) AS given FROM leaves)",
    ]
    for depth in (1, 2, 3):
        own = ", ".join(mixing.LEVELS[:depth])
        parent = mixing.LEVELS[: depth - 1]
        group = f"PARTITION BY {', '.join(parent)} " if parent else ""
        join = f"JOIN n{depth - 1} USING ({', '.join(parent)})" if parent else ", n0"
        parts += [
            f"a{depth} AS (SELECT * FROM (SELECT {own}, CAST(sum(tokens) * 2 AS DOUBLE) AS cap, {weight.format(own)} AS w FROM leaves GROUP BY {own}) x {join})",
            f"b{depth} AS (SELECT *, greatest(given - coalesce(sum(cap) OVER ({group}ORDER BY cap / w, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) * w / sum(w) OVER ({group}ORDER BY cap / w, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM a{depth})",
            f"n{depth} AS (SELECT {own}, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS given FROM (SELECT *, max(CASE WHEN share < cap THEN share / w END) OVER ({group}) AS level FROM b{depth}))",
        ]
    parts += [
        "plan AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(given / tokens) AS BIGINT) ELSE 0 END AS epochs FROM leaves JOIN n3 USING (domain, lang, source))",
        "o AS (SELECT d.doc_id, d.domain, d.own_lang, d.own_source, d.tokens, p.epochs, CAST(floor(p.given) AS BIGINT) - p.epochs * p.tokens AS rest, sum(d.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42|' || p.epochs || '|' || coalesce(CAST(d.doc_id AS VARCHAR), ''))) AS upto FROM d JOIN plan p USING (domain, lang, source))",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, domain, own_lang AS lang, own_source AS source, epoch, tokens AS n_tokens FROM (SELECT *, unnest(range(0, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM o)"


SQL["op7_mixing"] = _mix_sql()
