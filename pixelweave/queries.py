"""The registered image queries and the same in SQL for DuckDB.

E8: the embeddings as 8 x 8 images; PHOTO: a 64 x 48 pattern for each nation.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs
from .functions.expr import RGB, RGBA, hex_color
from .operators import analyze, compose, geometry, neighbor, point
from .plans.chain import FilterChain
from .sources import derived, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COLUMNS = "image_id, x, y, r, g, b, a"

_V = lambda k: f"CAST(CAST(floor(abs(embedding[((p + {k}) % 64) + 1]::FLOAT * 1000::FLOAT)) AS BIGINT) % 256 AS INT)"
E8 = f"e8 AS MATERIALIZED (SELECT vec_id AS image_id, CAST(p % 8 AS INT) AS x, CAST(p // 8 AS INT) AS y, {_V(0)} AS r, {_V(1)} AS g, {_V(2)} AS b, CASE WHEN (vec_id + p) % 7 = 0 THEN 0 ELSE 255 END AS a FROM embeddings, range(64) t(p))"
PHOTO = "photo AS MATERIALIZED (SELECT CAST(n_nationkey AS BIGINT) AS image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST((4 * x + 2 * y + n_nationkey) % 256 AS INT) AS r, CAST((5 * y + x) % 256 AS INT) AS g, CAST(((x * x + y * y) // 7) % 256 AS INT) AS b, 255 AS a FROM nation, range(64) s(x), range(48) t(y))"


def query(name: str, sql: str | None = None, source: str = "e8"):
    def add(f):
        load = derived.vectors if source == "e8" else derived.photos
        size = (8, 8) if source == "e8" else (64, 48)
        QUERIES[name] = lambda spark, sf_dir: f(derived.fixed_dims(load(spark, sf_dir), *size)).drop("width", "height")
        if sql:
            SQL[name] = f"WITH {E8 if source == 'e8' else PHOTO} " + sql.replace("@", source)
        return f

    return add


def _project(**new: str) -> str:
    return "SELECT image_id, x, y, " + ", ".join(f"{new.get(c, c)} AS {c}" for c in RGBA) + " FROM @"


def _each(form: str) -> dict[str, str]:
    """form with # for the channel."""
    return {c: form.replace("#", c) for c in RGB}


def _near(v: str) -> str:
    return f"CAST(greatest(0::FLOAT, least(255::FLOAT, round({v}))) AS INT)"


def _luma(w) -> str:
    return "(" + " + ".join(f"{c}::FLOAT * {k}::FLOAT" for c, k in zip(RGB, w, strict=True)) + ")"


LUMA = _luma((0.299, 0.587, 0.114))
_contrast = lambda k, c="#": _near(f"({c}::FLOAT - 128::FLOAT) * {k}::FLOAT + 128::FLOAT")
_saturate = lambda k, c="#", y=LUMA: _near(f"{y} + ({c}::FLOAT - {y}) * {k}::FLOAT")
GREY = "CAST((2126 * r + 7152 * g + 722 * b) // 10000 AS INT)"

query("brightness", _project(**_each("greatest(0, least(255, # + 25))")))(lambda p: point.brightness(p, 25))
query("contrast", _project(**_each(_contrast(1.1))))(lambda p: point.contrast(p, 1.1))
query("saturate", _project(**_each(_saturate(1.5))))(lambda p: point.saturate(p, 1.5))
query("white_balance", _project(r=_near("r::FLOAT + 9::FLOAT"), b=_near("b::FLOAT - 9::FLOAT")))(lambda p: point.white_balance(p, 30))
query("grayscale", _project(**_each(GREY), a="255"))(point.grayscale)
query("sepia", _project(**{c: _near(_luma(w)) for c, w in point.SEPIA.items()}))(point.sepia)
query("invert", _project(**_each("255 - #")))(point.invert)
query("hue_rotate", _project(**{c: "CAST(trunc(greatest(0::DOUBLE, least(255::DOUBLE, " + " + ".join(f"{x}::DOUBLE * {k!r}::DOUBLE" for x, k in zip(RGB, w, strict=True)) + "))) AS INT)" for c, w in point.hue_matrix(30).items()}))(lambda p: point.hue_rotate(p, 30))
query("tint", _project(**{c: f"CAST({c} * {t} // 255 AS INT)" for c, t in zip(RGBA, (200, 120, 40, 230), strict=True)}))(lambda p: point.tint(p, (200, 120, 40, 230)))
query("colorspace_srgb", _project())(lambda p: point.convert_colorspace(p, "srgb"))
query("colorspace_grayscale", _project(**_each(GREY), a="255"))(lambda p: point.convert_colorspace(p, "grayscale"))
_P3 = "(SELECT image_id, x, y, a, " + ", ".join(f"[{','.join(map(str, point.gamma_table()))}][{c} + 1] AS {c}" for c in RGB) + " FROM @)"
query("colorspace_display_p3", _project(**_each(_saturate(1.08))).replace("FROM @", f"FROM {_P3}"))(lambda p: point.convert_colorspace(p, "display_p3"))


def _step(inner: str, **new: str) -> str:
    return _project(**new).replace("FROM @", f"FROM ({inner})")


CHAIN = FilterChain().push("Brightness", 10).push("Contrast", 1.1).push("Saturate", 0.5).push("Invert")
query("filter_chain", _step(_step(_step(_project(**_each("greatest(0, least(255, # + 10))")), **_each(_contrast(1.1))), **_each(_saturate(0.5))), **_each("255 - #")))(lambda p: FilterChain.from_json(CHAIN.to_json()).apply(p))

query("crop", "SELECT image_id, x - 10 AS x, y - 5 AS y, r, g, b, a FROM @ WHERE x BETWEEN 10 AND 29 AND y BETWEEN 5 AND 20", "photo")(lambda p: geometry.crop(p, 10, 5, 20, 16))
query("crop_aspect", "SELECT image_id, x - 8 AS x, y, r, g, b, a FROM @ WHERE x BETWEEN 8 AND 55", "photo")(lambda p: geometry.crop_aspect(p, 1, 1))
for _d, _x, _y in ((90, "47 - y", "x"), (180, "63 - x", "47 - y"), (270, "y", "63 - x")):
    query(f"rotate_{_d}", f"SELECT image_id, {_x} AS x, {_y} AS y, r, g, b, a FROM @", "photo")(lambda p, d=_d: geometry.rotate_90(p, d))
query("flip_horizontal", "SELECT image_id, 63 - x AS x, y, r, g, b, a FROM @", "photo")(geometry.flip_horizontal)
query("flip_vertical", "SELECT image_id, x, 47 - y AS y, r, g, b, a FROM @", "photo")(geometry.flip_vertical)
_corner = lambda r, w, h: f"CASE WHEN greatest({r} - x - 1, x - ({w} - {r})) > 0 AND greatest({r} - y - 1, y - ({h} - {r})) > 0 AND greatest({r} - x - 1, x - ({w} - {r})) ** 2 + greatest({r} - y - 1, y - ({h} - {r})) ** 2 > {r * r} THEN 0 ELSE a END"
query("rounded_corners", _project(a=_corner(12, 64, 48)), "photo")(lambda p: point.rounded_corners(p, 12))
query("circular_mask", _project(a=_corner(24, 48, 48)).replace("FROM @", "FROM (SELECT image_id, x - 8 AS x, y, r, g, b, a FROM @ WHERE x BETWEEN 8 AND 55)"), "photo")(geometry.circular_mask)

query("histogram", "SELECT k.image_id, k.channel, CAST(k.bin AS INT) AS bin, count(e.v) AS n FROM (SELECT DISTINCT image_id, channel, bin FROM @, (VALUES ('r'), ('g'), ('b')) c(channel), range(256) t(bin)) k LEFT JOIN (SELECT image_id, 'r' AS channel, r AS v FROM @ UNION ALL SELECT image_id, 'g', g FROM @ UNION ALL SELECT image_id, 'b', b FROM @) e ON e.image_id = k.image_id AND e.channel = k.channel AND e.v = k.bin GROUP BY ALL", "photo")(analyze.histogram)
_BUCKETS = "(SELECT image_id, r // 16 AS kr, g // 16 AS kg, b // 16 AS kb, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM @ WHERE a >= 16 GROUP BY ALL)"
_TOP = f"(SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, kr, kg, kb) AS k FROM {_BUCKETS})"
_MEANS = ", ".join(f"CAST(s{c} // n AS INT) AS {c}" for c in RGB)
query("palette", f"SELECT image_id, CAST(k AS INT) AS rank, {_MEANS}, n FROM {_TOP} WHERE k <= 5")(lambda p: analyze.palette(p, 5))
query("dominant_color", f"SELECT image_id, {_MEANS}, 255 AS a FROM {_TOP} WHERE k = 1")(analyze.dominant_color)
query("average_color", "SELECT image_id, " + ", ".join(f"CAST(sum({c} * a) // sum(a) AS INT) AS {c}" for c in RGB) + ", 255 AS a FROM @ GROUP BY image_id HAVING sum(a) > 0")(analyze.average_color)
_LUM = "SELECT image_id, CAST(CAST(s::FLOAT / n::FLOAT AS FLOAT) / 255::FLOAT AS FLOAT) AS luminance FROM (SELECT image_id, CAST(sum(CAST(trunc(0.2126::FLOAT * r::FLOAT + 0.7152::FLOAT * g::FLOAT + 0.0722::FLOAT * b::FLOAT) AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM @ GROUP BY image_id)"
query("luminance", _LUM)(analyze.luminance)
query("is_dark_light", f"SELECT image_id, luminance < 0.4::FLOAT AS is_dark, luminance >= 0.6::FLOAT AS is_light FROM ({_LUM})")(analyze.brightness_class)


def _layer(p: DataFrame, alpha: int | None = None) -> DataFrame:
    """A 16 x 16 layer for every image: its own corner, half transparent."""
    top = p.where("x < 16 and y < 16").select("image_id", "x", "y", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"))
    return top.withColumn("a", F.lit(alpha) if alpha is not None else ((F.col("x") * 17 + F.col("y")) % 256).cast("int"))


_JOIN = "(SELECT d.*, t.tr, t.tg, t.tb, t.ta FROM @ d LEFT JOIN (SELECT image_id, x + 4 AS x, y + 4 AS y, b AS tr, r AS tg, g AS tb, {a} AS ta FROM @ WHERE x < 16 AND y < 16) t ON t.image_id = d.image_id AND t.x = d.x AND t.y = d.y)"
_OVER = _JOIN.format(a="(x * 17 + y) % 256")
_AF, _AB = "(ta::FLOAT / 255::FLOAT)", "(a::FLOAT / 255::FLOAT)"
_AL = f"({_AB} + {_AF} - {_AB} * {_AF})"
_pick = lambda c, v: f"CASE WHEN ta IS NULL OR ta = 0 THEN {c} WHEN ta = 255 OR a = 0 THEN t{c} ELSE CAST(trunc({v} * 255::FLOAT) AS INT) END"
query("overlay", _project(**{c: _pick(c, f"(((t{c}::FLOAT / 255::FLOAT) * {_AF} + ({c}::FLOAT / 255::FLOAT) * {_AB} * (1::FLOAT - {_AF})) / {_AL})") for c in RGB}, a=_pick("a", _AL)).replace("FROM @", "FROM " + _OVER), "photo")(lambda p: compose.overlay(p, _layer(p), 4, 4))
_FORMS = {"normal": "T", "multiply": "B * T", "screen": "1::FLOAT - (1::FLOAT - B) * (1::FLOAT - T)", "overlay": "CASE WHEN B < 0.5::FLOAT THEN 2::FLOAT * B * T ELSE 1::FLOAT - 2::FLOAT * (1::FLOAT - B) * (1::FLOAT - T) END", "add": "least(B + T, 1::FLOAT)"}
_ST = "((ta::FLOAT / 255::FLOAT) * 0.8::FLOAT)"
for _m, _f in _FORMS.items():
    _new = {}
    for _c in RGB:
        _value = re.sub(r"\b[BT]\b", lambda m, c=_c: f"({'t' * (m[0] == 'T')}{c}::FLOAT / 255::FLOAT)", _f)
        _new[_c] = f"CASE WHEN ta IS NULL THEN {_c} ELSE " + _near(f"{_c}::FLOAT * (1::FLOAT - {_ST}) + {_near(f'({_value}) * 255::FLOAT')}::FLOAT * {_ST}") + " END"
    if _m == "normal":
        _new["a"] = "CASE WHEN ta IS NULL THEN a ELSE " + _near(f"({_AB} + {_ST} * (1::FLOAT - {_AB})) * 255::FLOAT") + " END"
    query(f"blend_{_m}", _project(**_new).replace("FROM @", "FROM " + _JOIN.format(a="200")), "photo")(lambda p, m=_m: compose.blend(p, _layer(p, 200), m, 0.8, 4, 4))
query("alpha_mask", f"SELECT d.image_id, d.x, d.y, d.r, d.g, d.b, CAST(d.a * m.m // 255 AS INT) AS a FROM @ d JOIN (SELECT image_id, 63 - x AS x, y, {_near(LUMA)} AS m FROM @) m ON m.image_id = d.image_id AND m.x = d.x AND m.y = d.y", "photo")(lambda p: compose.alpha_mask(p, geometry.flip_horizontal(p)))
_WM = "CAST(180::FLOAT / 255::FLOAT * 0.85::FLOAT AS FLOAT)"
query("watermark_bar", _project(**{c: f"CASE WHEN x BETWEEN 3 AND 33 AND y BETWEEN 30 AND 34 THEN {_near(f'{c}::FLOAT * (1::FLOAT - {_WM}) + {v}::FLOAT * {_WM}')} ELSE {c} END" for c, v in zip(RGB, (250, 240, 10), strict=True)}), "photo")(lambda p: compose.watermark_bar(p, "water", 3, 30, 10.3, (250, 240, 10, 180)))


def _blur_sql(source: str, weights: list[int], along: str, across: str, names=RGBA) -> str:
    line = f"(PARTITION BY image_id, {across} ORDER BY {along})"
    parts = []
    for c in names:
        taps = [(f"{k}({c}, {d}) OVER {line}", w) for d, w in enumerate(weights[1:], 1) for k in ("lag", "lead")]
        n = f"{c} * {weights[0]}" + "".join(f" + coalesce({t}, 0) * {w}" for t, w in taps)
        d = f"{weights[0]}" + "".join(f" + CASE WHEN {t} IS NULL THEN 0 ELSE {w} END" for t, w in taps)
        parts.append(f"CAST((2 * ({n}) + ({d})) // (2 * ({d})) AS INT) AS {c}")
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({source})"


_W = neighbor.gaussian_weights(0.8)
query("gaussian_blur", _blur_sql(_blur_sql("SELECT * FROM @", _W, "x", "y"), _W, "y", "x"), "photo")(lambda p: neighbor.gaussian_blur(p, 0.8))
_SOFT = _blur_sql(_blur_sql("SELECT *, r AS sr, g AS sg, b AS sb FROM @", neighbor.gaussian_weights(1.0), "x", "y", ("sr", "sg", "sb")), neighbor.gaussian_weights(1.0), "y", "x", ("sr", "sg", "sb"))
query("sharpen", _project(**_each("CASE WHEN abs(# - s#) >= 3 THEN greatest(0, least(255, 2 * # - s#)) ELSE # END")).replace("FROM @", f"FROM ({_SOFT})"), "photo")(lambda p: neighbor.sharpen(p, 1.0, 3))


def _resize_sql(source: str, size: tuple[int, int], out: tuple[int, int], kernel: str) -> str:
    for along, other, a, b in (("y", "x", size[1], out[1]), ("x", "y", size[0], out[0])):
        rows = ", ".join(map(str, neighbor.axis_weights(a, b, kernel)))
        sums = ", ".join(f"CAST(least(255, (greatest(sum({c} * w), 0) + 32768) // 65536) AS INT) AS {c}" for c in RGBA)
        source = f"SELECT image_id, {other}, CAST(o AS INT) AS {along}, {sums} FROM ({source}) s JOIN (VALUES {rows}) v(o, i, w) ON s.{along} = v.i GROUP BY image_id, {other}, o"
    return f"SELECT {COLUMNS} FROM ({source})"


for _k in ("nearest", "triangle", "catmull_rom", "gaussian", "lanczos3"):
    query(f"resize_{_k}", _resize_sql("SELECT * FROM @", (64, 48), (24, 30), _k), "photo")(lambda p, k=_k: neighbor.resize(p, 24, 30, k))
query("thumbnail", _resize_sql("SELECT * FROM @", (64, 48), (32, 24), "lanczos3"), "photo")(lambda p: neighbor.thumbnail(p, 32))
query("fit_stretch", _resize_sql("SELECT * FROM @", (64, 48), (40, 40), "lanczos3"), "photo")(lambda p: neighbor.fit(p, 40, 40, "stretch"))
query("fit_fill", f"SELECT image_id, x - 6 AS x, y, r, g, b, a FROM ({_resize_sql('SELECT * FROM @', (64, 48), (53, 40), 'lanczos3')}) WHERE x BETWEEN 6 AND 45", "photo")(lambda p: neighbor.fit(p, 40, 40, "fill"))
query("fit_fit", "SELECT c.image_id, CAST(c.x AS INT) AS x, CAST(c.y AS INT) AS y, " + ", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in RGBA) + f" FROM (SELECT DISTINCT image_id, px.x, py.y FROM @, range(40) px(x), range(40) py(y)) c LEFT JOIN ({_resize_sql('SELECT * FROM @', (64, 48), (40, 30), 'lanczos3')}) s ON s.image_id = c.image_id AND s.x = c.x AND s.y + 5 = c.y", "photo")(lambda p: neighbor.fit(p, 40, 40, "fit"))
_SK = "(x * 65536 - 16384 * y)"
query("perspective_skew", "SELECT w.image_id, w.x, w.y, " + ", ".join(f"CASE WHEN p.a IS NULL OR q.a IS NULL THEN 0 ELSE CAST((p.{c} * (65536 - w.f) + q.{c} * w.f + 32768) // 65536 AS INT) END AS {c}" for c in RGBA) + f" FROM (SELECT *, i + CASE WHEN f = 0 THEN 0 ELSE 1 END AS j FROM (SELECT image_id, x, y, CAST(floor({_SK} / 65536.0) AS INT) AS i, CAST({_SK} - floor({_SK} / 65536.0) * 65536 AS INT) AS f FROM @)) w LEFT JOIN @ p ON p.image_id = w.image_id AND p.y = w.y AND p.x = w.i LEFT JOIN @ q ON q.image_id = w.image_id AND q.y = w.y AND q.x = w.j", "photo")(lambda p: neighbor.perspective_skew(p, 0.25))
query("flagship", f"SELECT image_id, {_MEANS}, 255 AS a FROM {_TOP} WHERE k = 1".replace("FROM @", "FROM (" + _step(_project(**_each("greatest(0, least(255, # + 6))")), r=_near("r::FLOAT + 3.6000001430511475::FLOAT"), b=_near("b::FLOAT - 3.6000001430511475::FLOAT")) + ")"), "photo")(lambda p: analyze.dominant_color(point.white_balance(point.brightness(p, 6), 12)))


def _round_trip(name: str, quality: int = 75):
    def run(pixels: DataFrame) -> DataFrame:
        encoded = files.encode(files.pack(pixels), name, quality).withColumn("path", F.col("image_id").cast("string"))
        images = files.decode(encoded, strict=True).withColumn("image_id", F.col("path").cast("bigint"))
        return files.unpack(images)

    return run


for _n in ("Png", "Bmp", "WebP", "Ico"):
    query(f"roundtrip_{_n.lower()}", _project())(_round_trip(_n))
query("roundtrip_gif", _project(**_each("# // 64 * 64"), a="255"), "photo")(lambda p: _round_trip("Gif")(p.withColumns({c: F.expr(f"{c} div 64 * 64").cast("int") for c in RGB}).withColumn("a", F.lit(255))))


def _ramp(p: DataFrame) -> DataFrame:
    return p.withColumns({"r": F.expr("255 * x div 63").cast("int"), "g": F.expr("255 * y div 47").cast("int"), "b": F.expr("255 * (x + y) div 110").cast("int")})


def _jpeg_bound(p: DataFrame) -> DataFrame:
    """A lossy format: whether the largest difference of a channel keeps the published bound of 12 at quality 95."""
    ramp = _ramp(p)
    after = _round_trip("Jpeg", 95)(ramp).select("image_id", "x", "y", *(F.col(c).alias(f"j{c}") for c in RGB))
    worst = F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"j{c}")) for c in RGB)))
    return ramp.join(after, ["image_id", "x", "y"]).groupBy("image_id").agg((worst <= 12).alias("within"), F.count("*").alias("n"))


query("roundtrip_jpeg_bound", "SELECT image_id, true AS within, count(*) AS n FROM @ GROUP BY image_id", "photo")(_jpeg_bound)


def _encoded(p: DataFrame) -> DataFrame:
    images = files.pack(p)
    out = None
    for name in ("Png", "Jpeg", "Gif", "Bmp", "Ico", "WebP"):
        one = files.encode(images, name).select(F.concat_ws("/", "image_id", F.lit(f"{name}.dat")).alias("path"), "content")
        out = one if out is None else out.unionAll(one)
    return out


_FILES = "(SELECT image_id || '/' || f || '.dat' AS path, f FROM (SELECT DISTINCT image_id FROM @), (VALUES ('Png'), ('Jpeg'), ('Gif'), ('Bmp'), ('Ico'), ('WebP')) v(f))"
query("probe_format", f"SELECT path, f AS format FROM {_FILES}", "photo")(lambda p: files.probe_format(_encoded(p)))
query("metadata", f"SELECT path, 64 AS width_px, 48 AS height_px, f AS format, 'RGBA8' AS color_type FROM {_FILES}", "photo")(lambda p: files.metadata(_encoded(p)).select("path", F.col("width").alias("width_px"), F.col("height").alias("height_px"), "format", "color_type"))
query("solid", "SELECT 0::BIGINT AS image_id, CAST(p % 64 AS INT) AS x, CAST(p // 64 AS INT) AS y, 200 AS r, 60 AS g, 40 AS b, 255 AS a FROM range(3072) t(p)", "photo")(lambda p: derived.solid(p.sparkSession, 64, 48, (200, 60, 40, 255)))
query("hex_color", "SELECT n_nationkey, v AS text, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS r FROM (SELECT n_nationkey, '##' || lower(printf('%02x', n_nationkey)) || CASE WHEN n_nationkey % 2 = 0 THEN '1020' ELSE 'zz20' END AS v FROM nation)", "photo")(lambda p: p.select(F.col("image_id").cast("int").alias("n_nationkey")).distinct().withColumn("text", F.concat(F.lit("##"), F.lower(F.lpad(F.hex("n_nationkey"), 2, "0")), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN '1020' ELSE 'zz20' END"))).withColumn("r", hex_color(F.col("text"))["r"]))
_C, _S = neighbor.rotation(30)
_ROT = f"(SELECT image_id, x, y, (2 * x - 63) * {_C} + (2 * y - 47) * {_S} + 63 * 65536 AS u, (2 * y - 47) * {_C} - (2 * x - 63) * {_S} + 47 * 65536 AS v FROM @)"
_ROT = f"(SELECT *, CAST(floor(u / 131072.0) AS INT) AS i, CAST(floor(v / 131072.0) AS INT) AS j FROM {_ROT})"
_ROT = f"(SELECT *, CAST((u - i::BIGINT * 131072) // 2 AS BIGINT) AS p, CAST((v - j::BIGINT * 131072) // 2 AS BIGINT) AS q FROM {_ROT})"
_TAPS = " UNION ALL ".join(f"SELECT image_id, x, y, i + {_a} AS tx, j + {_b} AS ty, {'p' if _a else '(65536 - p)'} * {'q' if _b else '(65536 - q)'} AS w FROM {_ROT}" for _a in (0, 1) for _b in (0, 1))
query("rotate_free", "SELECT t.image_id, t.x, t.y, " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE s.a IS NULL) > 0 THEN {bg} ELSE CAST((sum(t.w * s.{c}) + 2147483648) // 4294967296 AS INT) END AS {c}" for c, bg in zip(RGBA, (10, 20, 30, 255), strict=True)) + f" FROM ({_TAPS}) t LEFT JOIN @ s ON s.image_id = t.image_id AND s.x = t.tx AND s.y = t.ty WHERE t.w > 0 GROUP BY t.image_id, t.x, t.y", "photo")(lambda p: neighbor.rotate_free(p, 30, (10, 20, 30, 255)))


def _opened(images: DataFrame) -> DataFrame:
    """Files (path, content), the path being the image's id, to pixels."""
    return files.unpack(files.decode(images, strict=True).withColumn("image_id", F.col("path").cast("bigint")))


def _png(p: DataFrame) -> DataFrame:
    return files.encode(files.pack(p), "Png").select(F.col("image_id").cast("string").alias("path"), "content")


query("thumbnail_files", _resize_sql("SELECT * FROM @", (64, 48), (32, 24), "triangle"), "photo")(lambda p: _opened(jobs.thumbnails_of(_png(p), 32)))
query("blur_files", _blur_sql(_blur_sql("SELECT * FROM @", _W, "x", "y"), _W, "y", "x"), "photo")(lambda p: _opened(jobs.blurred_of(_png(p), 0.8)))


def _mixed(p: DataFrame) -> DataFrame:
    """Images of three widths."""
    return p.withColumn("width", (64 - 8 * (F.col("image_id") % 3)).cast("int")).where("x < width")


_NARROW = "SELECT * FROM @ WHERE image_id % 3 = {k} AND x < 64 - 8 * {k}"
query("thumbnail_mixed", " UNION ALL ".join(_resize_sql(_NARROW.format(k=k), (64 - 8 * k, 48), neighbor.thumbnail_size(64 - 8 * k, 48, 24), "lanczos3") for k in range(3)), "photo")(lambda p: neighbor.thumbnail(_mixed(p), 24))
query("fit_mixed", " UNION ALL ".join(f"SELECT image_id, x - {dx} AS x, y, r, g, b, a FROM ({_resize_sql(_NARROW.format(k=k), (64 - 8 * k, 48), size, 'lanczos3')}) WHERE x BETWEEN {dx} AND {dx} + 29" for k, size, dx in ((0, (40, 30), 5), (1, (35, 30), 2), (2, (30, 30), 0))), "photo")(lambda p: neighbor.fit(_mixed(p), 30, 30, "fill"))

#: Camera, orientation, date and exposure as an Exif segment (big-endian).
_TEXT = b"Make\0Model\0" + b"2024:05:06 07:08:09\0"


def _exif() -> bytes:
    entry = lambda tag, kind, count, value: struct.pack(">HHI", tag, kind, count) + value
    texts = 8 + 2 + 12 * 5 + 4
    inner = texts + len(_TEXT)
    first = struct.pack(">H", 5) + entry(0x010F, 2, 5, struct.pack(">I", texts)) + entry(0x0110, 2, 6, struct.pack(">I", texts + 5)) + entry(0x0112, 3, 1, struct.pack(">HH", 6, 0)) + entry(0x0132, 2, 20, struct.pack(">I", texts + 11)) + entry(0x8769, 4, 1, struct.pack(">I", inner)) + b"\0\0\0\0"
    second = struct.pack(">H", 1) + entry(0x829A, 5, 1, struct.pack(">I", inner + 18)) + b"\0\0\0\0" + struct.pack(">II", 1, 60)
    body = b"Exif\0\0MM\0*" + struct.pack(">I", 8) + first + _TEXT + second
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def _with_exif(p: DataFrame) -> DataFrame:
    jpegs = files.encode(files.pack(p), "Jpeg").select(F.col("image_id").cast("string").alias("path"), "content")
    return jpegs.select("path", F.concat(F.substring("content", 1, 2), F.lit(_exif()), F.substring("content", 3, 1 << 30)).alias("content"))


query("metadata_exif", "SELECT DISTINCT CAST(image_id AS VARCHAR) AS path, 64 AS width_px, 'Jpeg' AS format, 6 AS exif_orientation, '2024:05:06 07:08:09' AS exif_date_taken, 'Make Model' AS exif_camera, '1/60' AS exif_exposure FROM @", "photo")(lambda p: files.metadata(_with_exif(p)).select("path", F.col("width").alias("width_px"), "format", "exif_orientation", "exif_date_taken", "exif_camera", "exif_exposure"))


def _icons(p: DataFrame) -> DataFrame:
    """Each image and its corner as one icon, and its entries' pixels."""
    corner = geometry.crop(p, 0, 0, 16, 16).withColumns({"width": F.lit(16), "height": F.lit(16)})
    images = files.pack(p).unionByName(files.pack(corner)).withColumn("path", F.col("image_id").cast("string"))
    entries = files.ico_entries(files.encode_ico(images)).withColumn("image_id", F.col("path").cast("bigint") * 10 + F.col("entry_no"))
    return files.unpack(entries.where("error is null"))


query("ico_entries", "SELECT image_id * 10 AS image_id, x, y, r, g, b, a FROM @ UNION ALL SELECT image_id * 10 + 1, x, y, r, g, b, a FROM @ WHERE x < 16 AND y < 16", "photo")(_icons)


def _bits(*fields: tuple[int, int]) -> bytes:
    """(value, bits) pairs to bytes, filled up with zeros."""
    bits = "".join(f"{v:0{n}b}" for v, n in fields if n)
    return int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def _avif(tiles: list[bytes]) -> bytes:
    """A still of 512 x 512 with 2 x 2 tiles of these contents (under 128 bytes together), and no pixels behind them."""
    unit = lambda kind, body: bytes([kind << 3 | 2, len(body)]) + body
    sequence = _bits((0, 3), (1, 1), (1, 1), (4, 5), (15, 4), (15, 4), (511, 16), (511, 16), (0, 3), (0, 1), (1, 1), (1, 1), (0, 1), (0, 1), (0, 1), (1, 1), (0, 2), (0, 1), (0, 1), (1, 1))
    grid = ((1, 1), (1, 1), (0, 1), (1, 1), (0, 1), (0, 2), (0, 2))
    rest = ((100, 8), (0, 3), (0, 1), (0, 1), (0, 1), (0, 6), (0, 6), (0, 3), (0, 1), (0, 2), (0, 2), (0, 12), (0, 6), (1, 1), (0, 1))
    frame = _bits((0, 3), *grid, *rest) + b"\0" + b"".join(bytes([len(t) - 1]) + t for t in tiles[:-1]) + tiles[-1]
    stream = unit(6, frame)
    places = b"\1\0\0\0\x44\0" + struct.pack(">HHHHHII", 1, 1, 1, 0, 1, 0, len(stream))
    properties = _box(b"ipco", _box(b"ispe", struct.pack(">III", 0, 512, 512)) + _box(b"av1C", b"\x81\0\x0c\0" + unit(1, sequence)))
    properties += _box(b"ipma", struct.pack(">IIHBBB", 0, 1, 1, 2, 1, 2))
    meta = b"\0\0\0\0" + _box(b"pitm", struct.pack(">IH", 0, 1)) + _box(b"iloc", places) + _box(b"iprp", properties) + _box(b"idat", stream)
    return _box(b"ftyp", b"avif\0\0\0\0avif") + _box(b"meta", meta)


def _stills(p: DataFrame) -> DataFrame:
    """An AVIF file for each image, whose first tile has as many bytes as its number's rest by 7 and one."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["image_id"].astype(str), "content": [_avif([b"a" * (k % 7 + 1), b"bcd", b"ef", b"last!"]) for k in frame["image_id"]]})

    return p.select("image_id").distinct().mapInPandas(run, "path string, content binary")


query("av1_tiles", "SELECT CAST(image_id AS VARCHAR) AS path, k AS num, k // 2 AS tile_row, k % 2 AS tile_col, CASE k WHEN 0 THEN image_id % 7 + 1 ELSE [3, 2, 5][k] END AS size, k // 2 * 64 AS mi_row_start, k // 2 * 64 + 64 AS mi_row_end, k % 2 * 64 AS mi_col_start, k % 2 * 64 + 64 AS mi_col_end FROM (SELECT DISTINCT image_id FROM @), (VALUES (0), (1), (2), (3)) v(k)", "photo")(lambda p: files.av1_tiles(_stills(p)).where("error is null").select("path", "num", F.col("row").alias("tile_row"), F.col("col").alias("tile_col"), "size", "mi_row_start", "mi_row_end", "mi_col_start", "mi_col_end"))
query("metadata_avif", "SELECT DISTINCT CAST(image_id AS VARCHAR) AS path, 512 AS width_px, 512 AS height_px, 'Avif' AS format, 'AV1-32420' AS color_type FROM @", "photo")(lambda p: files.metadata(_stills(p)).where("error is null").select("path", F.col("width").alias("width_px"), F.col("height").alias("height_px"), "format", "color_type"))
