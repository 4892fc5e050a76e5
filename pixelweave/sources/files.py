"""Image files as DataFrames: one row per file, decoded in Arrow batches; errors are a column, not a failed job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import CodecError, avif, bmp, gif, ico, jpeg, png, vp8, webp

FORMATS = {"Png": png, "Jpeg": jpeg, "Gif": gif, "Bmp": bmp, "Ico": ico, "WebP": webp, "Avif": avif}
#: File name endings by format.
ENDINGS = {"png": "Png", "jpg": "Jpeg", "jpeg": "Jpeg", "gif": "Gif", "bmp": "Bmp", "webp": "WebP", "ico": "Ico", "avif": "Avif", "avis": "Avif"}
IMAGES = "path string, width int, height int, format string, color_type string, pixels binary, error struct<kind:string,message:string>"
METADATA = "path string, width int, height int, format string, color_type string, exif_orientation int, exif_date_taken string, exif_camera string, exif_exposure string, error struct<kind:string,message:string>"
TILES = "num int, row int, col int, size bigint, offset bigint, mi_row_start int, mi_row_end int, mi_col_start int, mi_col_end int"
#: Bytes of pixels that a batch holds before it is passed on.
HELD = 4 << 20
SNIFF = (("Png", png.is_png), ("Jpeg", jpeg.is_jpeg), ("Gif", gif.is_gif), ("Bmp", bmp.is_bmp), ("Ico", ico.is_ico), ("WebP", webp.is_webp), ("Avif", avif.is_avif))


def sniff(data: bytes) -> str | None:
    return next((name for name, test in SNIFF if test(data)), None)


def from_extension(path: Column) -> Column:
    """Null for unknown endings."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ENDINGS.items() for x in kv)), ending)


def from_magic(content: Column) -> Column:
    """Format by the first bytes, as an expression; icons first, then anything under 12 bytes can only be BMP."""
    head = F.hex(F.substring(content, 1, 64))
    at = lambda start, text: F.substring(head, 2 * start + 1, len(text)) == text
    brand = F.lit(False)
    for i in (8, *range(16, 61, 4)):
        brand = brand | at(i, b"avif".hex().upper()) | at(i, b"avis".hex().upper())
    long = F.length(content) >= 12
    return (
        F.when(at(0, "00000100"), "Ico").when(at(0, "424D"), "Bmp").when(~long, None).when(at(0, "89504E47"), "Png").when(at(0, "FFD8FF"), "Jpeg")
        .when(at(0, b"GIF87a".hex().upper()) | at(0, b"GIF89a".hex().upper()), "Gif").when(at(0, b"RIFF".hex().upper()) & at(8, b"WEBP".hex().upper()), "WebP")
        .when(at(4, b"ftyp".hex().upper()) & brand, "Avif")
    )


def probe_format(files: DataFrame) -> DataFrame:
    """path and format: the first bytes win over the ending; null if neither tells."""
    return files.select("path", F.coalesce(from_magic(F.col("content")), from_extension(F.col("path"))).alias("format"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def av1_tiles(files: DataFrame) -> DataFrame:
    """One row for each tile of an AVIF's primary image; a file that can't be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", *(c.split()[0] for c in TILES.split(", ")), "error"]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [{"path": path, "error": None, **tile} for tile in avif.tile_layout(content or b"")]
                except CodecError as error:
                    rows.append({"path": path, "error": {"kind": error.kind, "message": str(error)}})
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int64" for c in columns[1:-1]})

    return files.select("path", "content").mapInPandas(run, f"path string, {TILES}, error struct<kind:string,message:string>")


def decode_one(path, data: bytes, forced: str | None = None, tables: vp8.Tables | None = None) -> dict:
    out = {"path": path, "width": None, "height": None, "format": None, "color_type": None, "pixels": None, "error": None}
    try:
        if (name := forced or sniff(data)) is None:
            raise CodecError("unsupported", "unknown image format")
        pixels = webp.decode(data, tables) if name == "WebP" else FORMATS[name].decode(data)
        return out | {"height": pixels.shape[0], "width": pixels.shape[1], "format": name, "color_type": "RGBA8", "pixels": pixels.tobytes()}
    except CodecError as error:
        return out | {"error": {"kind": error.kind, "message": str(error)}}
    except (IndexError, ValueError, OverflowError, MemoryError) as error:  # damaged in a way that no check names
        return out | {"error": {"kind": "decode", "message": f"{type(error).__name__}: {error}"}}


def decode(files: DataFrame, forced: str | None = None, strict: bool = False, vp8_listings: str | None = None) -> DataFrame:
    """(path, content) to images. strict: the first bad file fails the query. vp8_listings: the text of the listings that lossy WebP
    needs (``codecs.vp8``); without them such files have an error."""
    tables = vp8.Tables.read(vp8_listings) if vp8_listings is not None else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in IMAGES.split(", ")[:6]] + ["error"]
        for frame in frames:
            rows, held = [], 0
            for path, data in zip(frame["path"], frame["content"], strict=True):
                row = decode_one(path, bytes(data or b""), forced, tables)
                if strict and row["error"]:
                    raise ValueError(f"{path}: {row['error']['message']}")
                rows.append(row)
                held += len(row["pixels"] or b"")
                if held >= HELD:  # small images together, large ones one at a time
                    yield pd.DataFrame(rows, columns=names).astype({"width": "Int32", "height": "Int32"})
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, IMAGES)


def load(spark: SparkSession, path: str, forced: str | None = None, vp8_listings: str | None = None) -> DataFrame:
    """Decoded files; the format column follows the ending (unknown: Png), sniffed_format the bytes."""
    images = decode(scan(spark, path), forced, vp8_listings=vp8_listings)
    return images.withColumn("sniffed_format", F.col("format")).withColumn("format", F.coalesce(from_extension(F.col("path")), F.lit("Png")))


def metadata(files: DataFrame) -> DataFrame:
    """From the headers alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in METADATA.split(", ")]
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                row, data = dict.fromkeys(names) | {"path": path}, bytes(data or b"")
                try:
                    if (name := sniff(data)) is None:
                        raise CodecError("unsupported", "unknown image format")
                    row["width"], row["height"] = FORMATS[name].dimensions(data)
                    row |= {"format": name, "color_type": "RGBA8"}
                    if name == "Jpeg":
                        row |= {f"exif_{k}": v for k, v in jpeg.exif(data).items()}
                    elif name == "Avif":
                        info = avif.probe(data)
                        row["color_type"] = f"AV1-{(info['depths'] or [8])[0] * 4:02}{info['chroma'] or ''}"
                except CodecError as error:
                    row["error"] = {"kind": error.kind, "message": str(error)}
                rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("width", "height", "exif_orientation")})

    return files.select("path", "content").mapInPandas(run, METADATA)


def encode(images: DataFrame, name: str, quality: int = 75) -> DataFrame:
    """(image columns with width, height, pixels) with content in the format; pixels go."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must be 1 to 100")
    if name not in FORMATS or name == "Avif":
        raise ValueError(f"{name} can't be written")
    codec, keep = FORMATS[name], [f for f in images.schema.fields if f.name not in ("pixels", "content")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = []
            for w, h, raw in zip(frame["width"], frame["height"], frame["pixels"], strict=True):
                pixels = np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 4)
                content.append(codec.encode(pixels, quality) if name == "Jpeg" else codec.encode(pixels))
            yield frame[[f.name for f in keep]].assign(content=content)

    return images.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "content binary"]))


def ico_entries(contents: DataFrame) -> DataFrame:
    """(path, content) of icons to a row for each entry, the largest first: path, entry_no, width, height, bpp, pixels; error where a
    file can't be read."""
    schema = "path string, entry_no int, width int, height int, bpp int, pixels binary, error struct<kind:string,message:string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")[:6]] + ["error"]
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, i, e.pixels.shape[1], e.pixels.shape[0], e.bpp, e.pixels.tobytes(), None) for i, e in enumerate(ico.decode_all(bytes(data or b"")))]
                except CodecError as error:
                    rows = [(path, None, None, None, None, None, {"kind": error.kind, "message": str(error)})]
                yield pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in columns[1:5]})

    return contents.select("path", "content").mapInPandas(run, schema)


def encode_ico(images: DataFrame) -> DataFrame:
    """Images with a path to one icon for each path, of all its images, the largest first (at most 256 pixels a side): path, content."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 4) for w, h, raw in zip(frame["width"], frame["height"], frame["pixels"], strict=True)]
        own.sort(key=lambda p: (-p.shape[0] * p.shape[1], p.tobytes()))
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [ico.encode_images(own)]})

    return images.select("path", "width", "height", "pixels").groupBy("path").applyInPandas(run, "path string, content binary")


def save(images: DataFrame, path: str, name: str, quality: int = 75) -> None:
    """Encoded images as a Parquet table of (columns, content): a sink that retries and lost executors can't tear."""
    encode(images, name, quality).write.mode("overwrite").parquet(path)


def pack(pixels: DataFrame) -> DataFrame:
    """Pixels to one row per image: image_id, width, height, format, pixels. The size is that of the columns width and height, or
    without these reaches to the largest pixel; pixels that are missing are transparent black. Lines are put together first, so that
    an image is a row a line before it is one row; images are shuffled once."""
    sized = {"width", "height"} <= set(pixels.columns)
    spread = pixels.repartition("image_id")
    at = F.struct(F.col("x").alias("at"), F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgba")).alias("v"))
    size = [F.max("width").alias("width"), F.max("height").alias("height")] if sized else [(F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")]
    whole = spread.groupBy("image_id").agg(*size)
    lines = spread.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(at)).alias("line"))
    lines = lines.join(whole, "image_id").select("image_id", "width", "height", F.struct(F.col("y").alias("at"), _joined("line", F.col("width"), "00000000").alias("v")).alias("line"))
    images = lines.groupBy("image_id", "width", "height").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    hexed = _joined("lines", F.col("height"), F.repeat(F.lit("00000000"), F.col("width")))
    return images.select("image_id", "width", "height", F.lit(None).cast("string").alias("format"), F.unhex(hexed).alias("pixels"))


def _joined(parts: str, n: Column, empty: str | Column) -> Column:
    """The values of sorted (at, v) parts joined; of the n places, those without a part are empty."""
    empty = F.lit(empty) if isinstance(empty, str) else empty
    own = F.col(parts)
    places = F.map_from_entries(own)
    filled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(places, i), empty))
    return F.array_join(F.when(F.size(own) == n, F.transform(own, lambda p: p["v"])).otherwise(filled), "")


def unpack(images: DataFrame) -> DataFrame:
    """image_id, width, height, pixels to pixel rows. An image whose pixels aren't 4 bytes for each of width x height fails the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, w, h, raw in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                raw = raw.as_buffer()
                if not w or not h or w < 0 or raw is None or raw.size != 4 * w * h:
                    raise ValueError(f"image {i}: {raw.size if raw else 0} bytes of pixels, {w} x {h} have {4 * (w or 0) * (h or 0)}")
                rows.append((i, w, np.frombuffer(raw, np.uint8).reshape(-1, 4)))
                held += raw.size
                if held >= HELD:
                    yield _pixel_rows(rows)
                    rows, held = [], 0
            if rows:
                yield _pixel_rows(rows)

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, "image_id bigint, x int, y int, r int, g int, b int, a int")


def _pixel_rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(p) for _, _, p in rows]
    n = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
    width = np.repeat(np.array([w for _, w, _ in rows], np.int32), sizes)
    values = np.concatenate([p for _, _, p in rows]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _, _ in rows], np.int64), sizes)), pa.array(n % width), pa.array(n // width), *(pa.array(values[:, k]) for k in range(4))], names=["image_id", "x", "y", *"rgba"])
