"""Folders of files: load, save, batch jobs and streams, with files that can't be read among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave import jobs
from pixelweave.codecs import bmp, jpeg, png
from pixelweave.operators import arrays, neighbor
from pixelweave.sources import derived, files
from pixelweave.streaming import ingest


def image(width, height, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (height, width, 4)).astype(np.uint8)


@pytest.fixture
def folder(tmp_path):
    made = {"a.png": image(40, 30), "b.bmp": image(7, 5, 1), "c.png": image(13, 64, 2), "wrong.jpg": image(9, 9, 3)}
    top = tmp_path / "files"
    top.mkdir()
    for name, pixels in made.items():
        (top / name).write_bytes((bmp if name.endswith("bmp") else png).encode(pixels))
    (top / "d.jpeg").write_bytes(jpeg.encode(image(16, 8, 4)))
    (top / "cut.png").write_bytes(png.encode(image(20, 20))[:60])
    (top / "text.gif").write_bytes(b"this is no image at all")
    return str(top), made


def name(path):
    return path.rsplit("/", 1)[1]


def test_load_and_save(spark, folder, tmp_path):
    path, made = folder
    rows = {name(r.path): r for r in files.load(spark, path + "/*").collect()}
    assert {k for k, r in rows.items() if r.error} == {"cut.png", "text.gif"} and len(rows) == 7
    for k, pixels in made.items():
        assert (rows[k].width, rows[k].height) == pixels.shape[1::-1]
        assert np.frombuffer(rows[k].pixels, np.uint8).reshape(pixels.shape)[..., :3].tolist() == pixels[..., :3].tolist()
    assert (rows["wrong.jpg"].format, rows["wrong.jpg"].sniffed_format) == ("Jpeg", "Png")
    assert {name(r.path) for r in files.load(spark, path + "/*", forced="Bmp").where("error is null").collect()} == {"b.bmp"}
    good = files.load(spark, path + "/*").where("error is null").select("path", "width", "height", "pixels")
    files.save(good, str(tmp_path / "saved"), "Png")
    again = files.decode(spark.read.parquet(str(tmp_path / "saved")), strict=True)
    assert sorted(map(tuple, again.select("path", "pixels").collect())) == sorted(map(tuple, good.select("path", "pixels").collect()))
    got = {name(r.path): (r.width, r.height) for r in jobs.dimensions(spark, path + "/*").collect()}
    assert got["d.jpeg"] == (16, 8) and got["text.gif"] == (None, None)


def test_thumbnails_and_blur(spark, folder, tmp_path):
    path, made = folder
    rows = {name(r.path): r for r in jobs.thumbnails(spark, path + "/*", 16).collect()}
    assert {k for k, r in rows.items() if r.error} == {"cut.png", "text.gif"}
    assert (rows["a.png"].width, rows["a.png"].height) == (16, 12) and (rows["c.png"].width, rows["c.png"].height) == (3, 16)
    assert png.decode(rows["b.bmp"].content)[..., :3].tolist() == made["b.bmp"][..., :3].tolist()
    with pytest.raises(ValueError):
        jobs.thumbnails(spark, path, 0)
    out = str(tmp_path / "blurred")
    status = {name(r.path): r.error for r in jobs.blur_to_table(spark, path + "/*", out, 1.5).collect()}
    assert {k for k, e in status.items() if e} == {"cut.png", "text.gif"}
    kept = {name(r.path): png.decode(r.content) for r in spark.read.parquet(out).where("error is null").collect()}
    assert (kept["a.png"] == arrays.gaussian_blur(made["a.png"], 1.5)).all()


@pytest.mark.parametrize("kernel", ["nearest", *neighbor.KERNELS])
def test_arrays_are_as_relations(spark, kernel):
    pixels = image(11, 17, 5)
    images = spark.createDataFrame([(1, 11, 17, pixels.tobytes())], "image_id bigint, width int, height int, pixels binary")
    relation = files.unpack(images).withColumns({"width": F.lit(11), "height": F.lit(17)})
    out = files.pack(neighbor.resize(relation, 23, 5, kernel)).first()
    assert (out.width, out.height) == (23, 5) and bytes(out.pixels) == arrays.resize(pixels, 23, 5, kernel).tobytes()
    if kernel == "nearest":
        assert bytes(files.pack(neighbor.gaussian_blur(relation, 9.0)).first().pixels) == arrays.gaussian_blur(pixels, 9.0).tobytes()


def test_pack_and_unpack(spark):
    rows = [(1, 0, 0, 1, 2, 3, 4), (1, 2, 1, 5, 6, 7, 8), (2, 0, 0, 9, 9, 9, 9)]
    pixels = spark.createDataFrame(rows, "image_id bigint, x int, y int, r int, g int, b int, a int")
    got = {r.image_id: (r.width, r.height, bytes(r.pixels)) for r in files.pack(pixels).collect()}
    assert got[1] == (3, 2, bytes([1, 2, 3, 4]) + bytes(16) + bytes([5, 6, 7, 8])) and got[2] == (1, 1, bytes([9] * 4))
    wide = {r.image_id: (r.width, r.height, len(r.pixels)) for r in files.pack(derived.fixed_dims(pixels, 4, 3)).collect()}
    assert wide == {1: (4, 3, 48), 2: (4, 3, 48)}
    for raw, w, h in ((bytes(15), 2, 2), (bytes(20), 2, 2), (None, 1, 1), (b"", 0, 0)):
        broken = spark.createDataFrame([(1, w, h, raw)], "image_id bigint, width int, height int, pixels binary")
        with pytest.raises(Exception, match="bytes of pixels"):
            files.unpack(broken).count()


def test_stream(spark, folder, tmp_path):
    path, made = folder
    query = ingest.image_stream(spark, path, files_per_trigger=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 7 and sum(r.error is None for r in rows) == 5
