"""Codecs: round trips, hand-built files, damaged files, and files that the JVM's ImageIO writes."""

import struct
import zlib

import numpy as np
import pytest

from pixelweave.codecs import CodecError, avif, bmp, gif, ico, jpeg, png, webp
from pixelweave.sources import files

SIZES = ((1, 1), (7, 1), (5, 3), (16, 16), (41, 63))


def noise(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)


def ramp(h=48, w=64):
    y, x = np.mgrid[:h, :w]
    return np.stack([255 * x // max(1, w - 1), 255 * y // max(1, h - 1), 255 * (x + y) // max(1, w + h - 2), 255 + 0 * x], axis=2).astype(np.uint8)


@pytest.mark.parametrize("codec", [png, bmp, ico, webp])
@pytest.mark.parametrize("size", SIZES)
def test_lossless_round_trip(codec, size):
    pixels = noise(*size)
    data = codec.encode(pixels)
    assert (codec.decode(data) == pixels).all() and codec.dimensions(data) == size[::-1]


def test_gif():
    few = noise(20, 30)
    few[..., :3] //= 64
    few[..., 3] = np.where(few[..., 3] > 127, 255, 0)
    got = gif.decode(gif.encode(few))
    assert (got[..., 3] == few[..., 3]).all() and (got[few[..., 3] > 0] == few[few[..., 3] > 0]).all()
    many = ramp()
    got = gif.decode(gif.encode(many))
    assert len(np.unique(got.reshape(-1, 4), axis=0)) <= 256 and np.abs(got.astype(int) - many).mean() < 8
    assert (gif.decode(gif.encode(np.zeros((8, 8, 4), np.uint8)))[..., 3] == 0).all()


#: Published bounds of the largest difference by (height, width), at quality 95.
JPEG_BOUNDS = {(48, 64): 12, (23, 37): 12, (5, 7): 45, (1, 1): 0, (9, 16): 20}


@pytest.mark.parametrize("size", JPEG_BOUNDS)
def test_jpeg_bounds(size):
    pixels = ramp(*size)
    for sampling in ("444", "420"):
        got = jpeg.decode(jpeg.encode(pixels, 95, sampling))
        assert got.shape == pixels.shape and np.abs(got.astype(int) - pixels)[..., :3].max() <= JPEG_BOUNDS[size]


def test_jpeg_quality_series():
    worst = [np.abs(jpeg.decode(jpeg.encode(ramp(), q)).astype(int) - ramp())[..., :3].max() for q in (95, 75, 20)]
    assert worst[0] <= 12 and worst[2] >= 5
    with pytest.raises(CodecError):
        jpeg.encode(ramp(), 0)


def _png(color, depth, w, h, raw, extra=b"", interlace=0):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, interlace)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_variants():
    assert png.decode(_png(0, 1, 3, 1, b"\0\xa0"))[0, :, 0].tolist() == [255, 0, 255]
    assert png.decode(_png(0, 4, 2, 1, b"\0\x1f"))[0, :, 0].tolist() == [17, 255]
    assert png.decode(_png(0, 16, 1, 1, b"\0\x80\x00"))[0, 0, 0] == 128
    assert png.decode(_png(2, 8, 2, 2, b"\1\x01\x02\x03\x01\x01\x01\x02\x01\x01\x01\x01\x01\x01"))[1, 1, :3].tolist() == [3, 4, 5]
    assert png.decode(_png(4, 8, 1, 2, b"\x03\x09\x08\x04\x01\x01"))[:, 0].tolist() == [[9, 9, 9, 8], [10, 10, 10, 9]]
    big = noise(9, 9)
    raw = b""
    for x, y, dx, dy in png.PASSES:
        for row in big[y::dy, x::dx]:
            raw += b"\0" + row.tobytes() if row.size else b""
    assert (png.decode(_png(6, 8, 9, 9, raw, interlace=1)) == big).all()


def test_bmp_hand_built():
    head = lambda w, h, bits, packing, table=b"": b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(table)) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, packing, 0, 0, 0, len(table) // 4, 0) + table
    two = bytes([0, 0, 255, 0, 0, 255, 0, 0])
    assert bmp.decode(head(2, 1, 1, 0, two) + b"\x40\0\0\0")[0, :, :3].tolist() == [[255, 0, 0], [0, 255, 0]]
    assert bmp.decode(head(4, 1, 8, 1, two) + b"\x03\x01\x01\x00\x00\x01")[0, :, 1].tolist() == [255, 255, 255, 0]
    assert bmp.decode(head(1, -1, 16, 0) + b"\x1f\x7c\0\0")[0, 0].tolist() == [255, 0, 255, 255]
    with pytest.raises(CodecError):
        bmp.decode(head(2, 1, 8, 1, two) + b"\x05\x01")


def test_ico_entries():
    data = ico.encode_images([noise(8, 8), noise(16, 16, 1)])
    assert [e.pixels.shape[0] for e in ico.decode_all(data)] == [16, 8] and ico.dimensions(data) == (16, 16)
    with pytest.raises(CodecError) as error:
        ico.encode(np.zeros((300, 10, 4), np.uint8))
    assert error.value.kind == "invalid_input"


def test_avif_probe():
    box = lambda k, b: struct.pack(">I", len(b) + 8) + k + b
    props = box(b"ipco", box(b"ispe", struct.pack(">III", 0, 96, 64)) + box(b"av1C", b"\x81\x00\x4c\x00") + box(b"pixi", b"\0\0\0\0\x03\x0a\x0a\x0a"))
    meta = box(b"meta", b"\0\0\0\0" + box(b"pitm", b"\0\0\0\0\0\1") + box(b"iprp", props + box(b"ipma", b"\0\0\0\0" + struct.pack(">IHB", 1, 1, 3) + b"\1\2\3")))
    data = box(b"ftyp", b"avif\0\0\0\0avif") + meta
    assert avif.is_avif(data) and avif.dimensions(data) == (96, 64)
    assert avif.probe(data)["chroma"] == "420" and avif.probe(data)["depths"] == [10, 10, 10]
    with pytest.raises(CodecError) as error:
        avif.decode(data)
    assert error.value.kind == "unsupported"


def test_errors_are_rows(spark, tmp_path):
    good = png.encode(noise(3, 4))
    cases = {"a.png": good, "b.png": good[:-20], "c.gif": b"GIF89a", "d.txt": b"nothing", "e.jpg": b"\xff\xd8\xff\xc2\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.load(spark, str(tmp_path)).collect()}
    assert rows["a.png"].error is None and (rows["a.png"].width, rows["a.png"].height) == (4, 3)
    assert {k: rows[k].error.kind for k in cases if k != "a.png"} == {"b.png": "decode", "c.gif": "decode", "d.txt": "unsupported", "e.jpg": "unsupported"}
    assert rows["d.txt"].format == "Png" and rows["c.gif"].sniffed_format is None
    empty = files.decode(spark.createDataFrame([("f.png", b"")], "path string, content binary")).first()  # the file source skips empty files
    assert empty.error.kind == "unsupported"
    with pytest.raises(Exception, match="early|ends"):
        files.decode(files.scan(spark, str(tmp_path / "b.png")), strict=True).collect()


def _imageio(spark, pixels, kind):
    jvm = spark.sparkContext._jvm
    h, w, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in pixels[y, x, :3])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


@pytest.mark.parametrize("kind,codec,most", [("png", png, 0), ("bmp", bmp, 0), ("jpg", jpeg, 25)])
def test_reads_what_imageio_writes(spark, kind, codec, most):
    pixels = ramp(16, 24)
    got = codec.decode(_imageio(spark, pixels, kind))
    assert np.abs(got.astype(int) - pixels)[..., :3].max() <= most


@pytest.mark.parametrize("kind,codec,most", [("png", png, 0), ("bmp", bmp, 0), ("jpg", jpeg, 25)])
def test_imageio_reads_ours(spark, kind, codec, most):
    pixels = ramp(16, 24)
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(codec.encode(pixels))))
    got = np.array([[[(v := image.getRGB(x, y)) >> 16 & 255, v >> 8 & 255, v & 255] for x in range(24)] for y in range(16)])
    assert np.abs(got - pixels[..., :3]).max() <= most
