"""Lossy WebP: frames written by hand are read back, and each step is held against a plain version."""

import struct

import numpy as np
import pytest
import vp8_writer as writer

from pixelweave.codecs import CodecError, vp8, vp8l, webp
from pixelweave.sources import files

FIELDS = ("simple", "level", "sharpness", "use_segments", "absolute", "segment_quantizers", "segment_levels", "segment_probabilities", "use_deltas", "reference_deltas", "mode_deltas", "quantizer", "quantizer_deltas")


def riff(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("seed", range(8))
def test_syntax(seed):
    rng, t = np.random.default_rng(seed), writer.tables(seed)
    more = {"quantizer": int(rng.integers(0, 128)), "quantizer_deltas": rng.integers(-15, 16, 5).tolist(), "level": int(rng.integers(0, 64)), "sharpness": int(rng.integers(0, 8)), "simple": bool(seed & 1)}
    if seed & 2:
        more |= {"use_segments": True, "absolute": bool(seed & 4), "segment_quantizers": rng.integers(-60, 60, 4).tolist(), "segment_levels": rng.integers(0, 40, 4).tolist(), "segment_probabilities": [10, 255, 200]}
    if seed & 4:
        more |= {"use_deltas": True, "reference_deltas": [3, 0, -7, 1], "mode_deltas": [-4, 0, 9, 0]}
    f = writer.frame(int(rng.integers(1, 70)), int(rng.integers(1, 60)), rng, **more)
    data = writer.write(f, t, parts=1 << seed % 4, changed={(1, 2, 0, 3): 77, (3, 7, 2, 10): 1}, skips=seed != 5)
    got = vp8.parse(data, vp8.Tables.read(writer.listings(t)))
    for k in FIELDS:
        assert getattr(got, k) == getattr(f, k), k
    for k in ("segment", "mode", "chroma_mode", "blocks", "values"):
        assert (getattr(got, k) == getattr(f, k)).all(), k
    assert (got.plain == ~f.values.any(axis=(2, 3))).all()
    assert vp8.decode(data, t).shape == (f.height, f.width, 4)


def two(a, b):
    return (a + b + 1) >> 1


def three(a, b, c):
    return (a + 2 * b + c + 2) >> 2


def test_block_modes():
    """Each mode as a walk from the pixel along its direction to the edge."""
    rng = np.random.default_rng(3)
    e = rng.integers(0, 256, 13)
    A = lambda i: int(e[5 + i])  # noqa: E731, N806
    L = lambda i: int(e[3 - min(i, 3)])  # noqa: E731, N806
    E = lambda i: int(e[i])  # noqa: E731, N806
    got = {m: vp8.predict_block(m, e) for m in range(10)}
    for r in range(4):
        for c in range(4):
            assert got[vp8.B_DC][r, c] == (sum(A(i) + L(i) for i in range(4)) + 4) >> 3
            assert got[vp8.B_TM][r, c] == min(255, max(0, L(r) + A(c) - E(4)))
            assert got[vp8.B_VE][r, c] == three(A(c - 1), A(c), A(c + 1))
            assert got[vp8.B_HE][r, c] == three(E(4) if r == 0 else L(r - 1), L(r), L(r + 1))
            assert got[vp8.B_LD][r, c] == three(A(r + c), A(r + c + 1), A(min(7, r + c + 2)))
            assert got[vp8.B_RD][r, c] == three(E(3 - r + c), E(4 - r + c), E(5 - r + c))
    vr = {(3, 0): three(E(1), E(2), E(3)), (2, 0): three(E(2), E(3), E(4)), (3, 1): three(E(3), E(4), E(5)), (2, 1): two(E(4), E(5)), (3, 2): three(E(4), E(5), E(6)), (2, 2): two(E(5), E(6)), (3, 3): three(E(5), E(6), E(7)), (2, 3): two(E(6), E(7)), (1, 3): three(E(6), E(7), E(8)), (0, 3): two(E(7), E(8))}
    vr |= {(1, 0): vr[3, 1], (0, 0): vr[2, 1], (1, 1): vr[3, 2], (0, 1): vr[2, 2], (1, 2): vr[3, 3], (0, 2): vr[2, 3]}
    vl = {(0, 0): two(A(0), A(1)), (1, 0): three(A(0), A(1), A(2)), (2, 0): two(A(1), A(2)), (1, 1): three(A(1), A(2), A(3)), (2, 1): two(A(2), A(3)), (3, 1): three(A(2), A(3), A(4)), (2, 2): two(A(3), A(4)), (3, 2): three(A(3), A(4), A(5)), (2, 3): three(A(4), A(5), A(6)), (3, 3): three(A(5), A(6), A(7))}
    vl |= {(0, 1): vl[2, 0], (3, 0): vl[1, 1], (0, 2): vl[2, 1], (1, 2): vl[3, 1], (0, 3): vl[2, 2], (1, 3): vl[3, 2]}
    hd = {(3, 0): two(E(0), E(1)), (3, 1): three(E(0), E(1), E(2)), (2, 0): two(E(1), E(2)), (2, 1): three(E(1), E(2), E(3)), (1, 0): two(E(2), E(3)), (1, 1): three(E(2), E(3), E(4)), (0, 0): two(E(3), E(4)), (0, 1): three(E(3), E(4), E(5)), (0, 2): three(E(4), E(5), E(6)), (0, 3): three(E(5), E(6), E(7))}
    hd |= {(3, 2): hd[2, 0], (3, 3): hd[2, 1], (2, 2): hd[1, 0], (2, 3): hd[1, 1], (1, 2): hd[0, 0], (1, 3): hd[0, 1]}
    hu = {(0, 0): two(L(0), L(1)), (0, 1): three(L(0), L(1), L(2)), (0, 2): two(L(1), L(2)), (0, 3): three(L(1), L(2), L(3)), (1, 2): two(L(2), L(3)), (1, 3): three(L(2), L(3), L(3))}
    hu |= {(1, 0): hu[0, 2], (1, 1): hu[0, 3], (2, 0): hu[1, 2], (2, 1): hu[1, 3]} | {k: L(3) for k in ((2, 2), (2, 3), (3, 0), (3, 1), (3, 2), (3, 3))}
    for mode, plain in ((vp8.B_VR, vr), (vp8.B_VL, vl), (vp8.B_HD, hd), (vp8.B_HU, hu)):
        assert len(plain) == 16 and {k: int(got[mode][k]) for k in plain} == plain


def test_transforms():
    rng = np.random.default_rng(4)
    n = np.arange(4)
    basis = np.where(n[:, None] == 0, 0.5, np.sqrt(0.5) * np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 8))
    for _ in range(50):
        values = rng.integers(-400, 400, (4, 4))
        assert np.abs(vp8.cosine(values) - basis.T @ values @ basis / 2).max() <= 1.5
    signs = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]])
    values = rng.integers(-400, 400, (3, 4, 4))
    assert (vp8.walsh(values) == (np.einsum("ui,nuv,vj->nij", signs, values, signs) + 3) >> 3).all()


def scalar(line, edge, inner, sharp, outer, simple):
    """The filter on one line, number by number."""
    c = lambda v: max(-128, min(127, v))
    p3, p2, p1, p0, q0, q1, q2, q3 = (int(v) - 128 for v in line)
    if abs(p0 - q0) * 2 + abs(p1 - q1) // 2 > edge:
        return list(line)
    if not simple and max(abs(p3 - p2), abs(p2 - p1), abs(p1 - p0), abs(q1 - q0), abs(q2 - q1), abs(q3 - q2)) > inner:
        return list(line)
    rough = abs(p1 - p0) > sharp or abs(q1 - q0) > sharp
    if outer and not simple and not rough:
        w = c(c(p1 - q1) + 3 * (q0 - p0))
        a, b, d = (c((k * w + 63) >> 7) for k in (27, 18, 9))
        p0, q0, p1, q1, p2, q2 = c(p0 + a), c(q0 - a), c(p1 + b), c(q1 - b), c(p2 + d), c(q2 - d)
    else:
        a = c((c(p1 - q1) if simple or rough else 0) + 3 * (q0 - p0))
        f = c(a + 4) >> 3
        p0, q0 = c(p0 + (c(a + 3) >> 3)), c(q0 - f)
        if not simple and not rough:
            f = (f + 1) >> 1
            p1, q1 = c(p1 + f), c(q1 - f)
    return [v + 128 for v in (p3, p2, p1, p0, q0, q1, q2, q3)]


@pytest.mark.parametrize("simple", [True, False])
@pytest.mark.parametrize("outer", [True, False])
def test_filter(simple, outer):
    rng = np.random.default_rng(5)
    for spread in (3, 10, 40, 255):
        lines = np.clip(rng.integers(0, 256, (1, 400)) + rng.integers(-spread, spread + 1, (8, 400)), 0, 255)
        edge, inner, sharp = (int(v) for v in (rng.integers(10, 140), rng.integers(1, 40), rng.integers(0, 3)))
        expected = [scalar(x, edge, inner, sharp, outer, simple) for x in lines.T]
        vp8.filter_edge(lines, edge, inner, sharp, outer, simple)
        assert lines.T.tolist() == expected


def encoded(rgb, t, quantizer, level=0, modes=None):
    """A frame of an image: each block's residual from the decoder's own prediction, transformed and quantized."""
    height, width, _ = rgb.shape
    r, g, b = (np.pad(rgb[..., k].astype(float), ((0, -height % 16), (0, -width % 16)), mode="edge") for k in range(3))
    halve = lambda x: x.reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2).mean(axis=(1, 3))
    planes = [16 + 0.257 * r + 0.504 * g + 0.098 * b, halve(128 - 0.148 * r - 0.291 * g + 0.439 * b), halve(128 + 0.439 * r - 0.368 * g - 0.071 * b)]
    f = writer.frame(width, height, np.random.default_rng(1), quantizer=quantizer, level=level)
    f.values[:] = 0
    if modes is not None:
        f.mode[:], f.chroma_mode[:] = modes
        f.blocks[:] = vp8.AS_BLOCK[modes[0]]
    n = np.arange(4)
    basis = np.where(n[:, None] == 0, 0.5, np.sqrt(0.5) * np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 8))
    scales = vp8._scales(f)[0]
    forward = lambda x: 2 * basis @ x @ basis.T
    for my in range(f.down):
        for mx in range(f.across):
            for k, side in enumerate((16, 8, 8)):
                own = planes[k][my * side : my * side + side, mx * side : mx * side + side]
                first = (0, 16, 20)[k]
                if k == 0 and f.mode[my, mx] == vp8.B:
                    for i in range(16):  # one block after the other, each from what is decoded so far
                        done = vp8.reconstruct(f)[0][1:, 1:][my * 16 :, mx * 16 :][:16, :16]
                        y, x = 4 * (i // 4), 4 * (i % 4)
                        f.values[my, mx, i] = np.round(forward(own[y : y + 4, x : x + 4] - done[y : y + 4, x : x + 4]).ravel() / scales[i])
                    continue
                done = vp8.reconstruct(f)[k][1:, 1:][my * side :, mx * side :][:side, :side]
                parts = [forward((own - done)[y : y + 4, x : x + 4]).ravel() for y in range(0, side, 4) for x in range(0, side, 4)]
                if k == 0:
                    signs = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]])
                    dc = np.array([p[0] for p in parts]).reshape(4, 4)
                    f.values[my, mx, 24] = np.round((signs @ dc @ signs.T / 2).ravel() / scales[24])
                    for p in parts:
                        p[0] = 0
                for i, p in enumerate(parts):
                    f.values[my, mx, first + i] = np.round(p / scales[first + i])
    return writer.write(f, t)


def photo(width, height):
    y, x = np.mgrid[:height, :width]
    return np.stack([255 * x // max(1, width - 1), 255 * y // max(1, height - 1), 255 * (x + y) // max(1, width + height - 2)], axis=2).astype(np.uint8)


@pytest.mark.parametrize(("size", "modes", "level"), [((64, 48), None, 0), ((64, 48), (vp8.TM, vp8.TM), 8), ((37, 23), None, 4)])
def test_image_bounds(size, modes, level):
    """The published bounds of lossy images: 32 at most, 4.0 on average, at a middle quality."""
    t, rgb = writer.tables(9), photo(*size)
    data = riff((b"VP8 ", encoded(rgb, t, 20, level, modes)))
    assert webp.dimensions(data) == size
    got = webp.decode(data, t)
    diff = np.abs(got[..., :3].astype(int) - rgb)
    assert diff.max() <= 32 and diff.mean() <= 4.0 and (got[..., 3] == 255).all()


def alpha_by_hand(rest, method):
    rest, out = rest.astype(int), np.zeros(rest.shape, int)
    for y in range(rest.shape[0]):
        for x in range(rest.shape[1]):
            left, up = (out[y, x - 1] if x else None), (out[y - 1, x] if y else None)
            if left is None and up is None or method == 0:
                p = 0
            elif left is None or up is None:
                p = up if left is None else left
            else:
                p = (0, left, up, min(255, max(0, left + up - out[y - 1, x - 1])))[method]
            out[y, x] = (rest[y, x] + p) % 256
    return out


@pytest.mark.parametrize("method", range(4))
def test_alpha(method):
    rng = np.random.default_rng(method)
    for h, w in ((1, 1), (1, 9), (9, 1), (5, 7), (23, 37)):
        rest = rng.integers(0, 256, (h, w)).astype(np.uint8)
        expected = alpha_by_hand(rest, method)
        assert (webp.alpha_plane(bytes([method << 2]) + rest.tobytes(), w, h) == expected).all()
        rgba = np.dstack([np.zeros_like(rest), rest, np.zeros_like(rest), np.full_like(rest, 255)])
        stream = dict(webp.chunks(webp.encode(rgba)))[b"VP8L"]
        assert (vp8l.decode(stream)[..., 1] == rest).all()
        assert (webp.alpha_plane(bytes([method << 2 | 1]) + stream[5:], w, h) == expected).all()
    with pytest.raises(CodecError):
        webp.alpha_plane(bytes([2]), 1, 1)


def test_containers(spark):
    t, rgb = writer.tables(2), photo(40, 30)
    stream = encoded(rgb, t, 30)
    alpha = np.random.default_rng(1).integers(0, 256, (30, 40)).astype(np.uint8)
    size = lambda w, h: (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
    wide = riff((b"VP8X", b"\x10\0\0\0" + size(40, 30)), (b"ALPH", b"\0" + alpha.tobytes()), (b"VP8 ", stream))
    inner = b"ALPH" + struct.pack("<I", 1201) + b"\0" + alpha.tobytes() + b"\0" + b"VP8 " + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) % 2)
    moving = riff((b"VP8X", b"\x12\0\0\0" + size(60, 50)), (b"ANIM", bytes(6)), (b"ANMF", bytes([4, 0, 0, 3, 0, 0]) + size(40, 30) + bytes(4) + inner))
    rows = spark.createDataFrame([("wide", wide), ("moving", moving), ("cut", wide[:-400]), ("inter", riff((b"VP8 ", b"\1" + stream[1:])))], "path string, content binary")
    got = {r.path: r for r in files.decode(rows, vp8_listings=writer.listings(t)).collect()}
    plain = webp.decode(riff((b"VP8 ", stream)), t)
    whole = np.frombuffer(got["wide"].pixels, np.uint8).reshape(30, 40, 4)
    assert (whole[..., :3] == plain[..., :3]).all() and (whole[..., 3] == alpha).all()
    canvas = np.frombuffer(got["moving"].pixels, np.uint8).reshape(50, 60, 4)
    seen = alpha > 0
    assert (canvas[6:36, 8:48][seen] == whole[seen]).all() and canvas[:6].max() == 0
    assert got["cut"].error.kind == "decode" and got["inter"].error.kind == "unsupported"
    assert {r.error.kind for r in files.decode(rows.where("path = 'wide'")).collect()} == {"unsupported"}
    with pytest.raises(CodecError):
        vp8.Tables.read("const Prob other[2] = {1, 2};")
