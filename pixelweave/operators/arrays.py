"""Neighbourhood operators on whole images as arrays, with the weights and the rounding of ``neighbor``: for jobs that have a file in hand
and need no relation of its pixels."""

from __future__ import annotations

import numpy as np

from .neighbor import ONE, axis_weights, gaussian_weights


def _matrix(size: int, out: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """Input positions and weights of each output position, padded with weights of 0."""
    taps: list[list[tuple[int, int]]] = [[] for _ in range(out)]
    for o, i, w in axis_weights(size, out, kernel):
        taps[o].append((i, w))
    most = max(map(len, taps))
    at, weight = np.zeros((out, most), np.int64), np.zeros((out, most), np.int64)
    for o, own in enumerate(taps):
        at[o, : len(own)], weight[o, : len(own)] = zip(*own, strict=True)
    return at, weight


def _axis(pixels: np.ndarray, out: int, kernel: str) -> np.ndarray:
    """Resamples the first axis, a tap of all positions at a time."""
    at, weight = _matrix(pixels.shape[0], out, kernel)
    total = np.zeros((out, *pixels.shape[1:]), np.int64)
    for k in range(at.shape[1]):
        total += pixels[at[:, k]].astype(np.int64) * weight[:, k][:, None, None]
    return np.minimum(255, (np.maximum(total, 0) + ONE // 2) // ONE).astype(np.uint8)


def resize(pixels: np.ndarray, width: int, height: int, kernel: str = "lanczos3") -> np.ndarray:
    tall = _axis(pixels, max(1, height), kernel)
    return _axis(tall.swapaxes(0, 1), max(1, width), kernel).swapaxes(0, 1)


def gaussian_blur(pixels: np.ndarray, sigma: float) -> np.ndarray:
    """Rows first, then columns; weights off the image count for nothing."""
    weights = gaussian_weights(sigma)
    out = pixels.astype(np.int64)
    for axis in (1, 0):
        lines = out.swapaxes(0, axis)
        total, weight = lines * weights[0], np.full(len(lines), weights[0], np.int64)
        for d, w in enumerate(weights[1:], 1):
            if d < len(lines):
                total[d:] += lines[:-d] * w
                total[:-d] += lines[d:] * w
                weight[d:] += w
                weight[:-d] += w
        weight = weight[:, None, None]
        out = ((2 * total + weight) // (2 * weight)).swapaxes(0, axis)
    return out.astype(np.uint8)
