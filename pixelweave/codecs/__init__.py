"""Image file formats: bytes to (width, height, RGBA array) and back."""

from __future__ import annotations

import numpy as np


class CodecError(Exception):
    """kind: decode, encode, unsupported or invalid_input."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


def damaged(message: str) -> CodecError:
    return CodecError("decode", message)


def unsupported(message: str) -> CodecError:
    return CodecError("unsupported", message)


def need(data: bytes, start: int, size: int) -> bytes:
    if start < 0 or size < 0 or start + size > len(data):
        raise damaged("the data ends early")
    return data[start : start + size]


def check_size(width: int, height: int, side: int, area: int = 1 << 28) -> None:
    """Before anything is allocated: positive sides of at most `side`, at most `area` pixels."""
    if width < 1 or height < 1:
        raise damaged("width and height must be positive")
    if width > side or height > side or width * height > area:
        raise damaged("the image is too large")


def to_rgba(pixels: np.ndarray) -> np.ndarray:
    pixels = np.ascontiguousarray(pixels, np.uint8)
    if pixels.ndim != 3 or pixels.shape[2] != 4:
        raise CodecError("invalid_input", "pixels must be height x width x 4")
    return pixels
