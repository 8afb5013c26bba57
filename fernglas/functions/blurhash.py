"""BlurHash placeholders to pixels. A hash holds the lowest cosine terms of a picture, in base 83."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits of base 83, from 0 on.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#$%*+,-.:;=?@[]^_{|}~"
_WORTH = {c: n for n, c in enumerate(DIGITS)}


def _number(digits: str) -> int:
    n = 0
    for c in digits:
        n = n * len(DIGITS) + _WORTH[c]
    return n


def _linear(channel: np.ndarray) -> np.ndarray:
    x = channel / 255.0
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


def _srgb(linear: np.ndarray) -> np.ndarray:
    """Bytes, the next whole number above each value and at most 255."""
    x = linear.clip(0.0, 1.0)
    return np.floor(np.where(x <= 0.0031308, x * 12.92, 1.055 * x ** (1 / 2.4) - 0.055) * 255 + 1).clip(max=255).astype(np.uint8)


def decode(code: str | None, width: int, height: int, punch: float = 1.0) -> np.ndarray | None:
    """(height, width, 3) bytes of red, green and blue; None for what is no hash. punch: contrast."""
    if not code or len(code) < 6 or any(c not in _WORTH for c in code):
        return None
    rows, columns = (n + 1 for n in divmod(_number(code[0]), 9))
    if len(code) != 4 + 2 * rows * columns:
        return None
    mean = _number(code[2:6])
    terms = np.empty((rows * columns, 3))
    terms[0] = _linear(np.array([mean >> 16, mean >> 8 & 255, mean & 255], dtype=np.float64))
    packed = np.array([_number(code[at : at + 2]) for at in range(6, len(code), 2)], dtype=np.int64)
    steps = (np.stack([packed // 361, packed // 19 % 19, packed % 19], axis=1) - 9) / 9.0
    terms[1:] = np.sign(steps) * steps**2 * punch * (_number(code[1]) + 1) / 166
    across = np.cos(np.pi * np.outer(np.arange(width), np.arange(columns)) / width)
    down = np.cos(np.pi * np.outer(np.arange(height), np.arange(rows)) / height)
    return _srgb(np.einsum("yj,xi,jic->yxc", down, across, terms.reshape(rows, columns, 3)))


def pixels(code: Column, width: int = 32, height: int = 32, punch: float = 1.0) -> Column:
    """A column of width * height * 3 bytes, row by row; NULL for what is no hash."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda c: None if (found := decode(c, width, height, punch)) is None else found.tobytes())

    return run(code)
