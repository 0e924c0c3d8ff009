"""Separable convolution resampling of frame blocks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)


FILTERS = {"bilinear": (triangle, 1.0), "lanczos3": (lanczos3, 3.0)}


WEIGHT_BITS = 14


@lru_cache(maxsize=64)
def taps(src: int, dst: int, filter_name: str) -> tuple[np.ndarray, np.ndarray]:
    """(dst, k) source positions and filter weights in 2**14ths, widened when shrinking.

    Each row sums to the whole; what rounding leaves over goes to its largest weight.
    """
    kernel, support = FILTERS[filter_name]
    scale = src / dst
    width = max(scale, 1.0)
    centre = ((np.arange(dst) + 0.5) * scale)[:, None]
    first = np.floor(centre - support * width).astype(np.int64)
    at = first + np.arange(int(np.ceil(2 * support * width)) + 2)
    away = at + 0.5 - centre
    table = np.where((np.abs(away) < support * width) & (at >= 0) & (at < src), kernel(away / width), 0.0)
    table /= table.sum(axis=1, keepdims=True)
    whole = np.rint(table * (1 << WEIGHT_BITS)).astype(np.int32)
    whole[np.arange(dst), whole.argmax(axis=1)] += (1 << WEIGHT_BITS) - whole.sum(axis=1)
    used = (whole != 0).any(axis=0)
    return np.clip(at, 0, src - 1)[:, used], whole[:, used]


def along(block: np.ndarray, dst: int, axis: int, filter_name: str) -> np.ndarray:
    """Resample one axis to `dst`, rounding half up to whole bytes."""
    if block.shape[axis] == dst:
        return block
    at, weight = taps(block.shape[axis], dst, filter_name)
    shape = [1] * block.ndim
    shape[axis] = dst
    total = np.full(block.shape[:axis] + (dst,) + block.shape[axis + 1:], 1 << (WEIGHT_BITS - 1), np.int32)
    for k in range(at.shape[1]):
        total += block.take(at[:, k], axis) * weight[:, k].reshape(shape)
    return np.clip(total >> WEIGHT_BITS, 0, 255).astype(np.uint8)


def resize(block: np.ndarray, width: int, height: int, filter_name: str) -> np.ndarray:
    """(n, h, w, channels) uint8 to the given size; columns first, then rows."""
    if block.shape[1:3] == (height, width):
        return block
    return along(along(block, width, 2, filter_name), height, 1, filter_name)
