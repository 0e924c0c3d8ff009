"""Small numpy kernels on blocks of equally sized frames, used inside Arrow tasks."""

from __future__ import annotations

import numpy as np

from framesift import params as P


def luma(rgb: np.ndarray) -> np.ndarray:
    """(n, px, 3) uint8 to (n, px) uint8; the weights sum to 256."""
    wide = rgb.astype(np.uint16)
    return ((wide[..., 0] * P.LUMA_RED + wide[..., 1] * P.LUMA_GREEN
             + wide[..., 2] * P.LUMA_BLUE) >> 8).astype(np.uint8)


def laplacian_variance(gray: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
    """Population variance of the 4-neighbour Laplacian of each (h, w) frame.

    With a mask, a pixel counts only when it and its 4 neighbours are valid.
    """
    n, h, w = gray.shape
    if w < 3 or h < 3:
        return np.zeros(n)
    g = gray.astype(np.int16)
    lap = (g[:, 1:-1, :-2] + g[:, 1:-1, 2:] + g[:, :-2, 1:-1] + g[:, 2:, 1:-1]
           - 4 * g[:, 1:-1, 1:-1]).astype(np.int32)
    if valid is None:
        count = np.full(n, (h - 2) * (w - 2), dtype=np.int64)
    else:
        ok = valid != 0
        inner = (ok[:, 1:-1, 1:-1] & ok[:, 1:-1, :-2] & ok[:, 1:-1, 2:]
                 & ok[:, :-2, 1:-1] & ok[:, 2:, 1:-1])
        lap = lap * inner
        count = inner.sum(axis=(1, 2), dtype=np.int64)
    flat = lap.reshape(n, -1)
    total = flat.sum(axis=1, dtype=np.int64)
    squares = (flat * flat).sum(axis=1, dtype=np.int64)
    some = np.maximum(count, 1).astype(np.float64)
    mean = total / some
    return np.where(count > 0, squares / some - mean * mean, 0.0)


def mean_abs_diff(a: np.ndarray, b: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
    """Mean absolute difference in [0, 1] of each pair of rows over valid pixels."""
    diff = np.abs(a.astype(np.int16) - b.astype(np.int16))
    if valid is None:
        count = np.full(diff.shape[0], diff.shape[1], dtype=np.int64)
    else:
        diff = diff * valid
        count = valid.sum(axis=1, dtype=np.int64)
    total = diff.sum(axis=1, dtype=np.int64)
    return np.where(count > 0, total / (np.maximum(count, 1) * 255.0), 0.0)


def nearest(src: int, dst: int) -> np.ndarray:
    """Source position of every destination position, rounded down."""
    return np.minimum(np.arange(dst, dtype=np.int64) * src // max(dst, 1), max(src - 1, 0))


def grow_invalid(mask: np.ndarray, r: int) -> np.ndarray:
    """Spread zeros by `r` pixels along both axes of (n, h, w), clamped at the borders."""
    if r <= 0:
        return mask
    out = mask
    for axis in (2, 1):
        hit = out == 0
        size = hit.shape[axis]
        before = np.concatenate([np.zeros_like(hit.take([0], axis)), hit], axis).cumsum(axis, dtype=np.int32)
        pos = np.arange(size)
        high = before.take(np.minimum(pos + r, size - 1) + 1, axis)
        low = before.take(np.maximum(pos - r, 0), axis)
        out = np.where(high > low, 0, out)
    return out.astype(np.uint8)


def sky_from_top(rgb: np.ndarray, gray: np.ndarray, luma_min: int, blue_bias: int,
                 gradient_max: int) -> np.ndarray:
    """Pixels of (n, h, w) reachable from the top edge over bright, bluish
    neighbours whose luma changes by at most `gradient_max` per step.

    Rows are swept down and up until nothing changes; within a row, a hit
    reaches the whole run of linked pixels at once.
    """
    n, h, w = gray.shape
    g = gray.astype(np.int16)
    bluish = rgb[..., 2].astype(np.int16) - rgb[..., 0].astype(np.int16) >= blue_bias
    able = (g >= luma_min) & bluish
    right = able[:, :, 1:] & able[:, :, :-1] & (np.abs(g[:, :, 1:] - g[:, :, :-1]) <= gradient_max)
    down = able[:, 1:] & able[:, :-1] & (np.abs(g[:, 1:] - g[:, :-1]) <= gradient_max)
    starts, run = [], []
    for y in range(h):
        new = np.ones((n, w), dtype=bool)
        new[:, 1:] = ~right[:, y]
        flat = new.ravel()
        starts.append(np.flatnonzero(flat))
        run.append(np.cumsum(flat) - 1)
    reached = np.zeros((n, h, w), dtype=bool)
    reached[:, 0] = able[:, 0]

    def settle(y: int, seeds: np.ndarray) -> bool:
        row = reached[:, y]
        if not (seeds & ~row).any():
            return False
        hits = np.logical_or.reduceat((row | seeds).ravel(), starts[y])
        reached[:, y] = hits[run[y]].reshape(n, w) & able[:, y]
        return True

    changed = True
    while changed:
        changed = False
        for y in range(1, h):
            changed |= settle(y, reached[:, y - 1] & down[:, y - 1])
        for y in range(h - 2, -1, -1):
            changed |= settle(y, reached[:, y + 1] & down[:, y])
    return reached


#: Bytes of labels that are smoothed together, so that their running counts stay in cache.
_TILE = 1 << 18


def trailing_mode(history: np.ndarray, window: int) -> np.ndarray:
    """Most frequent label over the last `window` rows; ties to the earliest seen.

    `history` is (window - 1 + n, px) int16 with -1 where there is no earlier
    frame; the result is (n, px).  Counts of each label run along: one is the difference of
    two running totals, so a frame costs the same whatever the window.
    """
    n, px = history.shape[0] - window + 1, history.shape[1]
    out = np.empty((n, px), np.uint8)
    rows = max(4 * window, 64)
    wide = max(1, _TILE // (rows + window))
    for a in range(0, n, rows):
        last = min(a + rows, n)
        for p in range(0, px, wide):
            out[a:last, p:p + wide] = _sliding_modes(history[a:last + window - 1, p:p + wide], window)
    return out


def _sliding_modes(block: np.ndarray, window: int) -> np.ndarray:
    total = block.shape[0]
    n = total - window + 1
    labels = np.flatnonzero(np.bincount(block.ravel() + 1, minlength=2)[1:])
    if len(labels) == 1:
        return np.full((n, block.shape[1]), labels[0], np.uint8)
    at = np.arange(total, dtype=np.int32)[:, None]
    best = np.zeros((n, block.shape[1]), np.int32)
    found = np.zeros(best.shape, np.uint8)
    for label in labels:
        here = block == label
        counts = np.cumsum(here, axis=0, dtype=np.int32)
        score = counts[window - 1:].copy()
        score[1:] -= counts[:n - 1]
        # Of equal counts the label first seen in the window wins: its next place from the window's start on.
        first = np.where(here, at, np.int32(total))
        first = np.minimum.accumulate(first[::-1], axis=0)[::-1]
        score *= total + 1
        score -= first[:n]
        better = score > best
        found[better] = label
        np.maximum(best, score, out=best)
    return found


def first_max(logits: np.ndarray) -> np.ndarray:
    """Position of the first maximum along axis 0; NaN never wins."""
    return np.argmax(np.where(np.isnan(logits), -np.inf, logits), axis=0).astype(np.uint8)
