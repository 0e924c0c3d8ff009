"""Lens undistortion with the public OpenCV fisheye model, fused with the resize
to output size.

Where every output pixel samples the input depends only on the profile and the
two sizes, so that map is built once per Python worker and reused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from framesift.functions.arrays import binary_from_rows, byte_rows

FRACTION_BITS = 5
TILE = 128


def _cubic(x: np.ndarray) -> np.ndarray:
    a, x = -0.75, np.abs(x)
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    return np.where(x <= 1, near, np.where(x < 2, far, 0.0))


def _lanczos4(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 4, np.sinc(x) * np.sinc(x / 4), 0.0)


def _linear(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(x))


# Filter, taps on each side, bits per colour lane and bits per weight.  Without
# negative weights a lane never over- or underflows 16 bits.
KERNELS = {
    "bilinear": (_linear, 1, 16, 8),
    "bicubic": (_cubic, 2, 21, 11),
    "lanczos4": (_lanczos4, 4, 21, 11),
}


def _theta_limit(k: tuple) -> float:
    """The angle up to which the distortion still grows; beyond it pixels repeat."""
    theta = np.linspace(0, np.pi / 2, 4097)
    t2 = theta * theta
    slope = 1 + 3 * k[0] * t2 + 5 * k[1] * t2**2 + 7 * k[2] * t2**3 + 9 * k[3] * t2**4
    falling = np.flatnonzero(slope <= 0)
    return float(theta[falling[0]]) if falling.size else float(np.pi / 2)


def source_positions(camera: tuple, coeffs: tuple, in_size: tuple, out_size: tuple):
    """Input coordinates of every output pixel centre, and which are usable.

    `camera`: k00, k11, calib_w, calib_h, stretch_x, stretch_y; the principal
    point is the image centre, the rotation is the identity.
    """
    k00, k11, calib_w, calib_h, sx, sy = camera
    sx, sy = (s if s > 0.01 else 1.0 for s in (sx, sy))
    (in_w, in_h), (out_w, out_h) = in_size, out_size
    fx_in, fy_in = k00 * in_w / calib_w * sx, k11 * in_h / calib_h * sy
    fov = in_w / max(out_w, 1)
    fx_out, fy_out = fx_in / sx / fov, fy_in / sx / fov
    x = ((np.arange(out_w) + 0.5 - out_w / 2) / fx_out)[None, :]
    y = ((np.arange(out_h) + 0.5 - out_h / 2) / fy_out)[:, None]
    r = np.sqrt(x * x + y * y)
    theta = np.arctan(r)
    t2 = theta * theta
    k = tuple(coeffs) + (0.0,) * (4 - len(coeffs))
    bent = theta * (1 + t2 * (k[0] + t2 * (k[1] + t2 * (k[2] + t2 * k[3]))))
    scale = np.where(r > 1e-9, bent / np.maximum(r, 1e-9), 1.0)
    return (x * scale * fx_in + in_w / 2 - 0.5, y * scale * fy_in + in_h / 2 - 0.5,
            theta < _theta_limit(k))


@lru_cache(maxsize=4)
def tap_table(kernel: str) -> np.ndarray:
    """(taps, fractions + 1) integer weights; each fraction's weights sum to the
    whole.  The last column is empty, for pixels that see nothing."""
    weigh, reach, _, bits = KERNELS[kernel]
    steps = 1 << FRACTION_BITS
    frac = np.arange(steps) / steps
    line = weigh(np.arange(1 - reach, reach + 1)[:, None] - frac[None, :])
    line = line / line.sum(axis=0)
    # [y tap, x tap, y fraction, x fraction]
    full = line[:, None, :, None] * line[None, :, None, :]
    whole = np.rint(full * (1 << bits)).astype(np.int64)
    whole[reach - 1, reach - 1] += (1 << bits) - whole.sum(axis=(0, 1))
    flat = whole.reshape(4 * reach * reach, steps * steps)
    return np.concatenate([flat, np.zeros((flat.shape[0], 1), np.int64)], axis=1)


@dataclass(frozen=True)
class Tile:
    """A block of the output, the block of the input it samples, and per pixel the
    position of its first tap in that block and the column of its weights."""

    out: tuple[slice, slice]
    rows: tuple[int, int]
    cols: tuple[int, int]
    first: np.ndarray
    column: np.ndarray


@dataclass(frozen=True)
class Sampling:
    kernel: str
    out_size: tuple[int, int]
    tiles: tuple[Tile, ...]


@lru_cache(maxsize=8)
def sampling_map(camera: tuple, coeffs: tuple, in_size: tuple, out_size: tuple, kernel: str) -> Sampling:
    """Where the output samples the input, in tiles small enough that the input
    block of a tile stays in cache while all taps are gathered."""
    reach = KERNELS[kernel][1]
    u, v, usable = source_positions(camera, coeffs, in_size, out_size)
    in_w, in_h = in_size
    usable &= (u >= -0.5) & (v >= -0.5) & (u <= in_w - 0.5) & (v <= in_h - 0.5)
    steps = 1 << FRACTION_BITS
    u = np.rint(np.clip(u, 0, in_w - 1) * steps).astype(np.int64)
    v = np.rint(np.clip(v, 0, in_h - 1) * steps).astype(np.int64)
    column = ((v & (steps - 1)) << FRACTION_BITS) | (u & (steps - 1))
    column[~usable] = steps * steps
    u, v = u >> FRACTION_BITS, v >> FRACTION_BITS
    tiles = []
    for y in range(0, out_size[1], TILE):
        for x in range(0, out_size[0], TILE):
            out = (slice(y, min(y + TILE, out_size[1])), slice(x, min(x + TILE, out_size[0])))
            good = usable[out]
            if not good.any():
                continue
            tu, tv = u[out], v[out]
            # Taps reach from reach - 1 before the whole position to reach after it.
            rows = int(tv[good].min()) - reach + 1, int(tv[good].max()) + reach + 1
            cols = int(tu[good].min()) - reach + 1, int(tu[good].max()) + reach + 1
            first = (tv - reach + 1 - rows[0]) * (cols[1] - cols[0]) + (tu - reach + 1 - cols[0])
            first[~good] = 0
            tiles.append(Tile(out, rows, cols, first.ravel().astype(np.int32),
                              column[out].ravel().astype(np.int16)))
    return Sampling(kernel, out_size, tuple(tiles))


def _packed(frame: np.ndarray, rows: tuple, cols: tuple, lane_bits: int) -> np.ndarray:
    """A block of RGB pixels, three lanes of one int64 each; what lies outside the
    frame repeats its border."""
    h, w = frame.shape[:2]
    inside = frame[max(rows[0], 0):min(rows[1], h), max(cols[0], 0):min(cols[1], w)]
    packed = inside[..., 2].astype("<i8")
    for c in (1, 0):
        packed <<= lane_bits
        packed |= inside[..., c]
    over = ((max(0, -rows[0]), max(0, rows[1] - h)), (max(0, -cols[0]), max(0, cols[1] - w)))
    return (np.pad(packed, over, mode="edge") if any(map(any, over)) else packed).ravel()


def _unpacked(total: np.ndarray, lane_bits: int, bits: int, out: np.ndarray) -> None:
    if lane_bits == 16:
        # The weights have 8 bits, so the result is the upper byte of each lane.
        upper = total.view(np.uint8).reshape(-1, 8)
        for c in range(3):
            out[:, c] = upper[:, 2 * c + 1]
        return
    lane, sign = (1 << lane_bits) - 1, 1 << (lane_bits - 1)
    for c in range(3):
        # Lanes are signed: take one out, then remove it with its sign.
        value = ((total + sign) & lane) - sign
        out[:, c] = np.clip(value >> bits, 0, 255)
        total -= value
        total >>= lane_bits


def undistort(frame: np.ndarray, mapping: Sampling) -> np.ndarray:
    """(in_h, in_w, 3) to (out_h, out_w, 3); pixels that see nothing are black.

    All three channels of a tap are one multiplication; lanes are wide enough that
    they never mix.
    """
    _, reach, lane_bits, bits = KERNELS[mapping.kernel]
    table = tap_table(mapping.kernel)
    out = np.zeros((mapping.out_size[1], mapping.out_size[0], 3), dtype=np.uint8)
    half = sum((1 << (bits - 1)) << (lane_bits * c) for c in range(3))
    pixel, weight = np.empty(TILE * TILE, "<i8"), np.empty(TILE * TILE, "<i8")
    done = np.empty((TILE * TILE, 3), np.uint8)
    for tile in mapping.tiles:
        source = _packed(frame, tile.rows, tile.cols, lane_bits)
        stride = tile.cols[1] - tile.cols[0]
        at, col = tile.first.astype(np.intp), tile.column.astype(np.intp)
        n = at.size
        p, w = pixel[:n], weight[:n]
        total = np.full(n, half, dtype="<i8")
        for t in range(table.shape[0]):
            shift = (t // (2 * reach)) * stride + t % (2 * reach)
            np.take(source[shift:], at, out=p, mode="clip")
            np.take(table[t], col, out=w, mode="clip")
            p *= w
            total += p
        _unpacked(total, lane_bits, bits, done[:n])
        block = out[tile.out]
        block[...] = done[:n].reshape(block.shape)
    return out


def undistort_frames(rgb, width, height, out_w, out_h, k00, k11, calib_w, calib_h, stretch_x,
                     stretch_y, coeffs, interpolation: str = "bilinear") -> Column:
    """Undistorted RGB frames straight at output size."""
    if interpolation not in KERNELS:
        raise ValueError(f"unknown interpolation {interpolation}")

    @F.arrow_udf(T.BinaryType())
    def run(pixels: pa.Array, w: pa.Array, h: pa.Array, ow: pa.Array, oh: pa.Array, a: pa.Array,
            b: pa.Array, cw: pa.Array, ch: pa.Array, sx: pa.Array, sy: pa.Array,
            k: pa.Array) -> pa.Array:
        out = []
        columns = [c.to_pylist() for c in (w, h, ow, oh, a, b, cw, ch, sx, sy, k)]
        for v, iw, ih, tw, th, ka, kb, cal_w, cal_h, px, py, co in zip(byte_rows(pixels), *columns):
            if None in (iw, ih, tw, th, ka, kb, co):
                out.append(None)
                continue
            if min(iw, ih, tw, th) == 0:
                raise ValueError("empty input or output size")
            if v.size != iw * ih * 3:
                raise ValueError(f"{v.size} bytes are no {iw}x{ih} frame")
            mapping = sampling_map((ka, kb, cal_w, cal_h, px, py), tuple(co), (iw, ih), (tw, th),
                                   interpolation)
            out.append(undistort(v.reshape(ih, iw, 3), mapping))
        return binary_from_rows(out)
    return run(rgb, width, height, out_w, out_h, k00, k11, calib_w, calib_h, stretch_x, stretch_y, coeffs)
