"""A small PNG writer on the standard library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_GRAY, _RGB = 0, 2


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray) -> bytes:
    """(h, w) gray or (h, w, 3) RGB bytes as a PNG, each row stored as its
    difference to the row above; fast compression."""
    h, w = pixels.shape[:2]
    colour = _GRAY if pixels.ndim == 2 else _RGB
    rows = pixels.reshape(h, -1)
    up = np.empty((h, rows.shape[1] + 1), dtype=np.uint8)
    up[:, 0] = 2
    up[0, 1:] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=up[1:, 1:])
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return (b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head)
            + _chunk(b"IDAT", zlib.compress(up.tobytes(), 1)) + _chunk(b"IEND", b""))


_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """An 8-bit PNG that is not interlaced, as (h, w, 3) RGB; transparency is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        part = data[at + 8:at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only 8-bit PNG without interlacing is read")
    w, h, _, colour = head[:4]
    n = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[:h * (w * n + 1)].reshape(h, w * n + 1)
    rows = _unfiltered(raw[:, 0], raw[:, 1:].copy(), n).reshape(h, w, n)
    if colour == 3:
        return palette[rows[:, :, 0]]
    return np.repeat(rows[:, :, :1], 3, axis=2) if n < 3 else np.ascontiguousarray(rows[:, :, :3])


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows as differences to their neighbours, back to bytes, in place."""
    if (kinds == 2).all():
        return np.cumsum(rows, axis=0, dtype=np.uint8)
    above = np.zeros(rows.shape[1], np.uint8)
    for kind, row in zip(kinds, rows):
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row += above
        elif kind:
            _from_two(kind, row, above, n)
        above = row
    return rows


def _from_two(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> None:
    """The filters that look at both neighbours go pixel by pixel."""
    left, corner = np.zeros(n, np.int16), np.zeros(n, np.int16)
    for at in range(0, len(row), n):
        up = above[at:at + n].astype(np.int16)
        if kind == 3:
            guess = (left + up) >> 1
        else:
            a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        left = (row[at:at + n] + guess) & 255
        row[at:at + n] = left
        corner = up
