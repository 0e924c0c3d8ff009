"""Text of whole Arrow batches as numpy arrays: bytes, code points, words and word shingles.

Everything works on the joined bytes of a batch in slices of bounded size, so a batch of many short texts
and a batch with one very long text cost about the same memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together.
SLICE = 1 << 20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `limit` bytes together; a longer row is a run of its own."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi
        lo = hi


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts begin in joined texts: at each text, and at each space behind another character than white space.

    Tokenizers that begin a token with the blank before a word begin one at each part.  A space that ends its text stays
    where it is, and so does one behind U+2581, which some of them take for a blank.
    """
    at = np.flatnonzero(data == 0x20)
    inside = np.ones(len(data) + 1, bool)
    inside[offsets] = False
    at = at[inside[at] & inside[at + 1]]
    before = data[at - 1]
    plain = (before >= 0x21) & (before <= 0x7E)
    wide = np.flatnonzero(before >= 0x80)
    if len(wide):
        one, two = data[at[wide] - 2], data[np.maximum(at[wide] - 3, 0)]
        last = before[wide]
        # White space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
        white = (one == 0xC2) & ((last == 0x85) | (last == 0xA0))
        white |= (two == 0xE1) & (one == 0x9A) & (last == 0x80)
        white |= (two == 0xE2) & (one == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
        white |= (two == 0xE2) & (one == 0x81) & (last == 0x9F)
        white |= (two == 0xE3) & (one == 0x80) & (last == 0x80)
        white |= (two == 0xE2) & (one == 0x96) & (last == 0x81)
        plain[wide] = ~white
    return np.sort(np.concatenate((at[plain], offsets[:-1][np.diff(offsets) > 0])))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points)."""
    try:
        found = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        return found, starts[offsets]
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        found = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        return found, np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))


#: A word is a run of other bytes than these.
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(7))
#: A random number for each byte value; A-Z have those of a-z.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each row): A-Z count as a-z."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    white = _WHITE[data]
    cut = np.zeros(len(data), bool)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    inside = ~white
    begin = inside.copy()
    begin[1:] &= white[:-1] | cut[1:]
    first = np.flatnonzero(begin)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    end = inside.copy()
    end[:-1] &= white[1:] | cut[1:]
    last = np.flatnonzero(end) + 1
    length = last - first
    longest = int(length.max())
    power = np.ones(longest, np.uint64)
    if longest > 1:
        power[1:] = np.cumprod(np.full(longest - 1, _STEP))
    place = np.arange(len(data))
    place -= np.repeat(np.append(0, first), np.diff(np.concatenate(([0], first, [len(data)]))))
    value = _BYTE[data]
    value *= power[np.clip(place, 0, longest - 1)]
    value[white] = 0
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    found = mix64(total[last] - total[first] + length.astype(np.uint64))
    return found, np.searchsorted(first, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit fingerprint of each shingle, offsets): a row with fewer words has one, of all of them."""
    found, start = words(data, offsets)
    count = np.diff(start)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    where = np.concatenate(([0], np.cumsum(n)))
    total = int(where[-1])
    if not total:
        return np.zeros(0, np.uint64), where
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(total) - where[row] + start[row]
    length = np.minimum(count[row], size)
    value = length.astype(np.uint64) * _STEP
    for k in range(size):
        there = k < length
        word = found[np.minimum(at + k, len(found) - 1)]
        value = np.where(there, mix64(value + word), value)
    return value, where


def distinct(values: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct values of each row."""
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a < 2:
            yield values[a:b]
            continue
        own = np.sort(values[a:b])
        keep = np.empty(len(own), bool)
        keep[0] = True
        np.not_equal(own[1:], own[:-1], out=keep[1:])
        yield own[keep]
