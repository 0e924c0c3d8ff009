"""Arrow columns to numpy blocks and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_rows(column: pa.Array) -> list[np.ndarray]:
    """One uint8 vector per row, without copying binary payloads."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type):
        return [np.asarray(v.as_py(), dtype=np.uint8) for v in column]
    offsets_type = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return []
    bounds = np.frombuffer(offsets, dtype=offsets_type)[column.offset:column.offset + n + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def binary_from_block(block: np.ndarray) -> pa.Array:
    """A binary column from an (n, ...) uint8 block, one buffer, no per-row copies."""
    n = block.shape[0]
    flat = np.ascontiguousarray(block, dtype=np.uint8).reshape(n, -1)
    length = flat.shape[1] if n else 0
    if n * length < 2**31 - 1:
        offsets = (np.arange(n + 1, dtype=np.int64) * length).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return pa.array([row.tobytes() for row in flat], pa.binary())


def binary_from_rows(rows) -> pa.Array:
    """A binary column from byte vectors of any length, None for NULL; each is copied once."""
    rows = [None if r is None else np.ascontiguousarray(r, dtype=np.uint8).reshape(-1) for r in rows]
    ends = np.cumsum([0] + [0 if r is None else r.size for r in rows], dtype=np.int64)
    if ends[-1] >= 2**31 - 1:
        return pa.array([None if r is None else r.tobytes() for r in rows], pa.binary())
    data = np.empty(int(ends[-1]), np.uint8)
    for r, at in zip(rows, ends):
        if r is not None:
            data[at:at + r.size] = r
    valid = np.array([r is not None for r in rows], bool)
    bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(rows), [bits, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def number_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all numbers, first place of each row, length of each row) of a list column; NULL rows have length -1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bounds = column.offsets.to_numpy()
    length = np.where(np.asarray(column.is_valid()), np.diff(bounds), -1)
    return column.values.to_numpy(zero_copy_only=False), bounds[:-1], length


def grouped_by_shape(keys: list[tuple]) -> dict[tuple, np.ndarray]:
    """Row numbers of a batch by their shape key, so rows of one size run as one block."""
    found: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        found.setdefault(key, []).append(i)
    return {k: np.asarray(v) for k, v in found.items()}


def by_block(n: int, shapes: list[tuple | None], run) -> list:
    """Run `run(rows, shape)` once per distinct shape; scatter the results.

    Rows whose shape is None stay None.
    """
    out: list = [None] * n
    for shape, rows in grouped_by_shape(shapes).items():
        if shape is None:
            continue
        for i, value in zip(rows, run(rows, shape)):
            out[i] = value
    return out


def chunks(rows: np.ndarray, pixels: int, budget: int = 1 << 20):
    """Row numbers in runs small enough that a block's temporaries stay in cache."""
    step = max(1, budget // max(1, pixels))
    for a in range(0, len(rows), step):
        yield rows[a:a + step]


def stacked(values: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The given rows as one block; rows that already lie side by side are not copied."""
    first = values[rows[0]]
    base = first.base
    if base is not None and len(rows) > 1 and (np.diff(rows) == 1).all():
        start = first.__array_interface__["data"][0]
        last = values[rows[-1]].__array_interface__["data"][0]
        if last - start == (len(rows) - 1) * first.nbytes:
            return np.lib.stride_tricks.as_strided(
                first, (len(rows), first.size), (first.nbytes, 1), writeable=False)
    return np.stack([values[i] for i in rows])
