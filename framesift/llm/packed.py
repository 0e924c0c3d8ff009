"""Signature rows in packed form: (bucket, block of keys and owners).

A self-join on signatures needs many short rows.  Tasks write them as blocks, one for each bucket they have
keys for; a bucket is a range of key hashes, so Spark deals buckets out like any key while a block holds
thousands of rows.  Buckets are as many as the rows ask for, so a bucket stays small at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from framesift.llm.common import partitions

#: Rows that a bucket should hold on average, and rows that a task holds before it writes blocks.
BUCKET_ROWS = 200_000
HELD_ROWS = 1 << 19

SCHEMA = "bucket int, block binary"


def bucket_count(spark: SparkSession, rows: int) -> int:
    return int(max(4 * partitions(spark), -(-rows // BUCKET_ROWS)))


class Packer:
    """Collects rows of a numpy record type whose first field is `key`, the low half of a 64-bit key.

    The high half tells the bucket, so buckets are even for well mixed keys.
    """

    def __init__(self, kind: np.dtype, buckets: int):
        self.kind, self.buckets = kind, buckets
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._rows = 0

    def add(self, key: np.ndarray, **fields: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.empty(len(key), self.kind)
        rows["key"] = key & np.uint64(0xFFFFFFFF)
        for name, values in fields.items():
            rows[name] = values
        bucket = ((key >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)
        self._held.append((bucket, rows))
        self._rows += len(rows)
        if self._rows >= HELD_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self._rows:
            return
        bucket = np.concatenate([b for b, _ in self._held])
        rows = np.concatenate([r for _, r in self._held])
        self._held, self._rows = [], 0
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        edge = np.flatnonzero(np.diff(bucket, prepend=-1))
        cut = np.append(edge, len(rows))
        blocks = [rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        for a in range(0, len(blocks), 2048):
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edge[a:a + 2048]]), pa.array(blocks[a:a + 2048], pa.binary())], ["bucket", "block"])


def unpack(blocks: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """The rows of all blocks of a bucket, sorted by key and node, each pair of them once."""
    rows = np.frombuffer(b"".join(b.as_py() for b in blocks), kind)
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    new = (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
    return rows[np.append(True, new)]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of each run of equal keys in a sorted array."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))
