"""Frame files as a data source of their own, for batches and for streams.

`frames_from(spark, path)` reads a folder of `stem_000123.png` files.  The scan is planned by clip and frame range, so one
clip spreads over many tasks and a task reads frames that follow each other.  Filters on `stem` and `frame_index`
are taken over by the source: files outside are neither planned nor opened.

As a stream the source hands out files in the order of their modification time and name; that pair is the offset.
A file counts once it is older than `settleSeconds`, so one that is moved into the folder a little late is not missed.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual)

from framesift.functions import png
from framesift.session import qualified

FRAMES = T.StructType([
    T.StructField("stem", T.StringType()),
    T.StructField("frame_index", T.LongType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("rgb", T.BinaryType()),
])
_ARROW = pa.schema([("stem", pa.string()), ("frame_index", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary())])
_NAME = re.compile(r"(.*)_([0-9]+)(?:\.[^./]*)+")
#: Frames and bytes of one task, and bytes of pixels that are handed on together.
TASK_FRAMES, TASK_BYTES, BATCH_BYTES = 1024, 128 << 20, 16 << 20
_BOUNDS = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}


@dataclass
class FrameRange(InputPartition):
    """Frames of one clip that follow each other."""

    stem: str
    first: int
    last: int
    names: list[str]


@dataclass
class _File:
    stem: str
    index: int
    name: str
    size: int
    changed: int


def _listed(path: str) -> list[_File]:
    from pyarrow import fs as pafs
    files, root = pafs.FileSystem.from_uri(path)
    found = []
    for info in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        match = _NAME.fullmatch(info.base_name)
        if info.type == pafs.FileType.File and match and not info.base_name.startswith((".", "_")):
            found.append(_File(match[1], int(match[2]), info.base_name, info.size or 0, info.mtime_ns or 0))
    return found


def _ranges(found: list[_File], frames: int, size: int) -> list[FrameRange]:
    parts: list[FrameRange] = []
    held = 0
    for f in sorted(found, key=lambda f: (f.stem, f.index, f.name)):
        last = parts[-1] if parts else None
        if last is None or last.stem != f.stem or len(last.names) >= frames or held + f.size > size:
            parts.append(FrameRange(f.stem, f.index, f.index, [f.name]))
            held = f.size
        else:
            last.names.append(f.name)
            last.last, held = f.index, held + f.size
    return parts


def _decoded(path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The frames of some files, in batches of bounded size; what is no image has size -1 and no pixels."""
    from pyarrow import fs as pafs
    files, root = pafs.FileSystem.from_uri(path)
    rows: list[tuple] = []
    held = 0
    for name in names:
        match = _NAME.fullmatch(name)
        with files.open_input_stream(f"{root}/{name}") as source:
            data = source.read()
        try:
            rgb = _pixels(name, data)
            row = match[1], int(match[2]), rgb.shape[1], rgb.shape[0], rgb.tobytes()
        except ValueError:
            row = match[1], int(match[2]), -1, -1, None
        rows.append(row)
        held += len(row[4] or b"")
        if held >= BATCH_BYTES:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _pixels(name: str, data: bytes):
    if data[:8] == b"\x89PNG\r\n\x1a\n" or name.endswith(".png"):
        return png.decode(data)
    import io

    import numpy as np
    try:
        from PIL import Image
    except ImportError:
        raise RuntimeError("reading JPEG frames through this source needs Pillow on the executors") from None
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class FrameReader(DataSourceReader):
    def __init__(self, path: str, frames: int, size: int):
        self.path, self.frames, self.size = path, frames, size
        self.stems: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes clip names and bounds of frame numbers; hands back what it does not know."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("stem",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.stems = names if self.stems is None else self.stems & names
            elif column == ("frame_index",) and type(f) in _BOUNDS and isinstance(f.value, int):
                low, high = _BOUNDS[type(f)]
                if low is not None:
                    self.low = max(self.low, f.value + low)
                if high is not None:
                    self.high = min(self.high, f.value + high)
            elif not (isinstance(f, IsNotNull) and column in (("stem",), ("frame_index",))):
                yield f

    def partitions(self) -> list[FrameRange]:
        found = [f for f in _listed(self.path) if (self.stems is None or f.stem in self.stems) and self.low <= f.index <= self.high]
        return _ranges(found, self.frames, self.size)

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        # Without any file Spark plans one task with no range.
        yield from _decoded(self.path, partition.names if partition is not None else [])


class FrameStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, frames: int, size: int, settle: float):
        self.path, self.frames, self.size, self.settle = path, frames, size, settle

    def initialOffset(self) -> dict:
        return {"changed": 0, "name": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        changed, name = max(((f.changed, f.name) for f in _listed(self.path) if f.changed <= until), default=(0, ""))
        return {"changed": changed, "name": name}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        after, upto = (start["changed"], start["name"]), (end["changed"], end["name"])
        return _ranges([f for f in _listed(self.path) if after < (f.changed, f.name) <= upto], self.frames, self.size)

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        yield from _decoded(self.path, partition.names if partition is not None else [])

    def commit(self, end: dict) -> None:
        return None


class FrameSource(DataSource):
    """`spark.read.format("frame_source").option("path", ...)`, rows as in `FRAMES`."""

    @classmethod
    def name(cls) -> str:
        return "frame_source"

    def schema(self):
        return FRAMES

    def _sizes(self) -> tuple[str, int, int]:
        return self.options["path"], int(self.options.get("taskFrames", TASK_FRAMES)), int(self.options.get("taskBytes", TASK_BYTES))

    def reader(self, schema) -> FrameReader:
        return FrameReader(*self._sizes())

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(*self._sizes(), float(self.options.get("settleSeconds", 0)))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, once, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(FrameSource)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def frames_from(spark: SparkSession, path: str, task_frames: int = TASK_FRAMES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(stem, frame_index, width, height, rgb) of a folder of frame files."""
    register(spark)
    return (spark.read.format("frame_source").option("path", qualified(spark, path)).option("taskFrames", task_frames)
            .option("taskBytes", task_bytes).load())


def frame_stream(spark: SparkSession, path: str, settle_seconds: float = 0, task_frames: int = TASK_FRAMES) -> DataFrame:
    """The same rows as files arrive."""
    register(spark)
    return (spark.readStream.format("frame_source").option("path", qualified(spark, path)).option("taskFrames", task_frames)
            .option("settleSeconds", settle_seconds).load())
