"""Which files of a dataset exist, as bitmaps of frame numbers instead of one row per file.

A row is (folder, stem, ext, stretch, bits): the frames `stretch * STRETCH + i` whose bit i is set have a file
`folder/stem_000123.ext`.  A dataset of a million images is some thousand rows.

`listed` makes the rows from a folder in tasks: each folder is listed by a task of its own, level by level, so the driver
holds no names.  `of_paths` makes them from a table of paths.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from framesift.functions.arrays import byte_rows
from framesift.functions.text import image_name
from framesift.session import materialise, qualified

#: Frames of a bitmap.
STRETCH = 512
SET = "folder string, stem string, ext string, stretch long, bits binary"
_NAME = re.compile(r"(.*)_([0-9]{6,})\.(.+)", re.DOTALL)
#: Bitmaps that a task holds before it hands them on.
_HELD = 1 << 16


def stretch_of(index: str = "frame_index"):
    return F.expr(f"`{index}` div {STRETCH}")


def bits_of(index: str = "frame_index"):
    """An aggregate: the bits of frame numbers of one stretch, cut behind the last one that is set."""
    place = F.col(index) % STRETCH
    return F.substring(F.bitmap_construct_agg(place), F.lit(1), (F.max(place) / 8).cast("int") + 1)


def of_paths(listing: DataFrame) -> DataFrame:
    """The set of a table of paths relative to the dataset's folder."""
    name = r"^(?:(.*)/)?([^/]*)_([0-9]{6,})\.([^/]+)$"
    parts = listing.select("path", *[F.regexp_extract("path", name, i).alias(n) for i, n in enumerate(("folder", "stem", "number", "ext"), 1)])
    numbered = parts.where("number <> ''").withColumn("frame_index", F.col("number").try_cast("long")).where("frame_index IS NOT NULL")
    # Only names as they are written: a number with more zeros is another file.
    same = F.concat("stem", F.lit("_"), "number", F.lit("."), "ext") == image_name(F.col("stem"), F.col("frame_index"), F.col("ext"))
    return (numbered.where(same).groupBy("folder", "stem", "ext", stretch_of().alias("stretch")).agg(bits_of().alias("bits")))


def expected(kept: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """What a complete clip has: (clip_id, folder, stem, ext, stretch, wanted) for `names` of (folder, ext)."""
    sets = kept.groupBy("clip_id", "stem", stretch_of().alias("stretch")).agg(bits_of().alias("wanted"))
    every = F.explode(F.array(*[F.struct(F.lit(f).alias("folder"), F.lit(e).alias("ext")) for f, e in names]))
    return sets.withColumn("_n", every).select("clip_id", "_n.folder", "stem", "_n.ext", "stretch", "wanted")


@F.arrow_udf(T.LongType())
def absent(wanted: pa.Array, have: pa.Array) -> pa.Array:
    """How many bits of `wanted` are not in `have` (NULL: none is)."""
    there = np.asarray(have.is_valid())
    out = []
    for w, h, ok in zip(byte_rows(wanted), byte_rows(have), there):
        both = np.zeros(len(w), np.uint8)
        if ok:
            n = min(len(w), len(h))
            both[:n] = w[:n] & h[:n]
        out.append(int(np.bitwise_count(w ^ both).sum()))
    return pa.array(out, pa.int64())


def missing(kept: DataFrame, files: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """(clip_id, files_missing) of clips that lack files."""
    key = ["folder", "stem", "ext", "stretch"]
    merged = files.groupBy(*key).agg(F.bitmap_or_agg("bits").alias("bits"))
    gone = expected(kept, names).join(merged, key, "left").select("clip_id", absent("wanted", "bits").alias("n"))
    return gone.groupBy("clip_id").agg(F.sum("n").alias("files_missing")).where("files_missing > 0")


# --- listing in tasks ------------------------------------------------------------------------

def _entries(files, root: str, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what lies directly in a folder."""
    from pyarrow import fs as pafs
    where = f"{root}/{folder}" if folder else root
    if isinstance(files, pafs.LocalFileSystem):
        if not os.path.isdir(where):
            return
        with os.scandir(where) as found:  # one by one, however many there are
            for e in found:
                yield e.name, e.is_dir()
        return
    for info in files.get_file_info(pafs.FileSelector(where, allow_not_found=True)):
        yield info.base_name, info.type == pafs.FileType.Directory


def _list_folders(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        files, root = pafs.FileSystem.from_uri(uri)

        def out(kind: str, rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(rows), pa.string()),
                 *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())))],
                ["kind", "folder", "stem", "ext", "stretch", "bits"])
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                inner: list[tuple] = []
                held: dict[tuple, np.ndarray] = {}
                for name, is_folder in _entries(files, root, folder):
                    if is_folder:
                        inner.append((f"{folder}/{name}" if folder else name, None, None, None, None))
                        continue
                    match = _NAME.fullmatch(name)
                    if match is None or match[2] != f"{int(match[2]):06d}":
                        continue
                    index = int(match[2])
                    key = folder, match[1], match[3], index // STRETCH
                    if key not in held:
                        if len(held) >= _HELD:
                            yield out("set", [(*k, v.tobytes()) for k, v in held.items()])
                            held.clear()
                        held[key] = np.zeros(STRETCH // 8, np.uint8)
                    held[key][index % STRETCH // 8] |= 1 << index % 8
                yield out("folder", inner)
                yield out("set", [(*k, v.tobytes()) for k, v in held.items()])
    return run


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The set of all files below a folder; empty if it does not exist."""
    uri = qualified(spark, path)
    folders = spark.createDataFrame([("",)], "folder string")
    levels: DataFrame | None = None
    while True:
        n = max(1, min(folders.count(), spark.sparkContext.defaultParallelism * 4))
        found = materialise(folders.repartition(n).mapInArrow(_list_folders(uri), f"kind string, {SET}"), "listing")
        own = found.where("kind = 'set'").drop("kind")
        levels = own if levels is None else levels.unionByName(own)
        folders = found.where("kind = 'folder'").select("folder")
        if not folders.limit(1).count():
            return levels


# --- single files, for what is listed by name --------------------------------------------------

FILES = "path string, length long, modified timestamp"


def _walk(uri: str, shown: str, recursive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        files, root = pafs.FileSystem.from_uri(uri)
        stamp = pa.timestamp("us", "UTC")

        def out(kind: str, rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.string()), pa.array(columns[0], pa.string()),
                                               pa.array(columns[1], pa.int64()), pa.array(columns[2], stamp)],
                                              ["kind", "path", "length", "modified"])
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                where = f"{root}/{folder}" if folder else root
                own = files.get_file_info(where)
                if own.type == pafs.FileType.File:
                    yield out("file", [(shown, own.size, own.mtime_ns // 1000)])
                    continue
                found = files.get_file_info(pafs.FileSelector(where, allow_not_found=True))
                found = [i for i in found if not i.base_name.startswith((".", "_"))]
                below = f"{folder}/" if folder else ""
                yield out("file", [(f"{shown}/{below}{i.base_name}", i.size, i.mtime_ns // 1000) for i in found if i.type == pafs.FileType.File])
                if recursive:
                    yield out("folder", [(f"{below}{i.base_name}", None, None) for i in found if i.type == pafs.FileType.Directory])
    return run


def files_below(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, modified) of the files in a folder, listed by tasks; hidden ones are left out."""
    uri = qualified(spark, path)
    # Paths as Spark shows them.
    shown = re.sub(r"^file:/+", "file:/", uri)
    folders = spark.createDataFrame([("",)], "path string")
    every: DataFrame | None = None
    while True:
        n = max(1, min(folders.count(), spark.sparkContext.defaultParallelism * 4))
        found = materialise(folders.repartition(n).mapInArrow(_walk(uri, shown, recursive), f"kind string, {FILES}"), "files")
        own = found.where("kind = 'file'").drop("kind")
        every = own if every is None else every.unionByName(own)
        folders = found.where("kind = 'folder'").select("path")
        if not folders.limit(1).count():
            return every
