"""Image files in and out of frame tables."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from framesift import params as P
from framesift.functions import png
from framesift.functions.arrays import binary_from_rows, byte_rows
from framesift.functions.text import image_name, mask_path
from framesift.session import materialise, qualified, scratch_path, shared_dir
from framesift.sources import file_sets


# --- reading ---------------------------------------------------------------------------

@F.arrow_udf(T.BinaryType())
def _to_rgb(data: pa.Array, channels: pa.Array) -> pa.Array:
    """Stored BGR, BGRA or gray bytes as interleaved RGB."""
    out = []
    for v, n in zip(byte_rows(data), channels.to_pylist()):
        if n is None:
            out.append(None)
        elif n == 1:
            out.append(np.repeat(v, 3))
        else:
            out.append(v.reshape(-1, n)[:, 2::-1])
    return binary_from_rows(out)


@F.arrow_udf(T.BinaryType())
def _first_channel(data: pa.Array, channels: pa.Array) -> pa.Array:
    return binary_from_rows([None if n is None else v.reshape(-1, n)[:, 0]
                             for v, n in zip(byte_rows(data), channels.to_pylist())])


def _image_rows(spark: SparkSession, path: str) -> DataFrame:
    origin = F.col("image.origin")
    return (
        spark.read.format("image").option("dropInvalid", "false").load(path)
        .select(F.regexp_extract(origin, r"([^/]*)_[0-9]+(?:\.[^./]*)+$", 1).alias("stem"),
                F.regexp_extract(origin, r"_([0-9]+)(?:\.[^./]*)+$", 1).try_cast("long").alias("frame_index"),
                F.col("image.width").alias("width"), F.col("image.height").alias("height"),
                F.col("image.nChannels").alias("_n"), F.col("image.data").alias("_data"))
    )


def read_image_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames from image files named `stem_000123.ext`: (stem, frame_index, width,
    height, rgb)."""
    return _image_rows(spark, path).withColumn("rgb", _to_rgb("_data", "_n")).drop("_data", "_n")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Mask sidecars: (stem, frame_index, width, height, mask)."""
    return _image_rows(spark, path).withColumn("mask", _first_channel("_data", "_n")).drop("_data", "_n")


def require_frames(frames: DataFrame, clips: DataFrame, key: str = "stem") -> DataFrame:
    """The frames, or an error naming a clip that has none."""
    empty = clips.join(frames.select(key), key, "left_anti").orderBy(key).limit(1).collect()
    if empty:
        raise ValueError(f"{empty[0][key]}: no frames")
    return frames


# --- writing ---------------------------------------------------------------------------

FILES = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("pixels", T.BinaryType()),
])


def _pillow():
    try:
        from PIL import Image
    except ImportError:
        return None
    return Image


def _encode(name: str, pixels: np.ndarray, quality: int) -> bytes:
    if name.endswith(".png"):
        return png.encode(pixels)
    image = _pillow()
    if image is None:
        raise RuntimeError("writing JPEG needs Pillow on the executors; use format png")
    out = io.BytesIO()
    image.fromarray(pixels).save(out, "JPEG", quality=min(max(quality, 1), 100))
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    files: int


class ImageWriter(DataSourceArrowWriter):
    """Each task writes its own rows; nothing passes through the driver but counts.

    Names are fixed by clip and frame number, and a file appears whole or not at
    all, so a task that runs twice leaves the same files.  What is not finished yet
    has a name of its own attempt, and goes when the attempt fails.
    """

    def __init__(self, path: str, quality: int):
        self.path, self.quality = path, quality

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import fs as pafs
        files, root = pafs.FileSystem.from_uri(self.path)
        whole_on_close = not isinstance(files, (pafs.LocalFileSystem, pafs.HadoopFileSystem))
        made: set[str] = set()
        count, attempt = 0, uuid.uuid4().hex
        for batch in batches:
            pixels = byte_rows(batch.column("pixels"))
            for name, w, h, v in zip(batch.column("file").to_pylist(), batch.column("width").to_pylist(),
                                     batch.column("height").to_pylist(), pixels):
                shape = (h, w) if v.size == w * h else (h, w, 3)
                if v.size not in (w * h, w * h * 3):
                    raise ValueError(f"{name}: {v.size} bytes do not fill {w}x{h}")
                target = f"{root}/{name}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                body = _encode(name, v.reshape(shape), self.quality)
                at = target if whole_on_close else f"{folder}/._{attempt}_{name.rsplit('/', 1)[-1]}.part"
                try:
                    with files.open_output_stream(at) as out:
                        out.write(body)
                    if at != target:
                        files.move(at, target)
                except BaseException:
                    if at != target and files.get_file_info(at).type != pafs.FileType.NotFound:
                        files.delete_file(at)
                    raise
                count += 1
        return Written(count)

    def commit(self, messages) -> None:
        return None

    def abort(self, messages) -> None:
        """Nothing to undo: finished files are whole and are written again under the same names."""
        return None


class FrameFiles(DataSource):
    """`df.write.format("frame_files").option("path", ...)`, rows as in `FILES`."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self):
        return FILES

    def writer(self, schema, overwrite):
        return ImageWriter(self.options["path"], int(self.options.get("quality", P.JPEG_QUALITY)))


def register_sink(spark: SparkSession) -> None:
    """Make `frame_files` known to a session, once."""
    try:
        spark.dataSource.register(FrameFiles)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


#: Set to `true` where executors and driver mount the same local paths.
SHARED_PATHS = "spark.framesift.sharedLocalPaths"


def target_uri(spark: SparkSession, path: str) -> str:
    """Where Spark would write the path.  On a cluster a local path is refused: every
    executor would write to its own disk.  What lies in `spark.checkpoint.dir` is seen by all of them."""
    uri = qualified(spark, path)
    if uri.startswith("file:") and not re.match(r"local(\[|$)", spark.sparkContext.master) \
            and spark.conf.get(SHARED_PATHS, "false") != "true" \
            and not uri.startswith(f"{qualified(spark, shared_dir(spark))}/"):
        raise ValueError(f"{uri} is local to each machine; name a shared file system, or set {SHARED_PATHS}")
    return uri


def _write(rows: DataFrame, path: str, quality: int) -> None:
    spark = rows.sparkSession
    register_sink(spark)
    (rows.select("file", F.col("width").cast("int").alias("width"),
                 F.col("height").cast("int").alias("height"), "pixels")
     .write.format("frame_files").mode("append").option("path", target_uri(spark, path))
     .option("quality", quality).save())


def remove_files(names: DataFrame, path: str) -> int:
    """Delete files below `path` by their names (column `path`), each task its own; how many were there."""
    uri = target_uri(names.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        files, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            gone = 0
            for name in batch.column(0).to_pylist():
                if files.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                    files.delete_file(f"{root}/{name}")
                    gone += 1
            yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], ["gone"])
    return names.select("path").mapInArrow(run, "gone long").agg(F.sum("gone")).first()[0] or 0


def write_images(frames: DataFrame, path: str, ext: str = "png", quality: int = P.JPEG_QUALITY) -> None:
    """One image per frame (stem, frame_index, width, height, rgb)."""
    if ext not in ("png", "jpg"):
        raise ValueError(f"unknown image format {ext}")
    if ext == "jpg" and _pillow() is None:
        raise RuntimeError("writing JPEG needs Pillow; use format png")
    name = image_name(F.col("stem"), F.col("frame_index"), ext)
    _write(frames.select(name.alias("file"), "width", "height", F.col("rgb").alias("pixels")), path, quality)


def write_masks(masks: DataFrame, path: str, ext: str = "png") -> None:
    """Gray PNG sidecars (stem, frame_index, sidecar, width, height, mask) at output size.

    `ext` is the extension of the images they belong to.
    """
    name = image_name(F.col("stem"), F.col("frame_index"), ext)
    file = F.when(F.col("sidecar") == "training", mask_path(P.SIDECAR_DIRS["training"], name)) \
        .otherwise(mask_path(P.SIDECAR_DIRS["sfm"], name))
    _write(masks.select(file.alias("file"), "width", "height", F.col("mask").alias("pixels")),
           path, P.JPEG_QUALITY)


BROADCAST_LIMIT = 256 << 20
#: Name of the column that frames are stored by besides their clip: their stretch of frame numbers.
STORED_BY = "_stretch"


class FrameStore:
    """Frames stored in buckets of (clip, stretch of frame numbers).

    What is joined with them by these two is brought to the buckets; the frames stay where they are, at any size of
    either.  A clip of any length lies in many buckets.  The files are plain Parquet; `FrameStore.open` finds the
    buckets again in another session.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self._table = f"frames_{uuid.uuid5(uuid.NAMESPACE_URL, qualified(spark, path)).hex}"

    @classmethod
    def write(cls, frames: DataFrame, path: str, key: str = "clip_id", buckets: int | None = None) -> FrameStore:
        """Each task writes the frames it holds; nothing is exchanged."""
        spark = frames.sparkSession
        store = cls(spark, path, key, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.sql(f"DROP TABLE IF EXISTS {store._table}")
        (frames.withColumn(STORED_BY, file_sets.stretch_of()).write.format("parquet").mode("overwrite")
         .bucketBy(store.buckets, key, STORED_BY).option("path", path).saveAsTable(store._table))
        note = spark.createDataFrame([(key, store.buckets)], "key string, buckets int")
        note.coalesce(1).write.mode("overwrite").json(f"{path}/_store")
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FrameStore:
        note = spark.read.schema("key string, buckets int").json(f"{path}/_store").first()
        store = cls(spark, path, note.key, note.buckets)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {store._table} ({columns}) USING parquet "
                  f"CLUSTERED BY (`{store.key}`, `{STORED_BY}`) INTO {store.buckets} BUCKETS LOCATION '{qualified(spark, path)}'")
        return store

    def frames(self) -> DataFrame:
        return self.spark.table(self._table).drop(STORED_BY)

    def kept(self, decisions: DataFrame) -> DataFrame:
        """The kept frames.  Their bitmaps go to the buckets."""
        marks, span = _kept_marks(decisions, self.key)
        rows = self.spark.table(self._table)
        if span.size is None:
            return self.frames().where(F.lit(False))
        near = rows.where(_within(self.key, span))
        # Bitmaps are what is hashed, so frames are not sorted either.
        found = near.join(marks.select(self.key, STORED_BY, "_bits").hint("SHUFFLE_HASH"), [self.key, STORED_BY])
        return found.where(_is_marked()).select(*self.frames().columns)


def _kept_marks(decisions: DataFrame, key: str) -> tuple[DataFrame, Row]:
    """Kept frames as stored bitmaps, one bit per frame of a stretch, and what they span."""
    kept = decisions.filter("keep").select(key, "frame_index")
    marks = materialise(
        kept.groupBy(key, file_sets.stretch_of().alias(STORED_BY))
        .agg(file_sets.bits_of().alias("_bits"), F.min("frame_index").alias("_from"), F.max("frame_index").alias("_to")), "kept")
    span = marks.agg(
        F.sum(F.octet_length("_bits") + 64).alias("size"), F.min(key).alias("low"), F.max(key).alias("high"),
        F.min("_from").alias("first"), F.max("_to").alias("last")).first()
    return marks, span


def _within(key: str, span: Row) -> Column:
    """The clips and frames that bitmaps span; this reaches the scan as filters."""
    return F.col(key).between(span.low, span.high) & F.col("frame_index").between(span.first, span.last)


def _is_marked() -> Column:
    # Past the end of a cut bitmap the byte is empty and the test NULL: not kept.
    place = f"int(frame_index % {file_sets.STRETCH})"
    byte = f"int(conv(hex(substring(_bits, int({place} div 8) + 1, 1)), 16, 10))"
    return F.expr(f"shiftright({byte}, {place} % 8) & 1") == 1


def kept_only(frames: DataFrame | FrameStore, decisions: DataFrame, key: str = "clip_id",
              limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Pixels of the kept frames, joined late so that pixels pass no ordered stage and no exchange.

    Kept frames become bitmaps, one bit per frame of a clip.  Of a `FrameStore` they are brought to its buckets.  Frames that
    are not stored are met by a broadcast of bitmaps that fit `limit`; beyond that they are stored first.
    """
    if isinstance(frames, FrameStore):
        return frames.kept(decisions)
    marks, span = _kept_marks(decisions, key)
    if span.size is None:
        return frames.filter(F.lit(False))
    near = frames.filter(_within(key, span))
    if span.size > limit:
        return FrameStore.write(near, scratch_path(frames.sparkSession, "stored"), key).kept(decisions)
    return (near.withColumn(STORED_BY, file_sets.stretch_of())
            .join(F.broadcast(marks.select(key, STORED_BY, "_bits")), [key, STORED_BY])
            .filter(_is_marked()).select(*frames.columns))


def frames_to_table(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store frames as Parquet clustered by clip and frame number.

    Range clustering keeps files even when one clip is most of the data, and lets
    a reader of one clip or one stretch skip the rest by file statistics.
    """
    (frames.repartitionByRange("clip_id", "frame_index")
     .sortWithinPartitions("clip_id", "frame_index").write.mode(mode).parquet(path))
