"""Run manifests: nested JSON documents in, tables out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from framesift import params as P
from framesift.functions.text import parsed_once, plain_number
from framesift.operators.ordering import dense_index, index_bucket
from framesift.session import exists, file_system

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MASKING = _struct(
    sidecars=T.MapType(_S, _S),
    classes=T.ArrayType(_struct(name=_S, source=_S, written_to=T.ArrayType(_S), params=_S)),
    note=_S,
)

PARAMS = _struct(
    output_size=_struct(kind=_S, factor=_D, width=_I, height=_I),
    format=_struct(format=_S, quality=_I),
    selection=_struct(
        mode=_struct(mode=_S, n=_L, motion_threshold=_D, window=_L, source=_S), blur_floor=_D),
    hwaccel=_S,
    interpolation=_S,
    gpu=_B,
    masking=MASKING,
)

CLIP = _struct(
    path=_S, stem=_S, width=_I, height=_I, fps=_D, frames_probed=_L, frames_decoded=_L,
    frames_kept=_L, out_width=_I, out_height=_I, pinhole_intrinsics=T.ArrayType(_D),
    kept_frames=T.ArrayType(_L),
)

TOTALS = _struct(decoded=_L, kept=_L, written=_L, wall_seconds=_D, decoded_fps=_D, written_fps=_D)

MANIFEST = _struct(
    tool=_S, tool_version=_S, ffmpeg_version=_S, created_unix=_L, completed=_B,
    profile=_struct(path=_S, name=_S, sha256=_S),
    params=PARAMS, clips=T.ArrayType(CLIP), totals=TOTALS,
)


def with_defaults(manifests: DataFrame) -> DataFrame:
    """Fill what older manifests leave out: completed, gpu and the kept lists.

    A missing `masking` stays NULL, which means nothing was masked.
    """
    none_kept = F.array().cast("array<bigint>")
    return (
        manifests
        .withColumn("completed", F.coalesce("completed", F.lit(True)))
        .withColumn("params", F.col("params").withField(
            "gpu", F.coalesce(F.col("params.gpu"), F.lit(False))))
        .withColumn("clips", F.transform("clips", lambda c: c.withField(
            "kept_frames", F.coalesce(c["kept_frames"], none_kept))))
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files, one document each.  A malformed one is an error."""
    raw = (spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path))
    return with_defaults(raw)


def read_manifest_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """NULL result when nothing is there yet."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return read_manifests(spark, path) if fs.exists(where) else None


def parse_manifests(documents: DataFrame, key: str) -> DataFrame:
    """The same from a JSON text column `document`."""
    m = parsed_once(F.from_json("document", MANIFEST, {"mode": "FAILFAST"}))
    return with_defaults(documents.select(key, m.alias("m")).select(key, "m.*"))


def manifest_clips(manifests: DataFrame, *keys: str) -> DataFrame:
    """Clip records with their position in the manifest."""
    return manifests.select(*keys, F.posexplode("clips").alias("position", "c")).select(
        *keys, "position", "c.*")


# --- cameras ---------------------------------------------------------------------

CAMERA_HEADER = (
    "# Camera list with one line of data per camera:",
    "#   CAMERA_ID, MODEL, WIDTH, HEIGHT, PARAMS[]",
    "# Images are undistorted already: keep these intrinsics, do not estimate distortion again.",
)


def camera_rows(clips: DataFrame, order: str, bucket: Column | None = None) -> DataFrame:
    """One camera per clip with intrinsics (fx, fy, cx, cy).  The id is the clip's
    1-based position among all clips, with or without intrinsics."""
    numbered = dense_index(clips, [], [order], bucket if bucket is not None
                           else index_bucket(order, P.SEGMENT_FRAMES), "camera_id", start=1)
    values = ["fx", "fy", "cx", "cy"]
    return numbered.filter("fx is not null").select(
        "camera_id", "stem",
        F.concat_ws(" ", F.col("camera_id").cast("string"), F.lit("PINHOLE"),
                    F.col("out_w").cast("string"), F.col("out_h").cast("string"),
                    *[plain_number(v) for v in values]).alias("line"))


def camera_lines(cameras: DataFrame) -> DataFrame:
    """The lines of the camera file in order; empty when no clip has intrinsics."""
    spark = cameras.sparkSession
    header = spark.createDataFrame(
        [(0, i, t) for i, t in enumerate(CAMERA_HEADER)], "camera_id long, part int, value string")
    note = F.format_string("# %d: images %s_*", "camera_id", "stem")
    body = cameras.select(
        F.col("camera_id").cast("long").alias("camera_id"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("part"), note.alias("value")),
            F.struct(F.lit(1).alias("part"), F.col("line").alias("value")))).alias("_l"),
    ).select("camera_id", "_l.part", "_l.value")
    return header.unionByName(body).orderBy("camera_id", "part")


def write_cameras(cameras: DataFrame, path: str) -> bool:
    """Write the camera file; nothing is written when there is no camera.

    Lines are range-sorted, so the part files read in order are the document;
    a small one is a single part.
    """
    if not cameras.limit(1).count():
        return False
    camera_lines(cameras).select("value").write.mode("overwrite").text(path)
    return True


# --- a run's manifest as tables ----------------------------------------------------------
#
# `runs` holds a row per invocation, written before its first image; `clips` one
# record per finished clip, `kept` its frame numbers in bounded chunks, `finished`
# a row per completed invocation.  All are plain Parquet under (run_id, batch), so a
# run of any size is written and read in parallel, and nothing is ever rewritten: an
# invocation takes batches that no earlier one has used.  Writing the same batch of
# the same run again replaces it.


def _write_batch(df: DataFrame, path: str, run_id: str, batch: int) -> None:
    (df.withColumn("run_id", F.lit(run_id)).withColumn("batch", F.lit(batch))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id", "batch").parquet(path))


def start_run(run: DataFrame, path: str, run_id: str, batch: int = 0, since: int = 0) -> None:
    """Write an invocation's own row: its parameters, and the first batch whose records count."""
    _write_batch(run.withColumn("since", F.lit(since)), f"{path}/runs", run_id, batch)


def record_clips(clips: DataFrame, kept: DataFrame, path: str, run_id: str, batch: int = 0) -> None:
    """Record finished clips: kept lists first, so a listed clip always has its list.

    Call it after the clips' images are written; the record is never ahead of the
    files.  `kept`: chunks as `selection.kept_chunks` makes them.
    """
    _write_batch(kept, f"{path}/kept", run_id, batch)
    _write_batch(clips, f"{path}/clips", run_id, batch)


def stage_decisions(decided: DataFrame, path: str, run_id: str, batch: int) -> None:
    """What a stream decided in a batch, if only that it was nothing, while the batch is worked on."""
    decided.write.mode("overwrite").parquet(f"{path}/staged/run_id={run_id}/batch={batch}")


def staged_decisions(spark: SparkSession, path: str, run_id: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/staged/run_id={run_id}/batch={batch}")


def drop_staged(spark: SparkSession, path: str, run_id: str, before: int) -> None:
    """Forget the batches before this one, whose work is done."""
    for batch in _batches(spark, f"{path}/staged", run_id):
        if batch < before:
            folder = f"{path}/staged/run_id={run_id}/batch={batch}"
            file_system(spark, folder).delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def finish_run(totals: DataFrame, path: str, run_id: str, batch: int = 0) -> None:
    """Mark the invocation that began with this batch as complete, with its totals."""
    _write_batch(totals, f"{path}/finished", run_id, batch)


def _recorded(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    if not exists(spark, f"{path}/run_id={run_id}"):
        return None
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)


def _batches(spark: SparkSession, path: str, run_id: str) -> list[int]:
    """The batches a table holds of a run, from its folders."""
    folder = f"{path}/run_id={run_id}"
    if not exists(spark, folder):
        return []
    found = file_system(spark, folder).listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))
    names = [f.getPath().getName() for f in found]
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def last_run(spark: SparkSession, path: str, run_id: str) -> tuple[int, int] | None:
    """(batch, since) of the last invocation, complete or not; None if there was none."""
    begun = _batches(spark, f"{path}/runs", run_id)
    if not begun:
        return None
    row = spark.read.parquet(f"{path}/runs/run_id={run_id}/batch={begun[-1]}").select("since").first()
    return (begun[-1], row.since) if row is not None else None


def next_batch(spark: SparkSession, path: str, run_id: str) -> int:
    return max([-1, *(b for table in ("runs", "kept", "clips") for b in _batches(spark, f"{path}/{table}", run_id))]) + 1


def recorded_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The last invocation's row with `completed`, and `totals` if it is."""
    rows = _recorded(spark, f"{path}/runs", run_id)
    if rows is None:
        raise ValueError(f"{path} holds no run {run_id}")
    batch = last_run(spark, path, run_id)[0]
    row = rows.filter(F.col("batch") == batch)
    done = _recorded(spark, f"{path}/finished", run_id)
    if done is None:
        return row.withColumn("completed", F.lit(False)).withColumn("totals", F.lit(None).cast(TOTALS))
    totals = done.filter(F.col("batch") == batch).select("run_id", F.struct(
        *[F.col(c) for c in done.columns if c not in ("run_id", "batch")]).alias("totals"))
    return row.join(totals, "run_id", "left").withColumn("completed", F.col("totals").isNotNull())


def recorded_clips(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """The record of each clip that counts: the last one since the dataset was begun."""
    rows = _recorded(spark, f"{path}/clips", run_id)
    if rows is None:
        return None
    last = last_run(spark, path, run_id)
    rows = rows.filter(F.col("batch") >= (last[1] if last else 0))
    newest = rows.groupBy("clip_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["clip_id", "batch"])


def recorded_kept(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """The chunks of the kept lists that belong to these records."""
    rows, clips = _recorded(spark, f"{path}/kept", run_id), recorded_clips(spark, path, run_id)
    if rows is None or clips is None:
        return None
    return rows.join(clips.select("clip_id", "batch"), ["clip_id", "batch"], "left_semi")


def superseded_kept(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """(stem, frame_index) of everything that any record of the run ever listed."""
    rows, clips = _recorded(spark, f"{path}/kept", run_id), _recorded(spark, f"{path}/clips", run_id)
    if rows is None or clips is None:
        return None
    return (rows.select("clip_id", "batch", F.explode("kept_frames").alias("frame_index"))
            .join(clips.select("clip_id", "batch", "stem"), ["clip_id", "batch"]).select("clip_id", "stem", "frame_index"))


# --- the single document other tools read -------------------------------------------------

def manifest_lines(header: DataFrame, clips: DataFrame, kept: DataFrame, totals: DataFrame) -> DataFrame:
    """The manifest document of one run as ordered lines.

    A clip's kept list is spread over lines of bounded length, so neither a clip
    nor the document is ever built in one task.

    `header`, `totals`: one row each; `clips`: (clip_id, position, ...record
    fields); `kept`: chunks as `selection.kept_chunks` makes them.
    """
    keep_nulls = {"ignoreNullFields": "false"}
    end = (1 << 62)
    head = header.select(
        F.lit(-1).cast("long").alias("position"), F.lit(0).cast("long").alias("part"),
        F.regexp_replace(F.to_json(F.struct("*"), keep_nulls), r"\}$", ',"clips":[').alias("value"))
    first = clips.agg(F.min("position")).scalar()
    last_fields = [f.name for f in CLIP.fields if f.name != "kept_frames" and f.name in clips.columns]
    opening = F.regexp_replace(
        F.to_json(F.struct(*last_fields), keep_nulls), r"\}$", ',"kept_frames":[')
    opened = clips.select(
        F.col("position").cast("long").alias("position"), F.lit(-1).cast("long").alias("part"),
        F.concat(F.when(F.col("position") > first, ",").otherwise(""), opening).alias("value"))
    closed = clips.select(
        F.col("position").cast("long").alias("position"), F.lit(end).alias("part"),
        F.lit("]}").alias("value"))
    starts = kept.groupBy("clip_id").agg(F.min("chunk").alias("_start"))
    chunks = (kept.join(starts, "clip_id").join(clips.select("clip_id", "position"), "clip_id")
              .select(F.col("position").cast("long").alias("position"),
                      F.col("chunk").cast("long").alias("part"),
                      F.concat(F.when(F.col("chunk") > F.col("_start"), ",").otherwise(""),
                               F.array_join(F.col("kept_frames").cast("array<string>"), ",")).alias("value")))
    foot = totals.select(
        F.lit(end).alias("position"), F.lit(0).cast("long").alias("part"),
        F.concat(F.lit('],"totals":'), F.to_json(F.struct("*"), keep_nulls), F.lit("}")).alias("value"))
    lines = head.unionByName(opened).unionByName(chunks).unionByName(closed).unionByName(foot)
    return lines.orderBy("position", "part")


def write_manifest(lines: DataFrame, path: str) -> None:
    """Replace the manifest document at `path`.

    The part files read in order are the document; a small one is a single part,
    which `read_manifests` takes back as it is.
    """
    lines.select("value").write.mode("overwrite").text(path)
