"""Clip lists and probe reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from framesift import params as P
from framesift.functions.text import extension, file_stem, parsed_once
from framesift.sources import file_sets

PROBE = T.StructType([
    T.StructField("streams", T.ArrayType(T.StructType([
        T.StructField("codec_name", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("r_frame_rate", T.StringType()),
        T.StructField("nb_frames", T.StringType()),
        T.StructField("duration", T.StringType()),
    ]))),
    T.StructField("format", T.StructType([T.StructField("duration", T.StringType())])),
])


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length, modified) of the files below `path`, without their content.

    Folders are listed by tasks, so the driver holds no names.
    """
    return file_sets.files_below(spark, path, recursive)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def expand_inputs(listing: DataFrame, inputs: DataFrame) -> DataFrame:
    """Clip files in input order: a folder stands for the videos directly in it,
    a file for itself whatever its extension.

    `listing`: (path); `inputs`: (input_pos, input).
    """
    files = listing.select("path", _folder(F.col("path")).alias("folder"))
    videos = files.filter(extension(F.col("path")).isin(*P.VIDEO_EXTENSIONS))
    inside = inputs.join(videos, inputs["input"] == videos["folder"]).select("input_pos", "path")
    named = inputs.join(files, inputs["input"] == files["path"]).select("input_pos", "path")
    return inside.unionByName(named)


def missing_inputs(listing: DataFrame, inputs: DataFrame) -> DataFrame:
    """Inputs that are neither a file nor a folder with files in it."""
    known = listing.select(F.col("path").alias("input")).unionByName(
        listing.select(_folder(F.col("path")).alias("input")))
    return inputs.join(known, "input", "left_anti")


def require_inputs(listing: DataFrame, inputs: DataFrame) -> DataFrame:
    """Expanded inputs, or an error naming what is missing."""
    gone = missing_inputs(listing, inputs).orderBy("input_pos").limit(1).collect()
    if gone:
        raise ValueError(f"no such input: {gone[0].input}")
    files = expand_inputs(listing, inputs)
    if not files.limit(1).count():
        raise ValueError("the inputs hold no video files")
    return files



def _rate(text: Column) -> Column:
    """`n/d` as a number; anything else, or d <= 0, is 0."""
    n = F.substring_index(text, "/", 1).try_cast("double")
    d = F.expr("substr(rate, instr(rate, '/') + 1)").try_cast("double")
    return F.when(text.contains("/") & (d > 0) & n.isNotNull(), F.try_divide(n, d)).otherwise(F.lit(0.0))


def probe_clips(reports: DataFrame) -> DataFrame:
    """Probe reports (path, report JSON) as clips; `error` says why one is refused."""
    parsed = reports.select(
        "path", parsed_once(F.from_json("report", PROBE)).alias("r"))
    flat = parsed.select(
        "path",
        F.get(F.col("r.streams"), 0).isNotNull().alias("has_stream"),
        F.get(F.col("r.streams"), 0).alias("s"),
        F.col("r.format.duration").alias("format_duration"),
    ).select(
        "path", "has_stream",
        F.coalesce(F.col("s.width"), F.lit(0)).cast("int").alias("width"),
        F.coalesce(F.col("s.height"), F.lit(0)).cast("int").alias("height"),
        F.col("s.r_frame_rate").alias("rate"),
        F.col("s.codec_name").alias("codec"),
        F.col("s.nb_frames").try_cast("long").alias("nb_frames"),
        F.coalesce(F.col("s.duration").try_cast("double"),
                   F.col("format_duration").try_cast("double")).alias("duration_s"),
    ).withColumn("fps", F.coalesce(_rate(F.col("rate")), F.lit(0.0)))
    counted = F.when(F.col("nb_frames") >= 0, F.col("nb_frames"))
    estimated = F.when(F.col("fps") > 0, F.round(F.col("duration_s") * F.col("fps")).cast("long"))
    return flat.select(
        "path", file_stem(F.col("path")).alias("stem"), "width", "height", "fps",
        F.coalesce(counted, estimated).alias("frames"), "codec", "duration_s",
        F.when(~F.col("has_stream"), "no video stream")
        .when((F.col("width") == 0) | (F.col("height") == 0), "video size unknown")
        .when(F.col("fps") >= P.FPS_REFUSED, "frame rate refused").alias("error"))
