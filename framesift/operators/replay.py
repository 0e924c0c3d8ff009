"""Replaying a recorded selection: joins on (stem, frame number)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framesift.sources.images import kept_only


def recorded_counts(manifest_clips: DataFrame) -> DataFrame:
    """(stem, recorded): how many frames each stem's list has; of clips that share a stem the last one counts.

    A list may come whole or in chunks, as several rows of one position.  Only its length is taken, row by row, so
    what is aggregated is a number however long lists are.
    """
    length = F.when(F.col("kept_frames").isNotNull(), F.size("kept_frames").cast("long"))
    lists = manifest_clips.select("stem", "position", length.alias("n")).groupBy("stem", "position").agg(F.sum("n").alias("n"))
    return lists.groupBy("stem").agg(F.max_by("n", "position").alias("recorded"))


def replay_selection(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """One decision per frame: keep exactly the recorded ones.

    No metric is read.  The join key is unique on both sides, so a long clip
    spreads over all tasks.
    """
    marks = kept.select("stem", "frame_index", F.lit(True).alias("_kept"))
    return frames.join(marks, ["stem", "frame_index"], "left").select(
        "clip_id", "stem", "frame_index", F.coalesce("_kept", F.lit(False)).alias("keep"))


def replayed(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Only the frames to write again, with their pixels."""
    return kept_only(frames, kept.withColumn("keep", F.lit(True)), "stem")


def replay_missing(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """Stems whose recorded frames the clip never produced: missing of total."""
    have = frames.select("stem", "frame_index", F.lit(1).alias("_have"))
    return (
        kept.join(have, ["stem", "frame_index"], "left")
        .groupBy("stem")
        .agg(F.count_if(F.col("_have").isNull()).alias("missing"), F.count(F.lit(1)).alias("total"))
        .filter("missing > 0")
        .withColumn("message", F.format_string(
            "%d of %d recorded frames were not found", "missing", "total"))
    )


def replay_preflight(clips: DataFrame, manifest_clips: DataFrame) -> DataFrame:
    """Clips without a recorded list cannot be replayed; `problem` names them."""
    return clips.join(recorded_counts(manifest_clips), "stem", "left").select(
        "clip_id", "stem",
        F.coalesce("recorded", F.lit(0)).cast("int").alias("recorded"),
        F.when(F.coalesce("recorded", F.lit(0)) == 0,
               F.concat(F.lit("no kept frames recorded for clip "), F.col("stem"))).alias("problem"))
