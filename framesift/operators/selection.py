"""Which frames of a clip to keep: one decision per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framesift import params as P
from framesift.operators.ordering import index_bucket, running_sum


def passes_floor(floor: float | None, sharpness: str = "sharpness") -> Column:
    """False for frames blurrier than `floor`; equal and NaN pass, no floor passes all."""
    if floor is None:
        return F.lit(True)
    return ~(F.col(sharpness) < F.lit(float(floor)))


def blur_floor(frames: DataFrame, floor: float | None) -> DataFrame:
    """Mark each frame as judged further (`passes`) or dropped for blur."""
    return frames.withColumn("passes", passes_floor(floor))


def every_nth(frames: DataFrame, n: int = P.EVERY_NTH, floor: float | None = None,
              segment: int = P.SEGMENT_FRAMES) -> DataFrame:
    """Keep the 1st, n+1st, ... of the frames that pass the floor, per clip."""
    if n < 1:
        raise ValueError("every-nth needs n >= 1")
    judged = blur_floor(frames, floor).select(
        "clip_id", "frame_index", F.col("passes").cast("long").alias("passes"))
    counted = running_sum(judged, ["clip_id"], "frame_index", "passes",
                          index_bucket("frame_index", segment), "seen")
    return counted.select(
        "clip_id", "frame_index",
        ((F.col("passes") == 1) & ((F.col("seen") - 1) % n == 0)).alias("keep"))


def window_sharpest(frames: DataFrame, *keys: str) -> DataFrame:
    """The sharpest frame of each group; the latest one on ties, NaN above all."""
    best = F.max(F.struct("sharpness", "frame_index")).alias("best")
    return frames.groupBy(*keys).agg(best).select(
        *keys, F.col("best.frame_index").alias("frame_index"),
        F.col("best.sharpness").alias("sharpness"))


def kept_chunks(decisions: DataFrame, chunk: int = P.KEPT_CHUNK) -> DataFrame:
    """Sorted kept lists, at most `chunk` frame numbers wide per row.

    A clip of any length stays a number of bounded rows, so a list is never
    gathered into one task.
    """
    return (
        decisions.filter("keep")
        .groupBy("clip_id", index_bucket("frame_index", chunk).alias("chunk"))
        .agg(F.array_sort(F.collect_list("frame_index")).alias("kept_frames"))
    )


def zero_kept_guard(decisions: DataFrame) -> None:
    """A whole run that keeps nothing is an error; a single clip is not."""
    if not decisions.filter("keep").limit(1).count():
        raise ValueError("no frame was kept in the whole run; the thresholds leave nothing")
