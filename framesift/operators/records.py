"""Per-clip records and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def clip_record(decisions: DataFrame) -> DataFrame:
    """Decoded and kept counts per clip.

    The kept list itself is stored by `selection.kept_chunks`; only numbers meet
    here, so a clip of any length is one small partial aggregate per task.
    """
    kept = F.when(F.col("keep"), F.col("frame_index"))
    return decisions.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("frames_decoded"),
        F.count_if("keep").alias("frames_kept"),
        F.min(kept).alias("first_kept"),
        F.max(kept).alias("last_kept"))


def rate(n: Column, wall: Column) -> Column:
    return F.when(wall > 0, F.try_divide(n, wall)).otherwise(F.lit(0.0))


def run_totals(clips: DataFrame, *keys: str) -> DataFrame:
    """Totals per run; rates cover only what this invocation did.

    `clips`: (frames_decoded, frames_kept, carried, wall_seconds).
    """
    carried = F.col("carried")
    totals = clips.groupBy(*keys).agg(
        F.sum("frames_decoded").alias("decoded"),
        F.sum("frames_kept").alias("kept"),
        F.sum(F.when(carried, F.col("frames_decoded")).otherwise(0)).alias("carried_decoded"),
        F.sum(F.when(carried, F.col("frames_kept")).otherwise(0)).alias("carried_written"),
        F.count_if(carried).alias("carried_clips"),
        F.max("wall_seconds").alias("wall_seconds"))
    wall = F.col("wall_seconds")
    return totals.select(
        *keys, "decoded", "kept", F.col("kept").alias("written"), "carried_clips", "wall_seconds",
        rate(F.col("decoded") - F.col("carried_decoded"), wall).alias("decoded_fps"),
        rate(F.col("kept") - F.col("carried_written"), wall).alias("written_fps"))


def progress_rates(progress: DataFrame) -> DataFrame:
    """Decode rate of this invocation and time left for the current clip.

    The time is NULL while the clip length is unknown or nothing is decoded.
    """
    fps = F.col("decoded_this_run") / F.greatest(F.col("elapsed_s"), F.lit(1e-9))
    total, done = F.col("clip_total_frames"), F.col("clip_decoded")
    left = F.greatest(total - done, F.lit(0))
    eta = F.when((done > 0) & (total > 0), left / F.greatest(F.col("decode_fps"), F.lit(1e-9)))
    return progress.withColumn("decode_fps", fps).withColumn("eta_s", eta)
