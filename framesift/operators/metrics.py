"""Frame metrics and the fused per-frame judgement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from framesift import params as P
from framesift.functions import pixels
from framesift.functions.arrays import binary_from_rows, byte_rows
from framesift.operators.ordering import with_halo


def frame_pairs(frames: DataFrame, column: str, name: str, measure: Callable[[pa.Array, pa.Array], pa.Array],
                segment: int = P.SEGMENT_FRAMES) -> DataFrame:
    """(clip_id, frame_index, `name`): a measure of each frame and the one numbered one less, if there is one.

    The payload is shuffled once, by (clip, segment); the last frame of each segment is repeated in the next.  Frames
    pass in order and only the one before is held, so memory is one Arrow batch, which is bounded by bytes,
    and a frame, however large frames are.
    """
    rows = with_halo(frames.select("clip_id", "frame_index", column), "frame_index", segment, 1)
    kind = frames.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for batch in batches:
            there = np.asarray(batch.column(column).is_valid())
            values = [v if ok else None for v, ok in zip(byte_rows(batch.column(column)), there)]
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("clip_id", "segment", "frame_index"))))
            own = ~np.asarray(batch.column("is_halo").to_numpy(zero_copy_only=False))
            rows, previous = [], []
            for i, (key, value) in enumerate(zip(keys, values)):
                if own[i] and before is not None and before[1] is not None and before[0] == (*key[:2], key[2] - 1):
                    rows.append(i)
                    previous.append(before[1])
                before = key, value
            if rows:
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("clip_id").take(at), batch.column("frame_index").take(at),
                     measure(batch.column(column).take(at), binary_from_rows(previous))], ["clip_id", "frame_index", name])
            if before is not None and before[1] is not None:
                before = before[0], before[1].copy()
    return (rows.repartition("clip_id", "segment").sortWithinPartitions("clip_id", "segment", "frame_index")
            .mapInArrow(run, f"clip_id {kind}, frame_index long, `{name}` double"))


def consecutive_motion(frames: DataFrame) -> DataFrame:
    """Motion of each frame against the one before it in its clip."""
    return frame_pairs(frames, "gray", "motion", pixels.motion_of)


def frame_pair_psnr(frames: DataFrame) -> DataFrame:
    """Signal-to-noise of each frame against the one before it, in dB."""
    def mean_error(a: pa.Array, b: pa.Array) -> pa.Array:
        size = pa.array([float(v.size) or None for v in byte_rows(a)], pa.float64())
        return pc.divide(pixels.squared_error.func(a, b), size)
    ratio = F.try_divide(F.lit(255.0 * 255.0), F.col("mse"))
    return frame_pairs(frames, "gray", "mse", mean_error).select(
        "clip_id", "frame_index", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(ratio)).alias("psnr_db"))


def judge_frames(frames: DataFrame, **masking) -> DataFrame:
    """Thumbnail, masks and sharpness of each output frame (clip_id, frame_index,
    width, height, rgb).  Keywords are those of `pixels.judge`.

    The result is what selection needs, without the pixels: metric-size gray and
    the mask that limits motion as `valid`.
    """
    return frames.select(
        "clip_id", "frame_index",
        pixels.judge("rgb", "width", "height", **masking).alias("_j"),
    ).select("clip_id", "frame_index", F.col("_j.thumb_w").alias("width"),
             F.col("_j.thumb_h").alias("height"), "_j.gray", F.col("_j.sfm").alias("valid"),
             "_j.training", "_j.sharpness")
