"""Mask algebra on frame tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framesift import params as P
from framesift.functions import kernels
from framesift.functions.arrays import binary_from_rows, byte_rows
from framesift.functions.pixels import mask_and
from framesift.operators.ordering import with_halo


def routing(spark: SparkSession) -> DataFrame:
    """(class, sidecar): which mask set each class belongs to.  Three fixed rows."""
    rows = [(c, s) for c, sets in P.MASK_ROUTING.items() for s in sets]
    return spark.createDataFrame(rows, "class string, sidecar string")


def mask_routing(class_masks: DataFrame) -> DataFrame:
    """Class masks repeated for each set they are written to.  The sky reaches
    structure from motion only."""
    return class_masks.join(F.broadcast(routing(class_masks.sparkSession)), "class")


def mask_set(layers: dict[str, Column]) -> dict[str, Column]:
    """Sidecar masks of one frame from its class masks, without a shuffle: the
    classes of a frame sit in one row.  A set without any class stays away."""
    out: dict[str, Column] = {}
    for name, mask in layers.items():
        for sidecar in P.MASK_ROUTING[name]:
            out[sidecar] = mask_and(out[sidecar], mask) if sidecar in out else mask
    return out


def mask_intersect(frames: DataFrame, layers: dict[str, Column]) -> DataFrame:
    """One row per (frame, sidecar) with all its classes ANDed."""
    sets = mask_set(layers)
    pairs = F.array(*[F.struct(F.lit(s).alias("sidecar"), m.alias("mask")) for s, m in sets.items()])
    return (frames.withColumn("_pair", F.explode(pairs))
            .select("clip_id", "frame_index", "_pair.sidecar", "_pair.mask")
            .filter("mask is not null"))


def mask_manifest(runs: DataFrame) -> DataFrame:
    """What each run masked, how it was found and where it was written.

    `runs`: (run_id, heuristic_sky, seg_sky, seg_people booleans and the
    parameters of each).  The model wins when both are asked for sky.
    """
    def entry(name: str, source: str, params: Column, on: Column) -> Column:
        sets = F.array(*[F.lit(s) for s in P.MASK_ROUTING[name]])
        return F.when(on, F.struct(
            F.lit(name).alias("name"), F.lit(source).alias("source"),
            sets.alias("written_to"), params.alias("params")))

    heuristic_on = F.col("heuristic_sky") & ~F.col("seg_sky")
    classes = F.array_compact(F.array(
        entry("sky", "segmentation", F.to_json(F.col("sky_params")), F.col("seg_sky")),
        entry("people", "segmentation", F.to_json(F.col("people_params")), F.col("seg_people")),
        entry("sky", "heuristic", F.to_json(F.col("heuristic_params")), heuristic_on)))
    sidecars = F.when(
        F.exists("classes", lambda c: F.array_contains(c["written_to"], "training")),
        F.create_map(*[F.lit(x) for kv in P.SIDECAR_DIRS.items() for x in kv])
    ).otherwise(F.create_map(F.lit("sfm"), F.lit(P.SIDECAR_DIRS["sfm"])))
    return (runs.withColumn("classes", classes).filter(F.size("classes") > 0)
            .withColumn("sidecars", sidecars).select("run_id", "classes", "sidecars"))


def odd_window(window: int) -> int:
    return max(int(window), 1) | 1


def label_smoothing(frames: DataFrame, window: int = P.SEG_WINDOW,
                    segment: int = P.SEGMENT_FRAMES) -> DataFrame:
    """Per-pixel mode of the labels over this frame and the ones before it.

    Frame numbers must be gap-free (see `audits.frame_order_gaps`).  Segments of
    a clip run in parallel; each gets the few frames before it as lead-in.  Clips may differ in size.
    """
    w = odd_window(window)
    if w == 1:
        return frames.select("clip_id", "frame_index", "labels")
    segment = max(segment, w)
    rows = with_halo(frames.select("clip_id", "frame_index", "labels"), "frame_index", segment, w - 1)
    schema = frames.select("clip_id", "frame_index", "labels").schema
    return (
        rows.repartition("clip_id", "segment")
        .sortWithinPartitions("clip_id", "segment", "frame_index")
        .mapInArrow(_smooth(w), schema)
    )


def _smooth(w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, history = None, None
        for batch in batches:
            labels = byte_rows(batch.column("labels"))
            lead_in = np.asarray(batch.column("is_halo").to_numpy(zero_copy_only=False))
            keys = list(zip(batch.column("clip_id").to_pylist(), batch.column("segment").to_pylist()))
            cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            done: list[np.ndarray] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                block = np.stack(labels[a:b]).astype(np.int16)
                if keys[a] != key:
                    key = keys[a]
                    history = np.full((w - 1, block.shape[1]), -1, dtype=np.int16)
                block = np.concatenate([history, block])
                done.extend(kernels.trailing_mode(block, w))
                history = block[-(w - 1):].copy()
            own = pa.array(~lead_in)
            out = pa.RecordBatch.from_arrays(
                [batch.column("clip_id"), batch.column("frame_index"),
                 binary_from_rows(done) if done else batch.column("labels")],
                names=["clip_id", "frame_index", "labels"])
            yield out.filter(own)
    return run
