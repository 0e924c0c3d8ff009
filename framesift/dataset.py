"""A whole dataset run: frames and clips in; images, masks, manifest and cameras out.

    run = build_dataset(frames, clips, "/data/out", DatasetConfig(select="motion-gated"))

`frames`: (clip_id, frame_index, width, height, rgb).  `clips`: (clip_id, position,
path, stem, width, height, fps[, frames]).  With a lens profile, `clips` also
carries its columns (k00, k11, calib_w, calib_h, stretch_x, stretch_y, coeffs).

Pixels are read twice and stored never: once to make thumbnails, once to render
the frames that were kept.  Everything between works on thumbnails and numbers.

A run can be killed at any time.  Its row with all parameters is written before the
first image; clips are done in groups of bounded size and recorded group by group,
after their images; the run's totals come last.  A later run with other parameters
into the same folder is refused, complete or not; one with `resume` goes on with
what is not recorded whole, one without replaces the dataset.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framesift import params as P
from framesift.functions import geometry as G
from framesift.functions import lens, pixels, segment
from framesift.operators import audits, masks, metrics, records, replay, resume, selection
from framesift.operators.motion import motion_gated
from framesift.operators.ordering import index_bucket, running_sum
from framesift.operators.stems import unique_stems
from framesift.session import broadcast_if_small, exists, materialise, scratch_scope, ship_package
from framesift.sources import file_sets, images, manifest

LENS = ("k00", "k11", "calib_w", "calib_h", "stretch_x", "stretch_y", "coeffs")
TOOL = "framesift"


@dataclass(frozen=True)
class DatasetConfig:
    size: str = "same"
    factor: float = 1.0
    width: int = 0
    height: int = 0
    image_format: str = "png"
    jpeg_quality: int = P.JPEG_QUALITY
    select: str = "motion-gated"
    nth: int = P.EVERY_NTH
    motion_threshold: float = P.MOTION_THRESHOLD
    window: int = P.MOTION_WINDOW
    blur_floor: float | None = None
    interpolation: str = P.INTERPOLATION
    profile_sha: str | None = None
    mask_sky: bool = False
    mask_people: bool = False
    model: object = None
    seg_width: int = P.SEG_WIDTH
    temporal_window: int = P.SEG_WINDOW
    sky_class: int = P.SKY_CLASS_ID
    people_class: int = P.PERSON_CLASS_ID
    sky_dilate: int = P.SEG_SKY_DILATE
    people_dilate: int = P.SEG_PEOPLE_DILATE
    resume: bool = False
    #: Names where the replayed list comes from; another source is another dataset.
    replay_source: str | None = None
    #: Frames of clips that are done and recorded together.
    group_frames: int = 2_000_000

    def __post_init__(self):
        if self.mask_people and self.model is None:
            raise ValueError("people can only be masked with a segmentation model")
        if self.select not in ("motion-gated", "every-nth", "replay"):
            raise ValueError(f"unknown selection {self.select}")

    @property
    def ext(self) -> str:
        return "png" if self.image_format == "png" else "jpg"

    @property
    def sidecars(self) -> list[str]:
        names = [c for c, on in (("sky", self.mask_sky), ("people", self.mask_people)) if on]
        return [s for s in P.SIDECAR_DIRS if any(s in P.MASK_ROUTING[c] for c in names)]

    def model_identity(self) -> str | None:
        if self.model is None:
            return None
        identity = getattr(self.model, "identity", None)
        return identity() if identity else f"{type(self.model).__module__}.{type(self.model).__qualname__}"

    def masking(self) -> dict | None:
        """The classes that are masked, how, and where they are written; None if none is."""
        if not self.sidecars:
            return None
        shared = {"model": self.model_identity(), "width": self.seg_width,
                  "window": masks.odd_window(self.temporal_window)}
        classes = []
        for name, on, number, dilate in (("sky", self.mask_sky, self.sky_class, self.sky_dilate),
                                         ("people", self.mask_people, self.people_class, self.people_dilate)):
            if on:
                found = self.model is not None
                classes.append({
                    "name": name, "source": "segmentation" if found else "heuristic",
                    "written_to": list(P.MASK_ROUTING[name]),
                    "params": json.dumps({"class": number, "dilate": dilate, **shared} if found else {}, sort_keys=True)})
        return {"sidecars": {s: P.SIDECAR_DIRS[s] for s in self.sidecars}, "classes": classes}

    def document(self) -> dict:
        """All parameters, as the manifest has them."""
        size = {"same": {}, "scale": {"factor": float(self.factor)},
                "exact": {"width": self.width, "height": self.height}}[self.size]
        mode = {"motion-gated": {"motion_threshold": float(self.motion_threshold), "window": self.window},
                "every-nth": {"n": self.nth}, "replay": {"source": self.replay_source}}[self.select]
        kind = {"format": "png"} if self.ext == "png" else {"format": "jpeg", "quality": self.jpeg_quality}
        floor = None if self.blur_floor is None else float(self.blur_floor)
        return {"output_size": {"kind": self.size, **size}, "format": kind,
                "selection": {"mode": {"mode": self.select, **mode}, "blur_floor": floor},
                "interpolation": self.interpolation, "gpu": False, "masking": self.masking()}


def sized_clips(clips: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Clips with distinct stems and the size they are written at."""
    w, h = G.output_size(F.lit(cfg.size), F.lit(float(cfg.factor)), F.lit(cfg.width), F.lit(cfg.height),
                         F.col("width"), F.col("height"))
    names = unique_stems(clips).select("position", "name")
    return (clips.join(names, "position").withColumn("stem", F.col("name")).drop("name")
            .withColumn("out_w", w).withColumn("out_h", h))


def render(frames: DataFrame, clips: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Output frames (clip_id, stem, frame_index, width, height, rgb): undistorted
    straight at output size when clips carry a lens, else resized."""
    with_lens = set(LENS) <= set(clips.columns)
    extra = [*LENS] if with_lens else []
    # Pixels must not be shuffled to meet their clip.
    f = frames.select("clip_id", "frame_index", "width", "height", "rgb").join(
        broadcast_if_small(clips.select("clip_id", "stem", "out_w", "out_h", *extra)), "clip_id")
    plain = pixels.resize_rgb("rgb", "width", "height", "out_w", "out_h")

    def made(rows: DataFrame, out) -> DataFrame:
        return rows.select("clip_id", "stem", "frame_index", F.col("out_w").alias("width"),
                           F.col("out_h").alias("height"), out.alias("rgb"))
    if not with_lens:
        return made(f, plain)
    # A clip without a profile is resized like any other; only the others go through the lens.
    straight = lens.undistort_frames("rgb", "width", "height", "out_w", "out_h", *LENS, cfg.interpolation)
    bare = clips.filter("coeffs IS NULL").limit(1).count()
    done = made(f.filter("coeffs IS NOT NULL") if bare else f, straight)
    return done.unionByName(made(f.filter("coeffs IS NULL"), plain)) if bare else done


def judge(frames: DataFrame, clips: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Thumbnails, masks and sharpness of every frame, stored."""
    rendered = render(frames, clips, cfg)
    if cfg.model is None:
        sky = {} if cfg.mask_sky else None
        return materialise(metrics.judge_frames(rendered, heuristic_sky=sky), "metrics")
    ids = [i for i, on in ((cfg.sky_class, cfg.mask_sky), (cfg.people_class, cfg.mask_people)) if on]
    step = P.SEG_STRIDE
    info = segment.inspect_model(cfg.model, -(-max(cfg.seg_width, step) // step) * step, step, tuple(ids))
    offset = info.offset
    if getattr(cfg.model, "declared_size", lambda: None)():
        label_w, label_h = F.lit(info.size[0]), F.lit(info.size[1])
    else:
        label_w, label_h = G.inference_size(F.col("width"), F.col("height"), cfg.seg_width)
    # Each row is inferred at the size its clip asks for, so any number of sizes is one pass.
    thumbs = materialise(rendered.select(
        "clip_id", "frame_index",
        pixels.metric_thumbnail("rgb", "width", "height").alias("rgb"),
        pixels.metric_height("width", "height").alias("thumb_h"),
        pixels.metric_width("width").alias("thumb_w"),
        segment.segment_frames("rgb", "width", "height", cfg.model, info, size=(label_w, label_h)).alias("labels"),
        label_w.alias("label_w"), label_h.alias("label_h")), "thumbnails")
    if masks.odd_window(cfg.temporal_window) > 1:
        smooth = masks.label_smoothing(thumbs.select("clip_id", "frame_index", "labels"), cfg.temporal_window)
        thumbs = thumbs.drop("labels").join(smooth, ["clip_id", "frame_index"])
    thumbs = thumbs.withColumnRenamed("thumb_w", "width").withColumnRenamed("thumb_h", "height")
    return materialise(metrics.judge_frames(
        thumbs, labels="labels", label_w="label_w", label_h="label_h",
        sky_id=cfg.sky_class + offset if cfg.mask_sky else None,
        people_id=cfg.people_class + offset if cfg.mask_people else None,
        sky_dilate=cfg.sky_dilate, people_dilate=cfg.people_dilate), "metrics")


def replayed(frames: DataFrame, clips: DataFrame, kept: DataFrame) -> DataFrame:
    """Decisions that keep the recorded frames; a recorded frame that is not there
    is an error."""
    named = frames.select("clip_id", "frame_index").join(clips.select("clip_id", "stem"), "clip_id")
    wanted = kept.join(clips.select("stem"), "stem", "left_semi")
    lost = replay.replay_missing(named, wanted).orderBy("stem").limit(1).collect()
    if lost:
        raise ValueError(f"{lost[0].stem}: {lost[0].message}")
    return replay.replay_selection(named, wanted).select("clip_id", "frame_index", "keep")


def decide(judged: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """One decision per frame."""
    if cfg.select == "every-nth":
        return selection.every_nth(judged, cfg.nth, cfg.blur_floor)
    return motion_gated(judged, cfg.motion_threshold, cfg.window, cfg.blur_floor, stored=True)


def _parameters(spark: SparkSession, cfg: DatasetConfig) -> DataFrame:
    """One row: tool, parameters, profile."""
    row = spark.createDataFrame([(TOOL, int(time.time()), json.dumps(cfg.document()), cfg.profile_sha)],
                                "tool string, created_unix long, document string, sha string")
    return row.select("tool", "created_unix", F.from_json("document", manifest.PARAMS).alias("params"),
                      F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("name"),
                               F.col("sha").alias("sha256")).alias("profile"))


def _compared(run: DataFrame) -> list:
    """The compared fields as text."""
    text = {"profile_sha": F.col("profile.sha256"), "gpu": F.col("params.gpu").cast("string"),
            "interpolation": F.col("params.interpolation")}
    return [text.get(f, F.to_json(F.col(f"params.{f}"))).alias(f) for _, f in resume.COMPARED]


def _check_previous(spark: SparkSession, out: str, run_id: str, cfg: DatasetConfig) -> bool:
    """Whether the folder holds a run to carry on; different settings are refused."""
    table = f"{out}/manifest"
    if manifest.last_run(spark, table, run_id) is None:
        return False
    mine = _parameters(spark, cfg)
    now = mine.select(F.lit(out).alias("out_dir"), F.lit(cfg.resume).alias("resume"), *_compared(mine))
    old = manifest.recorded_run(spark, table, run_id)
    row = resume.parameter_diff(now, old.select(F.lit(out).alias("out_dir"), *_compared(old)), "out_dir").first()
    if row.differences is not None:
        raise ValueError(f"{out} holds a dataset made with other settings: {row.differences}")
    return row.verdict == "carry"


def _carried(spark: SparkSession, out: str, run_id: str, clips: DataFrame, cfg: DatasetConfig) -> DataFrame:
    """Clips whose record and files are complete: (clip_id)."""
    done = manifest.recorded_clips(spark, f"{out}/manifest", run_id)
    if done is None or not done.limit(1).count():
        return clips.select("clip_id").limit(0)
    chunks = manifest.recorded_kept(spark, f"{out}/manifest", run_id)
    kept = chunks.select("clip_id", F.explode("kept_frames").alias("frame_index")).join(
        done.select("clip_id", "stem"), "clip_id")
    there = file_sets.listed(spark, f"{out}/images")
    intact = resume.clip_intact(done.select("clip_id", "frames_kept"), kept, there, cfg.ext, cfg.sidecars)
    previous = done.select("clip_id", "position", "path", "stem")
    plan = resume.resume_plan(clips.select("clip_id", "path", "stem"), previous, intact)
    return plan.filter("action = 'carried'").select("clip_id")


def _remove_superseded(spark: SparkSession, out: str, run_id: str, cfg: DatasetConfig) -> None:
    """Files that an earlier invocation recorded and that are no part of the dataset any more."""
    table = f"{out}/manifest"
    every = manifest.superseded_kept(spark, table, run_id)
    if every is None:
        return
    clips = manifest.recorded_clips(spark, table, run_id).select("clip_id", "stem")
    now = manifest.recorded_kept(spark, table, run_id).select(
        "clip_id", F.explode("kept_frames").alias("frame_index")).join(clips, "clip_id")
    past = resume.expected_files(every, cfg.ext, cfg.sidecars).select("path").distinct()
    images.remove_files(past.join(resume.expected_files(now, cfg.ext, cfg.sidecars), "path", "left_anti"), f"{out}/images")


def _groups(frames: DataFrame, clips: DataFrame, size: int) -> DataFrame:
    """Clips with the number of the group they are done in: about `size` frames each.

    Groups follow the clip ids, as stored frames do, so that each reads a stretch of its own; ids that are no
    numbers are taken in the clips' order.
    """
    along = "clip_id" if isinstance(clips.schema["clip_id"].dataType, T.IntegralType) else "position"
    counts = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("_frames"))
    listed = clips.join(counts, "clip_id")
    summed = running_sum(listed.select(along, "_frames"), [], along, "_frames",
                         index_bucket(along, P.SEGMENT_FRAMES), "_upto")
    group = F.expr(f"(_upto - _frames) div {int(size)}")
    return clips.join(summed.select(along, group.alias("_group")), along)


def build_dataset(frames: DataFrame | images.FrameStore, clips: DataFrame, out: str, cfg: DatasetConfig = DatasetConfig(),
                  kept: DataFrame | None = None, run_id: str = "run") -> DataFrame:
    """Run everything and return the clip records of the dataset.

    `kept` (stem, frame_index) is what a replay keeps.  With `resume`, clips that
    are complete under `out` are carried over and the rest are done.  Frames of a `FrameStore` are picked in
    their buckets.
    """
    store = frames if isinstance(frames, images.FrameStore) else None
    rows = store.frames() if store else frames
    spark = ship_package(rows.sparkSession)
    with scratch_scope(spark):
        return _build(spark, rows, store, clips, out, cfg, kept, run_id)


def _build(spark: SparkSession, frames: DataFrame, store: images.FrameStore | None, clips: DataFrame, out: str, cfg: DatasetConfig,
           kept: DataFrame | None, run_id: str) -> DataFrame:
    began = time.time()
    table = f"{out}/manifest"
    images.target_uri(spark, out)
    carry_on = _check_previous(spark, out, run_id, cfg)
    all_clips = materialise(sized_clips(clips, cfg), "clips")
    if cfg.select == "replay":
        if kept is None:
            raise ValueError("a replay needs the recorded frames")
        bare = all_clips.select("clip_id", "stem").join(kept, "stem", "left_anti").orderBy("stem").limit(1).collect()
        if bare:
            raise ValueError(f"no kept frames recorded for clip {bare[0].stem}")
    todo = all_clips
    first = manifest.next_batch(spark, table, run_id)
    since = manifest.last_run(spark, table, run_id)[1] if carry_on else first
    if carry_on:
        carried = materialise(_carried(spark, out, run_id, all_clips, cfg), "carried")
        todo = materialise(all_clips.join(carried, "clip_id", "left_anti"), "todo")
    # A frame's clip is known by its id; frames of clips already done are not read further.
    mine = frames.join(broadcast_if_small(todo.select("clip_id")), "clip_id", "left_semi")
    wrong = audits.frame_size_check(mine, todo).limit(1).collect()
    if wrong:
        raise ValueError(f"clip {wrong[0].clip_id}, frame {wrong[0].frame_index}: {wrong[0].message}")
    audits.require_no_gaps(mine)
    images.require_frames(mine, todo, "clip_id")

    manifest.start_run(_parameters(spark, cfg), table, run_id, first, since)
    grouped = materialise(_groups(mine, todo, cfg.group_frames), "groups")
    spans = grouped.groupBy("_group").agg(F.min("clip_id").alias("low"), F.max("clip_id").alias("high"))
    for batch, span in enumerate(spans.orderBy("_group").collect(), first):
        own = grouped.filter(F.col("_group") == span["_group"]).drop("_group")
        part = frames.filter(F.col("clip_id").between(span.low, span.high)).join(
            broadcast_if_small(own.select("clip_id")), "clip_id", "left_semi")
        _do_group(part, store or part, own, kept, out, cfg, run_id, batch)

    listed = manifest.recorded_clips(spark, table, run_id)
    if listed is None or (not carry_on and not (listed.agg(F.sum("frames_kept")).first()[0] or 0)):
        raise ValueError("no frame was kept")
    _remove_superseded(spark, out, run_id, cfg)
    totals = records.run_totals(listed.withColumn("carried", F.col("batch") < first)
                                .withColumn("wall_seconds", F.lit(time.time() - began)))
    manifest.finish_run(totals, table, run_id, first)
    manifest.write_cameras(manifest.camera_rows(listed, "position"), f"{out}/cameras")
    _write_document(spark, out, run_id, listed)
    return listed


def _do_group(frames: DataFrame, source: DataFrame | images.FrameStore, clips: DataFrame, kept: DataFrame | None, out: str,
              cfg: DatasetConfig, run_id: str, batch: int) -> None:
    """Decide, write and then record some clips; kept frames come from `source`."""
    if cfg.select == "replay":
        # No metric is consulted, so only kept frames are looked at, and only for masks.
        decisions = materialise(replayed(frames, clips, kept), "decisions")
        judged = judge(images.kept_only(source, decisions), clips, cfg) if cfg.sidecars else None
    else:
        judged = judge(frames, clips, cfg)
        decisions = materialise(decide(judged, cfg), "decisions")
    images.write_images(render(images.kept_only(source, decisions), clips, cfg), f"{out}/images", cfg.ext,
                        cfg.jpeg_quality)
    if cfg.sidecars:
        _write_masks(judged, decisions, clips, out, cfg)
    rec = records.clip_record(decisions).select("clip_id", "frames_decoded", "frames_kept")
    names = ["clip_id", "position", "path", "stem", "width", "height", "fps", "out_w", "out_h"]
    done = clips.select(*names, *_intrinsics(clips)).join(rec, "clip_id")
    manifest.record_clips(done, selection.kept_chunks(decisions), f"{out}/manifest", run_id, batch)


def _write_document(spark: SparkSession, out: str, run_id: str, listed: DataFrame) -> None:
    """The manifest as the one document other tools read."""
    run = manifest.recorded_run(spark, f"{out}/manifest", run_id)
    header = run.select("tool", "created_unix", "completed", "profile", "params")
    intrinsics = F.when(F.col("fx").isNotNull(), F.array("fx", "fy", "cx", "cy"))
    clips = listed.select("clip_id", "position", "path", "stem", "width", "height", "fps", "frames_decoded", "frames_kept",
                          F.col("out_w").alias("out_width"), F.col("out_h").alias("out_height"),
                          intrinsics.alias("pinhole_intrinsics"))
    totals = run.select("totals.decoded", "totals.kept", "totals.written", "totals.wall_seconds", "totals.decoded_fps",
                        "totals.written_fps")
    chunks = manifest.recorded_kept(spark, f"{out}/manifest", run_id)
    manifest.write_manifest(manifest.manifest_lines(header, clips, chunks, totals), f"{out}/manifest_document")


def _intrinsics(clips: DataFrame) -> list:
    names = ("fx", "fy", "cx", "cy")
    if not set(LENS) <= set(clips.columns):
        return [F.lit(None).cast("double").alias(n) for n in names]
    values = G.pinhole_intrinsics(*[F.col(n) for n in (
        "k00", "k11", "calib_w", "calib_h", "stretch_x", "stretch_y", "width", "height", "out_w", "out_h")])
    return [v.alias(n) for n, v in zip(names, values)]


def _write_masks(judged: DataFrame, decisions: DataFrame, clips: DataFrame, out: str,
                 cfg: DatasetConfig) -> None:
    """Sidecars of kept frames, scaled to output size only now."""
    columns = {"sfm": "valid", "training": "training"}
    pair = F.explode(F.array(*[
        F.struct(F.lit(s).alias("sidecar"), F.col(columns[s]).alias("mask")) for s in cfg.sidecars]))
    kept = images.kept_only(judged.select("clip_id", "frame_index", "width", "height", "valid", "training"),
                            decisions)
    rows = (kept.withColumn("_p", pair).select("clip_id", "frame_index", "width", "height", "_p.*")
            .join(clips.select("clip_id", "stem", "out_w", "out_h"), "clip_id"))
    scaled = pixels.nn_scale("mask", "width", "height", "out_w", "out_h")
    images.write_masks(rows.select(
        "stem", "frame_index", "sidecar", scaled.alias("mask"), F.col("out_w").alias("width"),
        F.col("out_h").alias("height")).filter("mask is not null"), f"{out}/images", cfg.ext)
