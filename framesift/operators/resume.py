"""Picking up an interrupted run: which clips are done, which are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framesift import params as P
from framesift.functions.text import image_name, mask_path
from framesift.sources import file_sets


def find_previous_clip(clips: DataFrame, previous: DataFrame) -> DataFrame:
    """The earlier record of each clip: by exact path, else by stem; the first
    one listed wins.  Adds `previous_position` and `matched_by`."""
    def first_by(column: str, name: str) -> DataFrame:
        return previous.groupBy(column).agg(F.min("position").alias(name))

    return (
        clips.join(first_by("path", "_by_path"), "path", "left")
        .join(first_by("stem", "_by_stem"), "stem", "left")
        .withColumn("previous_position", F.coalesce("_by_path", "_by_stem"))
        .withColumn("matched_by", F.when(F.col("_by_path").isNotNull(), "path")
                    .when(F.col("_by_stem").isNotNull(), "stem"))
        .drop("_by_path", "_by_stem")
    )


def expected_files(kept: DataFrame, ext: str, sidecars: list[str]) -> DataFrame:
    """(clip_id, path) of every image and mask a complete clip has on disk."""
    name = image_name(F.col("stem"), F.col("frame_index"), ext)
    paths = [name] + [mask_path(P.SIDECAR_DIRS[s], name) for s in sidecars]
    return kept.select("clip_id", F.explode(F.array(*paths)).alias("path"))


def clip_intact(records: DataFrame, kept: DataFrame, listing: DataFrame, ext: str,
                sidecars: list[str]) -> DataFrame:
    """A clip is intact when its list is as long as its count says and every
    image and mask exists.

    `records`: (clip_id, frames_kept); `kept`: (clip_id, stem, frame_index);
    `listing`: what exists, as paths (path) or as a set of `file_sets`.  Bitmaps of
    frame numbers are compared, some bytes for each stretch of a clip; only counts meet per clip.
    """
    files = listing if "bits" in listing.columns else file_sets.of_paths(listing)
    names = [("", ext)] + [(P.SIDECAR_DIRS[s], f"{ext}.png") for s in sidecars]
    absent = file_sets.missing(kept, files, names)
    listed = kept.groupBy("clip_id").agg(F.count(F.lit(1)).alias("listed"))
    return (
        records.join(listed, "clip_id", "left").join(absent, "clip_id", "left")
        .withColumn("listed", F.coalesce("listed", F.lit(0)))
        .withColumn("files_missing", F.coalesce("files_missing", F.lit(0)))
        .withColumn("intact", (F.col("listed") == F.col("frames_kept")) & (F.col("files_missing") == 0))
    )


def resume_plan(clips: DataFrame, previous: DataFrame, intact: DataFrame) -> DataFrame:
    """`carried` for clips whose earlier record is intact, `todo` for the rest.

    `previous` carries (position, path, stem, clip_id); `intact` carries
    (clip_id, intact) of the earlier records.
    """
    found = find_previous_clip(clips, previous.select("position", "path", "stem"))
    state = (previous.join(intact.select("clip_id", "intact"), "clip_id")
             .select(F.col("position").alias("previous_position"), "intact"))
    return found.join(state, "previous_position", "left").withColumn(
        "action", F.when(F.coalesce("intact", F.lit(False)), "carried").otherwise("todo"))


def combined_records(carried: DataFrame, processed: DataFrame) -> DataFrame:
    """Carried and newly processed clip records in clip order."""
    return carried.unionByName(processed).orderBy("position")


COMPARED = (
    ("output size", "output_size"),
    ("image format", "format"),
    ("frame selection", "selection"),
    ("interpolation", "interpolation"),
    ("gpu undistortion", "gpu"),
    ("masking", "masking"),
    ("lens profile", "profile_sha"),
)


def parameter_differences(then: str, now: str) -> Column:
    """Names and values of the parameters that differ, NULL when none does.

    `then` and `now` are struct columns.  Hardware decoding is left out on
    purpose: it changes speed, not frames.
    """
    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("none"))

    parts = []
    for label, field in COMPARED:
        a, b = F.col(f"{then}.{field}"), F.col(f"{now}.{field}")
        parts.append(F.when(~a.eqNullSafe(b), F.concat(
            F.lit(f"{label} ("), shown(a), F.lit(" then, "), shown(b), F.lit(" now)"))))
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def parameter_diff(runs: DataFrame, previous: DataFrame, on: str) -> DataFrame:
    """Verdict per run against what its output folder already holds.

    Both sides carry `on` and the compared fields; `runs` also `resume`.
    """
    fields = [f for _, f in COMPARED]
    others = [c for c in runs.columns if c not in fields]
    now = runs.select(*others, F.struct(*fields).alias("_now"))
    then = previous.select(on, F.struct(*fields).alias("_then"))
    diff = parameter_differences("_then", "_now")
    return (
        now.join(then, on, "left")
        .withColumn("differences", F.when(F.col("_then").isNotNull(), diff))
        .withColumn("verdict", F.when(F.col("_then").isNull(), "new")
                    .when(F.col("differences").isNull() & F.col("resume"), "carry")
                    .when(F.col("differences").isNull(), "overwrite")
                    .when(F.col("resume"), "resume refused")
                    .otherwise("different dataset"))
        .drop("_then", "_now")
    )
