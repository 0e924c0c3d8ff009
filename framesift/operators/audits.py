"""Checks on frames, clips, files and finished datasets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from framesift import params as P
from framesift.functions.arrays import byte_rows
from framesift.operators.ordering import index_bucket, previous_value


def frame_order_gaps(frames: DataFrame, segment: int = P.SEGMENT_FRAMES) -> DataFrame:
    """Clips with lost frames: the first missing number and how many are missing."""
    numbered = previous_value(frames.select("clip_id", "frame_index"), ["clip_id"], "frame_index",
                              index_bucket("frame_index", segment), "before")
    expected = F.coalesce("before", F.lit(-1)) + 1
    return (
        numbered.withColumn("expected", expected)
        .filter("frame_index <> expected")
        .groupBy("clip_id")
        .agg(F.min("expected").alias("gap_at"),
             F.sum(F.col("frame_index") - F.col("expected")).alias("missing"))
    )


def require_no_gaps(frames: DataFrame) -> None:
    bad = frame_order_gaps(frames).orderBy("clip_id").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].clip_id}: frames missing from number {bad[0].gap_at} on")


def frame_size_check(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """Frames whose size is not what their clip was probed with."""
    probed = clips.select("clip_id", F.col("width").alias("probed_w"), F.col("height").alias("probed_h"))
    return (
        frames.join(probed, "clip_id")
        .filter("width <> probed_w or height <> probed_h")
        .select("clip_id", "frame_index", F.format_string(
            "frame is %dx%d, its clip was probed as %dx%d",
            "width", "height", "probed_w", "probed_h").alias("message"))
    )


def frame_rate_check(clips: DataFrame) -> DataFrame:
    """Clips whose reported rate is refused."""
    return clips.filter(F.col("fps") >= P.FPS_REFUSED).select(
        "path", "fps", F.concat(
            "path", F.lit(": a rate of "), F.round("fps").cast("long").cast("string"),
            F.lit(" frames per second is refused")).alias("message"))


def profile_mismatch(calib_w, calib_h, profile_fps, width, height, fps) -> Column:
    """Why a lens profile does not fit a clip, or NULL.  The rate is only
    compared when the aspect fits, and only when both are known."""
    ratio_p, ratio_c = F.try_divide(calib_w, calib_h), F.try_divide(width, height)
    empty = (calib_w == 0) | (calib_h == 0) | (width == 0) | (height == 0)
    aspect = F.abs(ratio_p - ratio_c) > P.ASPECT_TOLERANCE
    rate = (profile_fps > 0) & (fps > 0) & (F.abs(profile_fps - fps) > P.FPS_TOLERANCE)
    return (
        F.when(empty, F.lit(None).cast("string"))
        .when(aspect, F.format_string(
            "aspect: profile %dx%d (%.2f:1), clip %dx%d (%.2f:1)",
            calib_w, calib_h, ratio_p, width, height, ratio_c))
        .when(rate, F.format_string(
            "rate: profile %.2f fps, clip %.2f fps", profile_fps, fps))
    )


def profile_candidates(clips: DataFrame, profiles: DataFrame) -> DataFrame:
    """How many catalogue profiles fit each clip, and the first of them.

    Fit depends only on size and rate, so clips and profiles are first reduced
    to their distinct ones.  Those meet in buckets of aspect and rate as wide as
    the tolerance (a neighbour on either side can still fit), never all with all.
    """
    geometry = ["width", "height", "fps"]
    kinds = clips.select(*geometry).distinct().filter("width > 0 and height > 0")
    kinds = kinds.withColumn("_aspect", F.try_divide("width", "height"))
    sorts = (profiles.filter("calib_w > 0 and calib_h > 0")
             .groupBy("calib_w", "calib_h", F.col("fps").alias("profile_fps"))
             .agg(F.count(F.lit(1)).alias("n"), F.min("profile_id").alias("first_profile"))
             .withColumn("_calib_aspect", F.try_divide("calib_w", "calib_h")))
    near = F.abs(F.col("_calib_aspect") - F.col("_aspect")) <= P.ASPECT_TOLERANCE

    def around(c: Column, step: float) -> Column:
        at = F.floor(c / step)
        return F.explode(F.array(at - 1, at, at + 1))

    aspect_of_sort = F.floor(F.col("_calib_aspect") / P.ASPECT_TOLERANCE).alias("_ab")
    timed, untimed = F.col("fps") > 0, F.col("profile_fps") > 0
    # Both rates known: bucket by aspect and by rate.
    k = kinds.filter(timed).withColumn("_ab", around(F.col("_aspect"), P.ASPECT_TOLERANCE)) \
        .withColumn("_fb", around(F.col("fps"), P.FPS_TOLERANCE))
    s = sorts.filter(untimed).select("*", aspect_of_sort,
                                     F.floor(F.col("profile_fps") / P.FPS_TOLERANCE).alias("_fb"))
    both = k.join(s, ["_ab", "_fb"]).filter(
        near & (F.abs(F.col("fps") - F.col("profile_fps")) <= P.FPS_TOLERANCE))
    # One rate unknown: the rate cannot rule a profile out, so sizes alone decide.
    totals = [F.sum("n").alias("n"), F.min("first_profile").alias("first_profile")]
    sizes_any = sorts.groupBy("calib_w", "calib_h", "_calib_aspect").agg(*totals)
    sizes_untimed = sorts.filter(~untimed).groupBy("calib_w", "calib_h", "_calib_aspect").agg(*totals)
    wide = kinds.withColumn("_ab", around(F.col("_aspect"), P.ASPECT_TOLERANCE))
    clip_untimed = wide.filter(~timed).join(sizes_any.select("*", aspect_of_sort), "_ab").filter(near)
    profile_untimed = wide.filter(timed).join(
        sizes_untimed.select("*", aspect_of_sort), "_ab").filter(near)

    cols = geometry + ["n", "first_profile"]
    per_kind = (both.select(cols).unionByName(clip_untimed.select(cols))
                .unionByName(profile_untimed.select(cols))
                .groupBy(*geometry).agg(*totals))
    return (clips.join(per_kind, geometry, "left")
            .select("clip_id", F.coalesce("n", F.lit(0)).alias("candidates"), "first_profile"))


def kept_gaps(kept: DataFrame, segment: int = P.SEGMENT_FRAMES) -> DataFrame:
    """Distance of each kept frame to the one kept before it in its clip."""
    before = previous_value(kept.select("clip_id", "frame_index"), ["clip_id"], "frame_index",
                            index_bucket("frame_index", segment), "before")
    return before.filter("before is not null").select(
        "clip_id", "frame_index",
        F.greatest(F.col("frame_index") - F.col("before"), F.lit(0)).alias("gap"))


def coverage_gap(kept: DataFrame, clips: DataFrame) -> DataFrame:
    """The longest stretch without a kept frame, per clip, when it stands out.

    The usual gap is the upper median.  It is read from counts per distinct gap,
    of which a clip has few however long it is, never from a list of all gaps.
    """
    counts = kept_gaps(kept).groupBy("clip_id", "gap").agg(F.count(F.lit(1)).alias("n"))
    up_to = W.partitionBy("clip_id").orderBy("gap")
    whole = W.partitionBy("clip_id")
    ranked = counts.select(
        "clip_id", "gap", F.sum("n").over(up_to).alias("upto"), F.sum("n").over(whole).alias("total"))
    usual = F.min(F.when(F.col("upto") > F.expr("total div 2"), F.col("gap")))
    per_clip = ranked.groupBy("clip_id").agg(usual.alias("usual"), F.max("gap").alias("worst"))
    rate = F.greatest(F.col("fps"), F.lit(1e-9))
    timed = clips.join(per_clip, "clip_id", "left").select(
        "clip_id", (F.col("usual") / rate).alias("usual_s"), (F.col("worst") / rate).alias("worst_s"))
    stands_out = ((F.col("usual_s") > 0) & (F.col("worst_s") >= P.GAP_MIN_SECONDS)
                  & (F.col("worst_s") / F.col("usual_s") >= P.GAP_VS_USUAL))
    return timed.select("clip_id", "usual_s", "worst_s",
                        F.when(stands_out, F.col("worst_s")).alias("gap_s"))


def part_hashes(parts: DataFrame, key: str) -> DataFrame:
    """(key, sha256) of files that come in parts (key, part, content), in the order of their parts.

    The parts of a file pass one after another and only the digest is carried along, so memory is bounded by a batch
    of parts, and a file may be larger than any cell.
    """
    kind = parts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, done = None, None, []
        for batch in batches:
            for this, content in zip(batch.column(0).to_pylist(), byte_rows(batch.column(2))):
                if digest is None or this != name:
                    if digest is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = this, hashlib.sha256()
                digest.update(content)
            yield _hashes(done, batch.schema.field(0).type)
            done = []
        if digest is not None:
            yield _hashes([(name, digest.hexdigest())], batch.schema.field(0).type)
    return (parts.select(key, "part", "content").repartition(key).sortWithinPartitions(key, "part")
            .mapInArrow(run, f"`{key}` {kind}, sha256 string"))


def _hashes(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string())], ["key", "sha256"])


def file_hashes(files: DataFrame, key: str = "path", block: int = 4 << 20) -> DataFrame:
    """(key, sha256) of files named by the column `key`, each read in blocks by its task; NULL if there is none."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _hashes([(name, _file_hash(name, block)) for name in batch.column(0).to_pylist()], pa.string())
    return files.select(key).mapInArrow(run, f"`{key}` {kind}, sha256 string")


def _file_hash(uri: str, block: int) -> str | None:
    from pyarrow import fs as pafs
    files, name = pafs.FileSystem.from_uri(uri)
    if files.get_file_info(name).type != pafs.FileType.File:
        return None
    digest = hashlib.sha256()
    with files.open_input_stream(name) as source:
        while data := source.read(block):
            digest.update(data)
    return digest.hexdigest()


def checksum_audit(files: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Hash file contents and compare with the recorded hashes.

    Files come whole (key, content), in parts (key, part, content), or as names to be read (key).
    A file with no record, or a record with no file, does not match.
    """
    if "part" in files.columns:
        hashed = part_hashes(files, key)
    elif "content" in files.columns:
        hashed = files.select(key, F.sha2(F.col("content"), 256).alias("sha256"))
    else:
        hashed = file_hashes(files, key)
    return hashed.join(recorded.select(key, F.col("sha256").alias("recorded")), key, "full").select(
        key, "sha256", "recorded",
        F.coalesce(F.col("sha256") == F.col("recorded"), F.lit(False)).alias("reusable"))


def source_ceiling(clips: DataFrame) -> DataFrame:
    """Smallest width and smallest height, each on its own."""
    return clips.agg(F.min("width").alias("width"), F.min("height").alias("height"))


def mixed_resolutions(clips: DataFrame) -> DataFrame:
    """The distinct clip sizes; more than one is worth a warning."""
    return clips.select("width", "height").distinct().orderBy("width", "height")
