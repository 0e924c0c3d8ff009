"""Queries that render frames, write datasets and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift import params as P
from framesift.functions import lens, pixels, segment
from framesift.functions.geometry import output_size
from framesift.operators import masks, metrics, records, selection
from framesift.operators.motion import motion_gated
from framesift.plans import views as V
from framesift.plans.imaging import _PX, _sql_resize
from framesift.plans.ordered import _MOTION, sharp8
from framesift.plans.registry import query
from framesift.session import scratch_path
from framesift.sources import frame_source as frame_files
from framesift.sources import images
from framesift.sources import manifest as manifest_source


class ChannelModel:
    """Stands in for a network: the logits are the three input channels."""

    def __call__(self):
        return lambda batch: batch

    def __eq__(self, other):
        return type(self) is type(other)

    def __hash__(self):
        return hash(type(self).__name__)


@query("segment_frames", V.ctes("rgb8") + f"""
    , n AS (SELECT clip_id, frame_index, list_transform(range(64), lambda i: [
        (CAST(r[i + 1] AS FLOAT) / 255 :: FLOAT - 0.485 :: FLOAT) / 0.229 :: FLOAT,
        (CAST(g[i + 1] AS FLOAT) / 255 :: FLOAT - 0.456 :: FLOAT) / 0.224 :: FLOAT,
        (CAST(b[i + 1] AS FLOAT) / 255 :: FLOAT - 0.406 :: FLOAT) / 0.225 :: FLOAT]) AS px FROM rgb8)
    SELECT clip_id, frame_index, {V.sql_hex('list_transform(px, lambda v: list_position(v, list_max(v)) - 1)')} AS labels
    FROM n""")
def segment_frames(spark, sf):
    model = ChannelModel()
    info = segment.inspect_model(model, V.SIDE, V.SIDE, (2,))
    return V.rgb8(spark, sf).select("clip_id", "frame_index", F.hex(
        segment.segment_frames("rgb", "width", "height", model, info)).alias("labels"))


_LENS_SQL = ", " + V.SQL["profiles"][1].strip().join(["profiles AS (", ")"]) + """,
    k AS (SELECT 0.18 :: DOUBLE AS k0, -0.04 :: DOUBLE AS k1, 0.19 :: DOUBLE AS k2, -0.14 :: DOUBLE AS k3),
    lim AS (SELECT coalesce(min(t) FILTER (WHERE 1 + 3 * k0 * t * t + 5 * k1 * pow(t * t, 2) + 7 * k2 * pow(t * t, 3)
                                               + 9 * k3 * pow(t * t, 4) <= 0), pi() / 2) AS cut
            FROM k, (SELECT i * (pi() / 2) / 4096 AS t FROM range(4097) AS g(i))),
    cam AS (SELECT clip_id, sx, k00 * 8 / calib_w * sx AS fx, k11 * 8 / calib_h * sy AS fy
            FROM (SELECT DISTINCT clip_id FROM rgb8) JOIN
                 (SELECT *, CASE WHEN stretch_x > 0.01 THEN stretch_x ELSE 1.0 END AS sx,
                         CASE WHEN stretch_y > 0.01 THEN stretch_y ELSE 1.0 END AS sy FROM profiles)
              ON profile_id = clip_id * 10 + 1),
    ray AS (SELECT clip_id, ox, oy, fx, fy, (ox + 0.5 :: DOUBLE - 2) / (fx / sx / 2) AS x,
                   (oy + 0.5 :: DOUBLE - 2) / (fy / sx / 2) AS y
            FROM cam, range(4) AS a(ox), range(4) AS b(oy)),
    bent AS (SELECT clip_id, ox, oy, fx, fy, x, y, sqrt(x * x + y * y) AS r, atan(sqrt(x * x + y * y)) AS th FROM ray),
    src AS (SELECT clip_id, ox, oy, th < cut AS seen,
                   x * (th * (1 + th * th * (k0 + th * th * (k1 + th * th * (k2 + th * th * k3)))) / r) * fx + 4 - 0.5 AS u,
                   y * (th * (1 + th * th * (k0 + th * th * (k1 + th * th * (k2 + th * th * k3)))) / r) * fy + 4 - 0.5 AS v
            FROM bent, k, lim),
    spot AS (SELECT clip_id, ox, oy, seen AND u BETWEEN -0.5 AND 7.5 AND v BETWEEN -0.5 AND 7.5 AS seen,
                  CAST(round_even(greatest(0, least(7, u)) * 32, 0) AS BIGINT) AS ui,
                  CAST(round_even(greatest(0, least(7, v)) * 32, 0) AS BIGINT) AS vi FROM src),
    wt AS (SELECT *, CAST(round_even(ui % 32 * (32 - vi % 32) / 4.0, 0) AS BIGINT) AS w01,
                  CAST(round_even((32 - ui % 32) * (vi % 32) / 4.0, 0) AS BIGINT) AS w10,
                  CAST(round_even((ui % 32) * (vi % 32) / 4.0, 0) AS BIGINT) AS w11 FROM spot),
    got AS (SELECT wt.clip_id, a.frame_index, ox AS x, oy AS y, a.ch,
                   CASE WHEN seen THEN ((256 - w01 - w10 - w11) * a.v + w01 * b.v + w10 * c.v + w11 * d.v + 128) >> 8 ELSE 0 END AS v
            FROM wt JOIN px a ON a.clip_id = wt.clip_id AND a.x = ui // 32 AND a.y = vi // 32
            JOIN px b ON b.clip_id = wt.clip_id AND b.frame_index = a.frame_index AND b.ch = a.ch AND b.x = least(ui // 32 + 1, 7) AND b.y = vi // 32
            JOIN px c ON c.clip_id = wt.clip_id AND c.frame_index = a.frame_index AND c.ch = a.ch AND c.x = ui // 32 AND c.y = least(vi // 32 + 1, 7)
            JOIN px d ON d.clip_id = wt.clip_id AND d.frame_index = a.frame_index AND d.ch = a.ch AND d.x = least(ui // 32 + 1, 7) AND d.y = least(vi // 32 + 1, 7)),
    every AS (SELECT * FROM got UNION ALL
              SELECT * FROM plain WHERE clip_id NOT IN (SELECT clip_id FROM cam))
    SELECT clip_id, frame_index, 4 AS out_w, 4 AS out_h,
           string_agg(printf('%02X', CAST(v AS INTEGER)), '' ORDER BY y, x, ch) AS rgb
    FROM every GROUP BY clip_id, frame_index"""


@query("undistort_frames", V.ctes("rgb8") + _PX + _sql_resize("plain", "px", (8, 8), (4, 4), "lanczos3") + _LENS_SQL)
def undistort_frames(spark, sf):
    """Every frame through the profile of its own part, at half size."""
    from framesift.plans.tabular import _profiles
    p = _profiles(spark, sf).select(
        "profile_id", "k00", "k11", "calib_w", "calib_h", "stretch_x", "stretch_y", "coeffs")
    frames = V.rgb8(spark, sf).withColumn("profile_id", F.col("clip_id") * 10 + 1)
    w, h = output_size(F.lit("scale"), F.lit(0.5), F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    f = frames.join(p, "profile_id", "left").withColumn("out_w", w).withColumn("out_h", h)
    straight = lens.undistort_frames(
        "rgb", "width", "height", "out_w", "out_h", "k00", "k11", "calib_w", "calib_h",
        "stretch_x", "stretch_y", "coeffs", P.INTERPOLATION)
    plain = pixels.resize_rgb("rgb", "width", "height", "out_w", "out_h")
    return f.select("clip_id", "frame_index", "out_w", "out_h",
                    F.hex(F.coalesce(straight, plain)).alias("rgb"))


def _decisions(spark, sf):
    return motion_gated(sharp8(spark, sf), 0.07, 4)


def _stem(df):
    return df.withColumn("stem", F.concat(F.lit("clip"), F.col("clip_id")))


_KEPT_SQL = V.ctes("sharp8", "rgb8", recursive=True) + _MOTION.format(where="").rsplit("SELECT s.clip_id", 1)[0]


@query("sink_images", _KEPT_SQL + f"""
    SELECT concat('clip', clip_id) AS stem, frame_index, 8 AS width, 8 AS height,
           {V.sql_hex('flatten(list_transform(range(64), lambda i: [r[i + 1], g[i + 1], b[i + 1]]))')} AS rgb
    FROM rgb8 JOIN kept USING (clip_id, frame_index)""")
def sink_images(spark, sf):
    """Kept frames written as images, then scanned back."""
    path = scratch_path(spark, "images")
    images.write_images(_stem(images.kept_only(V.rgb8(spark, sf), _decisions(spark, sf))), path)
    return images.read_image_frames(spark, path).withColumn("rgb", F.hex("rgb"))


@query("sink_masks", _KEPT_SQL.replace("WITH RECURSIVE ", "WITH RECURSIVE labels8 AS (" + V.SQL["labels8"][1].strip().replace("FROM frames8", f"FROM ({V.SQL['frames8'][1].strip()})") + "), ", 1) + """
    , m AS (SELECT clip_id, frame_index, labels, unnest(['sfm', 'training']) AS sidecar FROM labels8 JOIN kept USING (clip_id, frame_index))
    SELECT concat('clip', clip_id) AS stem, frame_index, sidecar, 16 AS width, 12 AS height,
           """ + V.sql_hex("""list_transform(range(192), lambda i:
               CASE WHEN labels[((i // 16) * 8 // 12) * 8 + (i % 16) * 8 // 16 + 1] = 3
                      OR (sidecar = 'sfm' AND labels[((i // 16) * 8 // 12) * 8 + (i % 16) * 8 // 16 + 1] = 2) THEN 0 ELSE 255 END)""") + """ AS mask
    FROM m""")
def sink_masks(spark, sf):
    """Masks of kept frames scaled to output size only now, written and scanned back."""
    path = scratch_path(spark, "masks")
    layers = {"sky": pixels.label_to_mask("labels", 2), "people": pixels.label_to_mask("labels", 3)}
    kept = images.kept_only(V.labels8(spark, sf), _decisions(spark, sf))
    sets = _stem(masks.mask_intersect(kept, layers))
    scaled = pixels.nn_scale("mask", F.lit(V.SIDE), F.lit(V.SIDE), F.lit(16), F.lit(12))
    images.write_masks(sets.withColumn("mask", scaled).withColumn("width", F.lit(16))
                       .withColumn("height", F.lit(12)), path)

    def back(sidecar):
        rows = images.read_masks(spark, f"{path}/{P.SIDECAR_DIRS[sidecar]}")
        # Sidecars are named after their image: stem_000001.png.png.
        return rows.withColumn("sidecar", F.lit(sidecar)).withColumn("mask", F.hex("mask"))
    return back("sfm").unionByName(back("training"))


@query("frames_to_table", _KEPT_SQL + f"""
    SELECT s.clip_id, s.frame_index, round(sharpness, 6) AS sharpness, k.frame_index IS NOT NULL AS keep,
           {V.sql_hex('gray')} AS gray
    FROM sharp8 s LEFT JOIN kept k ON k.clip_id = s.clip_id AND k.frame_index = s.frame_index""")
def frames_to_table(spark, sf):
    """Frames, metrics and decisions stored as one table, then read back."""
    path = scratch_path(spark, "frames")
    frames = sharp8(spark, sf)
    images.frames_to_table(frames.join(_decisions(spark, sf), ["clip_id", "frame_index"]), path)
    return spark.read.parquet(path).select(
        "clip_id", "frame_index", F.round("sharpness", 6).alias("sharpness"), "keep",
        F.hex("gray").alias("gray"))


@query("attach_decisions", _KEPT_SQL + f"""
    SELECT clip_id, frame_index, {V.sql_hex('r')} AS red FROM rgb8 JOIN kept USING (clip_id, frame_index)""")
def attach_decisions(spark, sf):
    """Frames lie in buckets; only the bitmaps of kept frames are brought to them."""
    store = images.FrameStore.write(V.rgb8(spark, sf), scratch_path(spark, "stored"))
    kept = store.kept(_decisions(spark, sf))
    return kept.select("clip_id", "frame_index", F.hex(pixels.channel("rgb", 0)).alias("red"))


@query("frame_source", V.ctes("rgb8") + f"""
    SELECT concat('clip', clip_id) AS stem, frame_index, 8 AS width, 8 AS height,
           {V.sql_hex('flatten(list_transform(range(64), lambda i: [r[i + 1], g[i + 1], b[i + 1]]))')} AS rgb
    FROM rgb8 WHERE clip_id IN (1, 4, 7) AND frame_index >= 3 AND frame_index < 40""")
def frame_source(spark, sf):
    """Frame files through the data source, which plans and opens only the clips and frames that are asked for."""
    path = scratch_path(spark, "images")
    images.write_images(_stem(V.rgb8(spark, sf)), path)
    frames = frame_files.frames_from(spark, path, task_frames=16)
    wanted = F.col("stem").isin("clip1", "clip4", "clip7") & (F.col("frame_index") >= 3) & (F.col("frame_index") < 40)
    return frames.where(wanted).withColumn("rgb", F.hex("rgb"))


def _manifest_parts(spark, sf):
    decided = selection.every_nth(V.metric_events(spark, sf), 5, 100.0)
    rec = records.clip_record(decided)
    clip = F.col("clip_id")
    clips = rec.select(
        clip, clip.alias("position"),
        F.concat(F.lit("in/user"), clip, F.lit(".mp4")).alias("path"),
        F.concat(F.lit("user"), clip).alias("stem"),
        F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        V.event_clip_fps(clip).alias("fps"), F.lit(None).cast("long").alias("frames_probed"),
        "frames_decoded", "frames_kept", F.lit(1920).alias("out_width"), F.lit(1080).alias("out_height"),
        F.lit(None).cast("array<double>").alias("pinhole_intrinsics"))
    totals = records.run_totals(rec.withColumn("carried", F.lit(False)).withColumn("wall_seconds", F.lit(0.0)))
    totals = totals.select("decoded", "kept", "written", "wall_seconds", "decoded_fps", "written_fps")
    return clips, selection.kept_chunks(decided, 16), totals


def _run_parameters():
    return [
        F.lit("framesift").alias("tool"),
        F.struct(
            F.struct(F.lit("same").alias("kind")).alias("output_size"),
            F.struct(F.lit("png").alias("format")).alias("format"),
            F.struct(F.struct(F.lit("every-nth").alias("mode"), F.lit(5).alias("n")).alias("mode"),
                     F.lit(100.0).alias("blur_floor")).alias("selection"),
            F.lit(P.INTERPOLATION).alias("interpolation")).alias("params")]


@query("sink_manifest", V.ctes("metric_events") + """,
    p AS (SELECT clip_id, frame_index, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS rn
          FROM metric_events WHERE NOT (sharpness < 100)),
    k AS (SELECT clip_id, frame_index FROM p WHERE (rn - 1) % 5 = 0),
    l AS (SELECT clip_id, frame_index // 16 AS chunk, string_agg(frame_index, ',' ORDER BY frame_index) AS kept_frames
          FROM k GROUP BY ALL),
    d AS (SELECT clip_id, count(*) AS frames_decoded FROM metric_events GROUP BY clip_id),
    n AS (SELECT clip_id, count(*) AS frames_kept FROM k GROUP BY clip_id)
    SELECT clip_id AS position, concat('user', clip_id) AS stem, 'every-nth' AS mode, true AS completed,
           frames_decoded, coalesce(frames_kept, 0) AS frames_kept, chunk, kept_frames,
           (SELECT count(*) FROM k) AS total_kept
    FROM d LEFT JOIN n USING (clip_id) LEFT JOIN l USING (clip_id)""")
def sink_manifest(spark, sf):
    """Two batches of finished clips recorded, the run closed, everything read back."""
    path = scratch_path(spark, "manifest")
    clips, kept, totals = _manifest_parts(spark, sf)
    manifest_source.start_run(spark.range(1).select(*_run_parameters()), path, "run", 0)
    for batch in (0, 1):
        mine = F.col("clip_id") % 2 == batch
        manifest_source.record_clips(clips.filter(mine), kept.filter(mine), path, "run", batch)
    manifest_source.finish_run(totals, path, "run", 0)
    run = manifest_source.recorded_run(spark, path, "run").select(
        "run_id", "completed", F.col("params.selection.mode.mode").alias("mode"),
        F.col("totals.kept").alias("total_kept"))
    lists = manifest_source.recorded_kept(spark, path, "run").select(
        "clip_id", "chunk",
        F.array_join(F.col("kept_frames").cast("array<string>"), ",").alias("kept_frames"))
    return (manifest_source.recorded_clips(spark, path, "run")
            .join(run, "run_id").join(lists, "clip_id", "left")
            .select("position", "stem", "mode", "completed", "frames_decoded", "frames_kept",
                    "chunk", "kept_frames", "total_kept"))


@query("build_dataset", V.ctes("sharpl8", recursive=True)
       + _MOTION.format(where="").replace("sharp8", "sharpl8").replace("0.07", "0.045").rsplit("SELECT s.clip_id", 1)[0] + """
    SELECT concat('clip', k.clip_id) AS stem, k.frame_index, d.frames_decoded, n.frames_kept
    FROM kept k JOIN (SELECT clip_id, count(*) AS frames_decoded FROM sharpl8 GROUP BY clip_id) d USING (clip_id)
    JOIN (SELECT clip_id, count(*) AS frames_kept FROM kept GROUP BY clip_id) n USING (clip_id)""")
def build_dataset_query(spark, sf):
    """A whole run over all frames: selection, images, manifest; images scanned back."""
    from framesift.dataset import DatasetConfig, build_dataset
    out = scratch_path(spark, "run")
    frames = V.rgb8(spark, sf)
    path = scratch_path(spark, "run-frames")
    images.frames_to_table(frames, path)
    clip = F.col("clip_id")
    clips = V.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("clip_id")).distinct().select(
        clip, clip.alias("position"), F.concat(F.lit("in/clip"), clip, F.lit(".mp4")).alias("path"),
        F.concat(F.lit("clip"), clip).alias("stem"), F.lit(V.SIDE).alias("width"), F.lit(V.SIDE).alias("height"),
        F.lit(30.0).alias("fps"))
    record = build_dataset(spark.read.parquet(path), clips, out, DatasetConfig(motion_threshold=0.045, window=4))
    found = images.read_image_frames(spark, f"{out}/images").select("stem", "frame_index")
    return found.join(record.select("stem", "frames_decoded", "frames_kept"), "stem")
