"""Queries over clip, profile, manifest and listing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift import params as P
from framesift.functions import geometry as G
from framesift.functions.text import image_ext, image_name, terms_of
from framesift.operators import audits, masks, records, replay, resume
from framesift.operators.ordering import index_bucket
from framesift.plans import views as V
from framesift.plans.registry import query
from framesift.session import materialise, scratch_path
from framesift.sources import clips as clip_source
from framesift.sources import manifest as manifest_source
from framesift.sources import profiles as profile_source


def _round(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


# --- scans -------------------------------------------------------------------------

def _inputs(spark, sf):
    """The folders of the listing, then every text file named on its own."""
    files = V.listing(spark, sf)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    folders = files.select(folder.alias("input")).distinct().select(
        F.regexp_extract("input", r"(\d+)$", 1).cast("int").alias("input_pos"), "input")
    named = files.filter(F.col("path").endswith(".txt")).select(
        F.lit(1000).alias("input_pos"), F.col("path").alias("input"))
    return folders.unionByName(named)


@query("scan_clip_list", V.ctes("listing") + """
    SELECT CAST(regexp_extract(path, 'd(\\d+)/', 1) AS INTEGER) AS input_pos, path FROM listing
    WHERE lower(regexp_extract(path, '\\.([^.]*)$', 1))
          IN ('mp4', 'mov', 'mkv', 'avi', 'mts', 'm2ts', 'webm')
    UNION ALL
    SELECT 1000 AS input_pos, path FROM listing WHERE path LIKE '%.txt'""")
def scan_clip_list(spark, sf):
    return clip_source.expand_inputs(V.listing(spark, sf), _inputs(spark, sf)).orderBy("input_pos", "path")


def _probe_json(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"streams":['),
        F.when(k % 13 == 5, F.lit("")).otherwise(F.concat(
            F.lit('{"codec_name":'), F.when(k % 3 == 0, F.lit('"hevc"')).otherwise(F.lit("null")),
            F.lit(',"width":'), F.when(k % 17 == 4, 0).otherwise(3840).cast("string"),
            F.lit(',"height":2160,"r_frame_rate":"'),
            F.when(k % 11 == 3, F.lit("0/0")).when(k % 11 == 4, F.lit("2000/1"))
            .when(k % 11 == 5, F.lit("junk")).otherwise(F.lit("60000/1001")), F.lit('"'),
            F.when(k % 3 == 1, F.lit("")).otherwise(F.concat(F.lit(',"nb_frames":"'), k, F.lit('"'))),
            F.when(k % 5 == 2, F.lit("")).otherwise(F.concat(F.lit(',"duration":"'), k % 600, F.lit('.5"'))),
            F.lit("}"))),
        F.lit('],"format":{'),
        F.when(k % 2 == 0, F.concat(F.lit('"duration":"'), k % 700, F.lit('.25"'))).otherwise(F.lit("")),
        F.lit("}}"))
    return o.select(F.concat(F.lit("in/clip."), k, F.lit(".mp4")).alias("path"), text.alias("report"))


@query("scan_clip_probe", """
    WITH r AS (
        SELECT o_orderkey AS k, o_orderkey % 13 <> 5 AS has,
               CASE o_orderkey % 11 WHEN 3 THEN 0.0 WHEN 4 THEN 2000.0 WHEN 5 THEN 0.0
                    ELSE CAST(60000 AS DOUBLE) / CAST(1001 AS DOUBLE) END AS rate,
               CASE WHEN o_orderkey % 5 <> 2 AND o_orderkey % 13 <> 5 THEN (o_orderkey % 600) + 0.5
                    WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 700) + 0.25 END AS duration
        FROM orders),
    f AS (SELECT k, has, CASE WHEN has THEN CAST(rate AS DOUBLE) ELSE 0.0 END AS fps,
                 CAST(duration AS DOUBLE) AS duration_s,
                 CASE WHEN has AND k % 17 <> 4 THEN 3840 ELSE 0 END AS width,
                 CASE WHEN has THEN 2160 ELSE 0 END AS height FROM r)
    SELECT concat('in/clip.', k, '.mp4') AS path, concat('clip.', k) AS stem,
           CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, round(fps, 6) AS fps,
           CASE WHEN has AND k % 3 <> 1 THEN k
                WHEN fps > 0 THEN CAST(round(duration_s * fps) AS BIGINT) END AS frames,
           CASE WHEN has AND k % 3 = 0 THEN 'hevc' END AS codec, duration_s,
           CASE WHEN NOT has THEN 'no video stream'
                WHEN width = 0 OR height = 0 THEN 'video size unknown'
                WHEN fps >= 1000 THEN 'frame rate refused' END AS error
    FROM f""")
def scan_clip_probe(spark, sf):
    return _round(clip_source.probe_clips(_probe_json(spark, sf)), "fps")


def _manifest_json(spark, sf):
    """One manifest document per order; older ones lack the optional fields."""
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    old = F.col("o_orderstatus") == "F"
    floor = F.when(k % 3 == 0, F.col("o_totalprice"))
    rule = F.struct(F.lit("motion-gated").alias("mode"), (k % 7 / 100.0).alias("motion_threshold"), (k % 5 + 2).alias("window"))
    params = F.struct(
        F.struct(F.lit("scale").alias("kind"), (F.lit(1.0) / (k % 4 + 1)).alias("factor")).alias("output_size"),
        F.struct(F.lower("o_orderstatus").alias("format")).alias("format"),
        F.struct(rule.alias("mode"), floor.alias("blur_floor")).alias("selection"),
        F.col("o_orderpriority").alias("interpolation"), F.when(~old, F.lit(True)).alias("gpu"))
    clip = F.struct(
        F.concat(F.lit("/in/"), F.col("o_custkey"), F.lit(".mp4")).alias("path"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("stem"),
        (k % 1000 + 20).alias("frames_decoded"), F.lit(2).alias("frames_kept"),
        F.when(~old, F.array(k % 10, k % 10 + 7)).alias("kept_frames"))
    # Older documents (status F) lack the fields that came later: absent, not null.
    doc = F.to_json(F.struct(F.lit("framesift").alias("tool"), k.alias("created_unix"),
                             F.when(~old, F.lit(False)).alias("completed"), params.alias("params"),
                             F.array(clip).alias("clips")))
    return o.select(k.alias("run_id"), doc.alias("document"))


@query("scan_manifest", """
    SELECT o_orderkey AS run_id, o_orderstatus = 'F' AS completed, o_orderstatus <> 'F' AS gpu,
           o_orderpriority AS interpolation, o_orderkey % 7 / 100.0 :: DOUBLE AS motion_threshold,
           concat('c', o_custkey) AS stem,
           CAST(o_orderkey % 1000 + 20 AS BIGINT) AS frames_decoded,
           CASE WHEN o_orderstatus = 'F' THEN ''
                ELSE concat(o_orderkey % 10, ',', o_orderkey % 10 + 7) END AS kept
    FROM orders""")
def scan_manifest(spark, sf):
    m = manifest_source.parse_manifests(_manifest_json(spark, sf), "run_id")
    runs = m.select("run_id", "completed", F.col("params.gpu").alias("gpu"),
                    F.col("params.interpolation").alias("interpolation"),
                    F.col("params.selection.mode.motion_threshold").alias("motion_threshold"), "clips")
    return manifest_source.manifest_clips(runs, "run_id", "completed", "gpu", "interpolation",
                                          "motion_threshold").select(
        "run_id", "completed", "gpu", "interpolation", "motion_threshold", "stem", "frames_decoded",
        F.array_join(F.col("kept_frames").cast("array<string>"), ",").alias("kept"))


@query("scan_lens_profiles", V.ctes("profiles") + """
    SELECT profile_id, name, camera, calib_w, calib_h, fps, k00, k11, stretch_x, stretch_y
    FROM profiles""")
def scan_lens_profiles(spark, sf):
    return _profiles(spark, sf).select(
        "profile_id", "name", "camera", "calib_w", "calib_h", "fps", "k00", "k11", "stretch_x",
        "stretch_y")


def _profiles(spark, sf):
    return profile_source.scan_lens_profiles(V.profile_json(spark, sf), "profile_id")


@query("rejected_profiles", """
    SELECT p_partkey AS profile_id,
           CASE WHEN p_partkey % 7 = 0 THEN 'no distortion coefficients'
                ELSE 'no calibration dimensions' END AS error
    FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0""")
def rejected_profiles(spark, sf):
    return profile_source.rejected_profiles(V.profile_json(spark, sf), "profile_id")


@query("scan_profile_index", """
    SELECT concat(p_brand, '/', p_name, '_', p_partkey, CASE WHEN p_size % 2 = 0 THEN '.JSON' ELSE '.json' END) AS path
    FROM part""")
def scan_profile_index(spark, sf):
    p = V.table(spark, sf, "part")
    base = F.concat("p_brand", F.lit("/"), "p_name", F.lit("_"), "p_partkey")
    name = F.concat(base, F.when(F.col("p_size") % 2 == 0, F.lit(".JSON")).otherwise(F.lit(".json")))

    def node(path, kind):
        return F.struct(path.alias("path"), F.lit(kind).alias("type"))
    doc = F.to_json(F.struct(F.array(
        node(F.col("p_brand"), "tree"), node(name, "blob"),
        node(F.concat(base, F.lit(".md")), "blob"),
        node(F.concat(base, F.lit(".json")), "tree")).alias("tree")))
    return profile_source.scan_profile_index(p.select(doc.alias("document")))


@query("sample_frame_at", V.ctes("metric_events") + """,
    c AS (SELECT clip_id, count(*) AS n,
                 CASE clip_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 10.0 END :: DOUBLE AS fps
          FROM metric_events GROUP BY clip_id),
    p AS (SELECT clip_id, what, fps, n,
                 least(greatest(pos, 0.0), 0.98) * coalesce(
                     CASE WHEN clip_id % 5 <> 4 THEN n / fps END,
                     CASE WHEN clip_id % 3 <> 2 THEN n / greatest(fps, 1.0) END, 10.0) AS start_s
          FROM c, (VALUES ('thumbnail', 0.1 :: DOUBLE), ('preview', 1.5 :: DOUBLE)) AS v(what, pos)),
    t AS (SELECT clip_id, what, start_s, CAST(round(start_s * fps) AS BIGINT) AS frame_index FROM p)
    SELECT t.clip_id, t.what, round(t.start_s, 6) AS start_s, t.frame_index, e.sharpness
    FROM t LEFT JOIN metric_events e ON e.clip_id = t.clip_id AND e.frame_index = t.frame_index""")
def sample_frame_at(spark, sf):
    frames = V.metric_events(spark, sf)
    c = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "fps", V.event_clip_fps(F.col("clip_id")))
    duration = F.when(F.col("clip_id") % 5 != 4, F.col("n") / F.col("fps"))
    frame_count = F.when(F.col("clip_id") % 3 != 2, F.col("n"))
    wanted = F.explode(F.array(
        F.struct(F.lit("thumbnail").alias("what"), F.lit(0.1).alias("pos")),
        F.struct(F.lit("preview").alias("what"), F.lit(1.5).alias("pos"))))
    asked = c.withColumn("w", wanted)
    start, index = G.position_index(F.col("w.pos"), duration, frame_count, F.col("fps"))
    at = asked.select("clip_id", "w.what", F.round(start, 6).alias("start_s"), index.alias("frame_index"))
    return at.join(frames.select("clip_id", "frame_index", "sharpness"),
                   ["clip_id", "frame_index"], "left")


# --- scalar projections -------------------------------------------------------------

@query("resolve_output_size", V.ctes("clips") + """,
    s AS (SELECT *, CASE priority WHEN '1-URGENT' THEN 'same' WHEN '2-HIGH' THEN 'exact' ELSE 'scale' END AS kind,
                 ((clip_id % 90) + 1) / 10.0 :: DOUBLE AS factor FROM clips)
    SELECT clip_id, kind,
           CAST(CASE kind WHEN 'same' THEN width WHEN 'exact' THEN 1919
                WHEN 'scale' THEN CASE WHEN factor <= 8 THEN greatest(round(width * factor), 2) END END AS INTEGER) // 2 * 2 AS out_w,
           CAST(CASE kind WHEN 'same' THEN height WHEN 'exact' THEN 1079
                WHEN 'scale' THEN CASE WHEN factor <= 8 THEN greatest(round(height * factor), 2) END END AS INTEGER) // 2 * 2 AS out_h
    FROM s""")
def resolve_output_size(spark, sf):
    c = V.clips(spark, sf)
    kind = (F.when(F.col("priority") == "1-URGENT", "same")
            .when(F.col("priority") == "2-HIGH", "exact").otherwise("scale"))
    factor = ((F.col("clip_id") % 90) + 1) / F.lit(10.0)
    w, h = G.output_size(kind, factor, F.lit(1919), F.lit(1079), F.col("width"), F.col("height"))
    return c.select("clip_id", kind.alias("kind"), w.alias("out_w"), h.alias("out_h"))


@query("image_name", V.ctes("clips") + """
    SELECT clip_id, printf('%s_%06d.%s', stem, clip_id * 1003,
                           CASE WHEN status = 'F' THEN 'png' ELSE 'jpg' END) AS name
    FROM clips""")
def image_name_query(spark, sf):
    ext = image_ext(F.when(F.col("status") == "F", "png").otherwise("jpeg"))
    return V.clips(spark, sf).select(
        "clip_id", image_name(F.col("stem"), F.col("clip_id") * 1003, ext).alias("name"))


_INTRINSICS = """,
    l AS (SELECT c.clip_id, c.stem, c.width, c.height, p.calib_w, p.calib_h, p.k00, p.k11,
                 CAST(c.width // 4 * 2 AS INTEGER) AS out_w, CAST(c.height // 4 * 2 AS INTEGER) AS out_h,
                 CASE WHEN stretch_x > 0.01 THEN stretch_x ELSE 1.0 END AS sx,
                 CASE WHEN stretch_y > 0.01 THEN stretch_y ELSE 1.0 END AS sy
          FROM clips c {join} JOIN profiles p ON p.profile_id = c.profile_id),
    i AS (SELECT *, CAST(width AS DOUBLE) / greatest(out_w, 1) AS fov,
                 k00 * (CAST(width AS DOUBLE) / calib_w * sx) * (1.0 / sx) / (CAST(width AS DOUBLE) / greatest(out_w, 1)) AS fx,
                 k11 * (CAST(height AS DOUBLE) / calib_h * sy) * (1.0 / sx) / (CAST(width AS DOUBLE) / greatest(out_w, 1)) AS fy
          FROM l)"""


def _with_lens(spark, sf, how="inner"):
    """Clips with the profile of their run and the size they are written at."""
    p = _profiles(spark, sf).select("profile_id", "calib_w", "calib_h", "k00", "k11", "stretch_x", "stretch_y")
    c = V.clips(spark, sf).join(p, "profile_id", how)
    half = F.lit(0.5)
    w, h = G.output_size(F.lit("scale"), half, F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    return c.withColumn("out_w", w).withColumn("out_h", h)


def _intrinsics(df):
    values = G.pinhole_intrinsics(*[F.col(n) for n in (
        "k00", "k11", "calib_w", "calib_h", "stretch_x", "stretch_y", "width", "height", "out_w", "out_h")])
    for name, v in zip(("fx", "fy", "cx", "cy"), values):
        df = df.withColumn(name, v)
    return df


@query("pinhole_intrinsics", V.ctes("clips", "profiles") + _INTRINSICS.format(join="") + """
    SELECT clip_id, round(fx, 6) AS fx, round(fy, 6) AS fy, out_w / 2.0 :: DOUBLE AS cx, out_h / 2.0 :: DOUBLE AS cy
    FROM i""")
def pinhole_intrinsics(spark, sf):
    return _round(_intrinsics(_with_lens(spark, sf)), "fx", "fy").select("clip_id", "fx", "fy", "cx", "cy")


@query("lens_for_clips", V.ctes("clips", "profiles") + _INTRINSICS.format(join="LEFT") + """
    SELECT clip_id, calib_w, calib_h, out_w, out_h, round(fov, 6) AS fov, calib_w IS NOT NULL AS corrected
    FROM i""")
def lens_for_clips(spark, sf):
    c = _with_lens(spark, sf, "left")
    return c.select("clip_id", "calib_w", "calib_h", "out_w", "out_h",
                    F.round(G.fov(F.col("width"), F.col("out_w")), 6).alias("fov"),
                    F.col("calib_w").isNotNull().alias("corrected"))


@query("sink_cameras", V.ctes("clips", "profiles") + _INTRINSICS.format(join="LEFT") + """,
    n AS (SELECT *, row_number() OVER (ORDER BY clip_id) AS camera_id FROM i)
    SELECT concat(camera_id, ' PINHOLE ', out_w, ' ', out_h, ' ',
           regexp_replace(CAST(fx AS VARCHAR), '\\.0$', ''), ' ', regexp_replace(CAST(fy AS VARCHAR), '\\.0$', ''), ' ',
           regexp_replace(CAST(out_w / 2.0 :: DOUBLE AS VARCHAR), '\\.0$', ''), ' ',
           regexp_replace(CAST(out_h / 2.0 :: DOUBLE AS VARCHAR), '\\.0$', '')) AS line
    FROM n WHERE fx IS NOT NULL
    UNION ALL SELECT concat('# ', camera_id, ': images ', stem, '_*') FROM n WHERE fx IS NOT NULL
    UNION ALL SELECT unnest([""" + ", ".join(f"'{h}'" for h in manifest_source.CAMERA_HEADER) + """])""")
def sink_cameras(spark, sf):
    """The camera file written and read back, line by line."""
    path = scratch_path(spark, "cameras")
    manifest_source.write_cameras(
        manifest_source.camera_rows(_intrinsics(_with_lens(spark, sf, "left")), "clip_id"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("cover_crop", V.ctes("clips") + """,
    s AS (SELECT *, greatest(320 / CAST(width AS DOUBLE), 180 / CAST(height AS DOUBLE)) AS scale FROM clips),
    z AS (SELECT clip_id, greatest(CAST(round(width * scale) AS INTEGER), 320) AS scaled_w,
                 greatest(CAST(round(height * scale) AS INTEGER), 180) AS scaled_h FROM s)
    SELECT clip_id, scaled_w, scaled_h, CAST((scaled_w - 320) // 2 AS INTEGER) AS crop_x,
           CAST((scaled_h - 180) // 2 AS INTEGER) AS crop_y FROM z""")
def cover_crop(spark, sf):
    c = V.clips(spark, sf)
    cols = G.cover_crop(F.col("width"), F.col("height"), F.lit(320), F.lit(180))
    return c.select("clip_id", *[v.alias(k) for k, v in cols.items()])


@query("metric_thumbnail_size", V.ctes("clips") + """
    SELECT clip_id, CAST(least(width, 480) AS INTEGER) AS thumb_w,
           CAST(CASE WHEN width <= 480 THEN height ELSE greatest(height :: BIGINT * 480 // width, 1) END AS INTEGER) AS thumb_h,
           640 AS infer_w, CAST(ceil(greatest(height :: BIGINT * 640 // width, 32) / 32.0) * 32 AS INTEGER) AS infer_h
    FROM clips""")
def metric_thumbnail_size(spark, sf):
    from framesift.functions.pixels import metric_height, metric_width
    iw, ih = G.inference_size(F.col("width"), F.col("height"))
    return V.clips(spark, sf).select(
        "clip_id", metric_width("width").alias("thumb_w"), metric_height("width", "height").alias("thumb_h"),
        iw.alias("infer_w"), ih.alias("infer_h"))


@query("search_terms", """
    SELECT p_partkey AS part, array_to_string(list_transform(string_split(trim(concat(p_name, ' ', p_type)), ' '), lambda t: lower(t)), '|') AS terms
    FROM part""")
def search_terms(spark, sf):
    p = V.table(spark, sf, "part")
    typed = F.concat(F.lit(" "), "p_name", F.lit("\t "), "p_type", F.lit(" "))
    return p.select(F.col("p_partkey").alias("part"), F.array_join(terms_of(typed), "|").alias("terms"))


@query("profile_search", V.ctes("profile_paths") + """
    SELECT path FROM profile_paths WHERE contains(lower(path), 'brand#1') AND contains(lower(path), 'economy')
    ORDER BY path""")
def profile_search(spark, sf):
    return profile_source.search(V.profile_paths(spark, sf), " Brand#1\tECONOMY ").orderBy("path")


@query("profile_search_many", V.ctes("profile_paths") + """,
    searches AS (SELECT DISTINCT p_brand AS search_id, concat(' ', upper(p_brand), ' ', split_part(p_type, ' ', 1)) AS query FROM part
                 UNION ALL SELECT DISTINCT concat('size ', p_size), concat('_', p_size % 10, '  ', chr(97 + p_size % 26)) FROM part),
    terms AS (SELECT search_id, query, list_filter(string_split(lower(query), ' '), lambda t: t <> '') AS terms FROM searches)
    SELECT search_id, query, path FROM terms JOIN profile_paths
      ON len(list_filter(terms, lambda t: NOT contains(lower(path), t))) = 0""")
def profile_search_many(spark, sf):
    """Long terms and short ones, of many searches at once."""
    part = V.table(spark, sf, "part")
    long = part.select(F.col("p_brand").alias("search_id"), F.concat(
        F.lit(" "), F.upper("p_brand"), F.lit(" "), F.split_part("p_type", F.lit(" "), F.lit(1))).alias("query"))
    short = part.select(F.concat(F.lit("size "), "p_size").alias("search_id"), F.concat(
        F.lit("_"), F.col("p_size") % 10, F.lit("  "), F.char(F.col("p_size") % 26 + 97)).alias("query"))
    searches = materialise(long.unionByName(short).distinct().withColumn("id", F.monotonically_increasing_id()), "searches")
    index = profile_source.search_index(V.profile_paths(spark, sf))
    hits = profile_source.search_many(index, searches.select(F.col("id").alias("search_id"), "query"))
    return hits.withColumnRenamed("search_id", "id").join(searches, "id").select("search_id", "query", "path")


@query("search_top100", V.ctes("profile_paths") + """
    SELECT path FROM profile_paths WHERE contains(lower(path), 'brand') ORDER BY path LIMIT 100""")
def search_top100(spark, sf):
    return profile_source.search_top(V.profile_paths(spark, sf), "BRAND")


# --- validation ---------------------------------------------------------------------

@query("frame_rate_check", """
    SELECT concat('in/', o_orderkey, '.mp4') AS path, o_totalprice / 100.0 AS fps,
           concat('in/', o_orderkey, '.mp4', ': a rate of ', CAST(round(o_totalprice / 100.0) AS BIGINT),
                  ' frames per second is refused') AS message
    FROM orders WHERE o_totalprice / 100.0 >= 1000""")
def frame_rate_check(spark, sf):
    o = V.table(spark, sf, "orders")
    return audits.frame_rate_check(o.select(
        F.concat(F.lit("in/"), "o_orderkey", F.lit(".mp4")).alias("path"),
        (F.col("o_totalprice") / 100.0).alias("fps")))


@query("frame_size_check", """
    WITH probed AS (SELECT o_orderkey AS clip_id, CASE o_orderkey % 3 WHEN 0 THEN 3840 WHEN 1 THEN 1920 ELSE 2704 END AS w,
                           CASE o_orderkey % 3 WHEN 0 THEN 2880 WHEN 1 THEN 1080 ELSE 1520 END AS h FROM orders),
    f AS (SELECT l_orderkey AS clip_id, l_linenumber :: BIGINT AS frame_index, l_shipdate,
                 w, h, CASE WHEN l_returnflag = 'R' THEN 64 ELSE w END AS fw, h AS fh
          FROM lineitem JOIN probed ON clip_id = l_orderkey)
    SELECT clip_id, frame_index,
           printf('frame is %dx%d, its clip was probed as %dx%d', fw, fh, w, h) AS message
    FROM f WHERE fw <> w OR fh <> h""")
def frame_size_check(spark, sf):
    line = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("long").alias("frame_index"),
        "l_returnflag")
    pick = F.pmod(F.col("clip_id"), F.lit(3))
    frames = line.select(
        "clip_id", "frame_index",
        F.when(F.col("l_returnflag") == "R", 64).otherwise(V._pick(pick, V.WIDTHS)).alias("width"),
        V._pick(pick, V.HEIGHTS).alias("height"))
    return audits.frame_size_check(frames, V.clips(spark, sf))


_MISMATCH = """
    CASE WHEN abs(calib_w / CAST(calib_h AS DOUBLE) - width / CAST(height AS DOUBLE)) > 0.02
         THEN printf('aspect: profile %dx%d (%.2f:1), clip %dx%d (%.2f:1)',
                     calib_w, calib_h, calib_w / CAST(calib_h AS DOUBLE), width, height, width / CAST(height AS DOUBLE))
         WHEN p.fps > 0 AND c.fps > 0 AND abs(p.fps - c.fps) > 1.0
         THEN printf('rate: profile %.2f fps, clip %.2f fps', p.fps, c.fps) END"""


@query("profile_mismatch", V.ctes("clips", "profiles") + f"""
    SELECT clip_id, {_MISMATCH} AS problem
    FROM clips c JOIN profiles p ON p.profile_id = c.profile_id""")
def profile_mismatch(spark, sf):
    p = _profiles(spark, sf).select("profile_id", "calib_w", "calib_h", F.col("fps").alias("profile_fps"))
    c = V.clips(spark, sf).join(p, "profile_id")
    return c.select("clip_id", audits.profile_mismatch(*[F.col(n) for n in (
        "calib_w", "calib_h", "profile_fps", "width", "height", "fps")]).alias("problem"))


@query("profile_candidates", V.ctes("clips", "profiles") + """,
    k AS (SELECT DISTINCT width, height, fps FROM clips),
    n AS (SELECT k.width, k.height, k.fps, count(*) AS n, min(profile_id) AS first_profile
          FROM k JOIN profiles p
            ON abs(calib_w / CAST(calib_h AS DOUBLE) - width / CAST(height AS DOUBLE)) <= 0.02
           AND (p.fps <= 0 OR k.fps <= 0 OR abs(p.fps - k.fps) <= 1.0)
          GROUP BY ALL)
    SELECT clip_id, coalesce(n, 0) AS candidates, first_profile
    FROM clips LEFT JOIN n USING (width, height, fps)""")
def profile_candidates(spark, sf):
    return audits.profile_candidates(V.clips(spark, sf), _profiles(spark, sf))


def _runs(spark, sf):
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("run_id"), F.col("o_custkey").alias("out_dir"), (k % 2 == 0).alias("resume"),
        F.when(k % 5 == 0, "scale 0.5").otherwise("same").alias("output_size"),
        F.lit("jpeg 95").alias("format"),
        F.when(k % 7 == 0, "every-nth 15").otherwise("motion 0.04/8").alias("selection"),
        F.col("o_orderpriority").alias("interpolation"),
        (k % 11 == 0).alias("gpu"),
        F.when(F.col("o_totalprice") > 200000, "sky").alias("masking"),
        F.when(k % 3 != 0, F.sha2(F.concat(F.lit("p"), k % 2), 256)).alias("profile_sha"),
        "o_orderstatus")


@query("parameter_diff", """
    WITH r AS (
        SELECT o_orderkey AS run_id, o_custkey AS out_dir, o_orderkey % 2 = 0 AS resume,
               CASE WHEN o_orderkey % 5 = 0 THEN 'scale 0.5' ELSE 'same' END AS output_size,
               CASE WHEN o_orderkey % 7 = 0 THEN 'every-nth 15' ELSE 'motion 0.04/8' END AS selection,
               o_orderpriority AS interpolation, o_orderkey % 11 = 0 AS gpu, o_orderstatus,
               CASE WHEN o_totalprice > 200000 THEN 'sky' END AS masking,
               CASE WHEN o_orderkey % 3 <> 0 THEN sha256(concat('p', o_orderkey % 2)) END AS profile_sha
        FROM orders),
    prev AS (SELECT * FROM r WHERE o_orderstatus = 'F'
             QUALIFY row_number() OVER (PARTITION BY out_dir ORDER BY run_id) = 1),
    d AS (SELECT r.run_id, r.out_dir, r.resume, p.run_id AS prev_id, nullif(concat_ws('; ',
            CASE WHEN p.output_size IS DISTINCT FROM r.output_size THEN concat('output size (', coalesce(p.output_size, 'none'), ' then, ', coalesce(r.output_size, 'none'), ' now)') END,
            CASE WHEN p.selection IS DISTINCT FROM r.selection THEN concat('frame selection (', coalesce(p.selection, 'none'), ' then, ', coalesce(r.selection, 'none'), ' now)') END,
            CASE WHEN p.interpolation IS DISTINCT FROM r.interpolation THEN concat('interpolation (', coalesce(p.interpolation, 'none'), ' then, ', coalesce(r.interpolation, 'none'), ' now)') END,
            CASE WHEN p.gpu IS DISTINCT FROM r.gpu THEN concat('gpu undistortion (', p.gpu, ' then, ', r.gpu, ' now)') END,
            CASE WHEN p.masking IS DISTINCT FROM r.masking THEN concat('masking (', coalesce(p.masking, 'none'), ' then, ', coalesce(r.masking, 'none'), ' now)') END,
            CASE WHEN p.profile_sha IS DISTINCT FROM r.profile_sha THEN concat('lens profile (', coalesce(p.profile_sha, 'none'), ' then, ', coalesce(r.profile_sha, 'none'), ' now)') END), '') AS diff
          FROM r LEFT JOIN prev p ON p.out_dir = r.out_dir)
    SELECT run_id, out_dir, CASE WHEN prev_id IS NOT NULL THEN diff END AS differences,
           CASE WHEN prev_id IS NULL THEN 'new' WHEN diff IS NULL AND resume THEN 'carry'
                WHEN diff IS NULL THEN 'overwrite' WHEN resume THEN 'resume refused'
                ELSE 'different dataset' END AS verdict
    FROM d""")
def parameter_diff(spark, sf):
    # A folder holds its first finished run, if one finished.
    runs = _runs(spark, sf)
    fields = [c for c in runs.columns if c != "out_dir"]
    first = (runs.filter("o_orderstatus = 'F'").groupBy("out_dir")
             .agg(F.min(F.struct(*fields)).alias("r")).select("out_dir", "r.*"))
    return resume.parameter_diff(runs, first, "out_dir").select("run_id", "out_dir", "differences", "verdict")


# --- replay and resume ----------------------------------------------------------------

def _stemmed(spark, sf):
    return V.metric_events(spark, sf).withColumn("stem", F.concat(F.lit("user"), "clip_id"))


@query("replay_selection", V.ctes("kept_frames") + """
    SELECT m.clip_id, concat('user', m.clip_id) AS stem, m.frame_index, k.stem IS NOT NULL AS keep
    FROM metric_events m LEFT JOIN kept_frames k ON k.clip_id = m.clip_id AND k.frame_index = m.frame_index""")
def replay_selection(spark, sf):
    return replay.replay_selection(_stemmed(spark, sf), V.kept_frames(spark, sf).select("stem", "frame_index"))


@query("replay_missing", V.ctes("kept_frames") + """,
    r AS (SELECT stem, frame_index * 2 AS frame_index FROM kept_frames),
    f AS (SELECT concat('user', clip_id) AS stem, frame_index FROM metric_events)
    SELECT r.stem, count(*) FILTER (WHERE f.stem IS NULL) AS missing, count(*) AS total,
           concat(count(*) FILTER (WHERE f.stem IS NULL), ' of ', count(*), ' recorded frames were not found') AS message
    FROM r LEFT JOIN f ON f.stem = r.stem AND f.frame_index = r.frame_index
    GROUP BY r.stem HAVING count(*) FILTER (WHERE f.stem IS NULL) > 0""")
def replay_missing(spark, sf):
    # A list recorded on footage with twice the frames.
    kept = V.kept_frames(spark, sf).select("stem", (F.col("frame_index") * 2).alias("frame_index"))
    return replay.replay_missing(_stemmed(spark, sf), kept)


@query("replay_preflight", """
    WITH m AS (SELECT concat('GX', o_custkey) AS stem, o_orderkey AS position,
                      CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 50 + 1 END AS n FROM orders),
    l AS (SELECT stem, max_by(n, position) AS n FROM m GROUP BY stem)
    SELECT c_custkey AS clip_id, concat('GX', c_custkey) AS stem, CAST(coalesce(n, 0) AS INTEGER) AS recorded,
           CASE WHEN coalesce(n, 0) = 0 THEN concat('no kept frames recorded for clip GX', c_custkey) END AS problem
    FROM customer LEFT JOIN l ON l.stem = concat('GX', c_custkey)""")
def replay_preflight(spark, sf):
    k = F.col("o_orderkey")
    recorded = V.table(spark, sf, "orders").select(
        F.concat(F.lit("GX"), "o_custkey").alias("stem"), k.alias("position"),
        F.when(k % 4 == 0, F.array().cast("array<bigint>"))
        .otherwise(F.sequence(F.lit(0).cast("bigint"), k % 50)).alias("kept_frames"))
    wanted = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("clip_id"), F.concat(F.lit("GX"), "c_custkey").alias("stem"))
    return replay.replay_preflight(wanted, recorded)


def _previous_records(spark, sf):
    """Records of an earlier run: closed clips under their path, pending ones moved."""
    c = V.clips(spark, sf)
    return c.filter("status <> 'O'").select(
        F.col("clip_id").alias("position"), "clip_id", "stem",
        F.when(F.col("status") == "F", F.col("path")).otherwise(F.concat(F.lit("old/"), "path")).alias("path"))


_PREVIOUS = """,
    prev AS (SELECT clip_id AS position, stem, CASE WHEN status = 'F' THEN path ELSE concat('old/', path) END AS path
             FROM clips WHERE status <> 'O'),
    by_path AS (SELECT path, min(position) AS p FROM prev GROUP BY path),
    by_stem AS (SELECT stem, min(position) AS p FROM prev GROUP BY stem),
    found AS (SELECT c.clip_id, coalesce(a.p, b.p) AS previous_position,
                     CASE WHEN a.p IS NOT NULL THEN 'path' WHEN b.p IS NOT NULL THEN 'stem' END AS matched_by
              FROM clips c LEFT JOIN by_path a ON a.path = c.path LEFT JOIN by_stem b ON b.stem = c.stem)"""


@query("find_previous_clip", V.ctes("clips") + _PREVIOUS + """
    SELECT clip_id, previous_position, matched_by FROM found""")
def find_previous_clip(spark, sf):
    return resume.find_previous_clip(V.clips(spark, sf), _previous_records(spark, sf).drop("clip_id")).select(
        "clip_id", "previous_position", "matched_by")


def _intact_inputs(spark, sf):
    kept = materialise(V.kept_frames(spark, sf), "kept")
    counts = kept.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    claimed = counts.select("clip_id", (F.col("n") + F.when(F.col("clip_id") % 13 == 0, 1).otherwise(0))
                            .alias("frames_kept"))
    claimed = materialise(claimed, "claimed")
    # On disk: everything but the masks of very sharp late frames.
    expected = resume.expected_files(kept, "jpg", ["sfm", "training"])
    on_disk = expected.filter(~(F.col("path").like("masks_train/%") & F.col("path").rlike("0000[67]\\d")))
    return claimed, kept, on_disk.select("path")


_INTACT = """,
    files AS (SELECT clip_id, unnest([n, concat('masks/', n, '.png'), concat('masks_train/', n, '.png')]) AS path
              FROM (SELECT clip_id, printf('%s_%06d.jpg', stem, frame_index) AS n FROM kept_frames)),
    disk AS (SELECT path FROM files WHERE NOT (path LIKE 'masks_train/%' AND regexp_matches(path, '0000[67]\\d'))),
    absent AS (SELECT clip_id, count(*) AS m FROM files WHERE path NOT IN (SELECT path FROM disk) GROUP BY clip_id),
    rec AS (SELECT clip_id, count(*) AS listed,
                   count(*) + CASE WHEN clip_id % 13 = 0 THEN 1 ELSE 0 END AS frames_kept
            FROM kept_frames GROUP BY clip_id),
    intact AS (SELECT rec.clip_id, frames_kept, listed, coalesce(m, 0) AS files_missing,
                      listed = frames_kept AND coalesce(m, 0) = 0 AS intact
               FROM rec LEFT JOIN absent USING (clip_id))"""


@query("clip_intact", V.ctes("kept_frames") + _INTACT + """
    SELECT clip_id, frames_kept, listed, files_missing, intact FROM intact""")
def clip_intact(spark, sf):
    claimed, kept, disk = _intact_inputs(spark, sf)
    return resume.clip_intact(claimed, kept, disk, "jpg", ["sfm", "training"]).select(
        "clip_id", "frames_kept", "listed", "files_missing", "intact")


def _resume(spark, sf):
    claimed, kept, disk = _intact_inputs(spark, sf)
    intact = materialise(resume.clip_intact(claimed, kept, disk, "jpg", ["sfm", "training"]), "intact")
    users = V.table(spark, sf, "events").select(F.col("user_id").alias("clip_id")).distinct()
    clips = users.select("clip_id", F.col("clip_id").alias("position"),
                         F.concat(F.lit("in/user"), "clip_id", F.lit(".mp4")).alias("path"),
                         F.concat(F.lit("user"), "clip_id").alias("stem"))
    previous = claimed.select(
        F.col("clip_id").alias("position"), "clip_id",
        F.concat(F.lit("in/user"), "clip_id", F.lit(".mp4")).alias("path"),
        F.concat(F.lit("user"), "clip_id").alias("stem"))
    return clips, claimed, resume.resume_plan(clips.drop("position"), previous, intact)


@query("resume_plan", V.ctes("kept_frames") + _INTACT + """
    SELECT u.clip_id, CASE WHEN coalesce(i.intact, false) THEN 'carried' ELSE 'todo' END AS action
    FROM (SELECT DISTINCT user_id AS clip_id FROM events) u LEFT JOIN intact i USING (clip_id)""")
def resume_plan(spark, sf):
    return _resume(spark, sf)[2].select("clip_id", "action")


@query("combined_manifest", V.ctes("kept_frames") + _INTACT + """,
    plan AS (SELECT u.clip_id, coalesce(i.intact, false) AS carried
             FROM (SELECT DISTINCT user_id AS clip_id FROM events) u LEFT JOIN intact i USING (clip_id)),
    fresh AS (SELECT clip_id, count(*) AS decoded, count(*) FILTER (WHERE sharpness >= 100) AS kept
              FROM metric_events GROUP BY clip_id)
    SELECT clip_id AS position, carried, decoded AS frames_decoded,
           CASE WHEN carried THEN listed ELSE kept END AS frames_kept
    FROM plan JOIN fresh USING (clip_id) LEFT JOIN intact USING (clip_id) ORDER BY position""")
def combined_manifest(spark, sf):
    clips, claimed, plan = _resume(spark, sf)
    decided = V.metric_events(spark, sf).select(
        "clip_id", "frame_index", (F.col("sharpness") >= 100).alias("keep"))
    fresh = records.clip_record(decided).select("clip_id", "frames_decoded", "frames_kept")
    action = materialise(plan.select("clip_id", "action"), "plan")
    fresh = materialise(fresh, "fresh")
    decoded = fresh.select("clip_id", "frames_decoded")
    carried = (action.filter("action = 'carried'").join(claimed, "clip_id").join(decoded, "clip_id")
               .select(F.col("clip_id").alias("position"), F.lit(True).alias("carried"),
                       "frames_decoded", "frames_kept"))
    processed = (action.filter("action = 'todo'").join(fresh, "clip_id")
                 .select(F.col("clip_id").alias("position"), F.lit(False).alias("carried"),
                         "frames_decoded", "frames_kept"))
    return resume.combined_records(carried, processed)


@query("checksum_audit", """
    SELECT doc_id, sha256(text) AS sha256,
           CASE WHEN doc_id % 11 = 0 THEN concat('00', substr(sha256(text), 3)) ELSE sha256(text) END AS recorded,
           CASE WHEN doc_id % 11 = 0 THEN concat('00', substr(sha256(text), 3)) ELSE sha256(text) END = sha256(text) AS reusable
    FROM documents""")
def checksum_audit(spark, sf):
    files = V.table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    sha = F.sha2("content", 256)
    recorded = files.select("doc_id", F.when(
        F.col("doc_id") % 11 == 0, F.concat(F.lit("00"), F.substring(sha, 3, 64))).otherwise(sha).alias("sha256"))
    return audits.checksum_audit(files, recorded, "doc_id")


@query("checksum_audit_parts", """
    SELECT doc_id, sha256(coalesce(text, '')) AS sha256, sha256(coalesce(text, '')) AS recorded, true AS reusable FROM documents""")
def checksum_audit_parts(spark, sf):
    """Files that come in parts of 1,000 bytes, scattered over all tasks."""
    files = V.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    size = F.lit(1000)
    parts = files.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("int(octet_length(content) div 1000)"))).alias("part"), "content").select(
        "doc_id", F.col("part").cast("long").alias("part"), F.substring("content", F.col("part") * size + 1, size).alias("content"))
    recorded = files.select("doc_id", F.sha2("content", 256).alias("sha256"))
    return audits.checksum_audit(parts, recorded, "doc_id")


# --- records, totals, audits -------------------------------------------------------------

@query("run_totals", """
    SELECT l_suppkey AS run_id, CAST(sum(l_quantity :: BIGINT) AS BIGINT) AS decoded,
           CAST(sum(l_linenumber) AS BIGINT) AS kept, CAST(sum(l_linenumber) AS BIGINT) AS written, count(*) FILTER (WHERE l_returnflag = 'R') AS carried_clips,
           greatest(max(s_acctbal), 0.0) AS wall_seconds,
           round(CASE WHEN max(s_acctbal) > 0 THEN coalesce(sum(l_quantity :: BIGINT) FILTER (WHERE l_returnflag <> 'R'), 0) / max(s_acctbal) ELSE 0.0 END, 6) AS decoded_fps,
           round(CASE WHEN max(s_acctbal) > 0 THEN coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag <> 'R'), 0) / max(s_acctbal) ELSE 0.0 END, 6) AS written_fps
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey""")
def run_totals(spark, sf):
    line = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), F.col("l_quantity").cast("long").alias("frames_decoded"),
        F.col("l_linenumber").cast("long").alias("frames_kept"),
        (F.col("l_returnflag") == "R").alias("carried"))
    wall = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("run_id"),
        F.greatest("s_acctbal", F.lit(0.0)).alias("wall_seconds"))
    return _round(records.run_totals(line.join(wall, "run_id"), "run_id"), "decoded_fps", "written_fps")


@query("progress_rates", V.ctes("clips") + """,
    p AS (SELECT clip_id, frames AS clip_total_frames, clip_id % 300 AS clip_decoded,
                 (clip_id % 300) * 3 AS decoded_this_run, (clip_id % 17) / 2.0 :: DOUBLE AS elapsed_s FROM clips),
    r AS (SELECT *, decoded_this_run / greatest(elapsed_s, 1e-9) AS decode_fps FROM p)
    SELECT clip_id, round(decode_fps, 3) AS decode_fps,
           round(CASE WHEN clip_decoded > 0 AND clip_total_frames > 0
                THEN greatest(clip_total_frames - clip_decoded, 0) / greatest(decode_fps, 1e-9) END, 6) AS eta_s
    FROM r""")
def progress_rates(spark, sf):
    p = V.clips(spark, sf).select(
        "clip_id", F.col("frames").alias("clip_total_frames"), (F.col("clip_id") % 300).alias("clip_decoded"),
        ((F.col("clip_id") % 300) * 3).alias("decoded_this_run"),
        ((F.col("clip_id") % 17) / F.lit(2.0)).alias("elapsed_s"))
    r = records.progress_rates(p)
    return r.select("clip_id", F.round("decode_fps", 3).alias("decode_fps"), F.round("eta_s", 6).alias("eta_s"))


@query("source_ceiling", V.ctes("clips") + " SELECT min(width) AS width, min(height) AS height FROM clips")
def source_ceiling(spark, sf):
    return audits.source_ceiling(V.clips(spark, sf))


@query("mixed_resolutions", V.ctes("clips") + " SELECT DISTINCT width, height FROM clips ORDER BY 1, 2")
def mixed_resolutions(spark, sf):
    return audits.mixed_resolutions(V.clips(spark, sf))


@query("kept_gaps", V.ctes("kept_frames") + """
    SELECT clip_id, frame_index, gap FROM (
        SELECT clip_id, frame_index,
               greatest(frame_index - lag(frame_index) OVER (PARTITION BY clip_id ORDER BY frame_index), 0) AS gap,
               lag(frame_index) OVER (PARTITION BY clip_id ORDER BY frame_index) AS before
        FROM kept_frames) WHERE before IS NOT NULL""")
def kept_gaps(spark, sf):
    return audits.kept_gaps(V.kept_frames(spark, sf))


@query("coverage_gap", V.ctes("kept_frames") + """,
    g AS (SELECT clip_id, frame_index - lag(frame_index) OVER (PARTITION BY clip_id ORDER BY frame_index) AS gap
          FROM kept_frames),
    s AS (SELECT clip_id, list_sort(list(gap)) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY clip_id),
    c AS (SELECT DISTINCT user_id AS clip_id,
                 CASE user_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 10.0 END :: DOUBLE AS fps FROM events),
    t AS (SELECT clip_id, gaps[len(gaps) // 2 + 1] / greatest(fps, 1e-9) AS usual_s,
                 gaps[len(gaps)] / greatest(fps, 1e-9) AS worst_s FROM c LEFT JOIN s USING (clip_id))
    SELECT clip_id, usual_s, worst_s,
           CASE WHEN usual_s > 0 AND worst_s >= 4 AND worst_s / usual_s >= 4 THEN worst_s END AS gap_s
    FROM t""")
def coverage_gap(spark, sf):
    users = V.table(spark, sf, "events").select(F.col("user_id").alias("clip_id")).distinct()
    clips = users.withColumn("fps", V.event_clip_fps(F.col("clip_id")))
    return audits.coverage_gap(V.kept_frames(spark, sf), clips)


@query("frame_order_gaps", V.ctes("metric_events") + """,
    have AS (SELECT clip_id, frame_index FROM metric_events WHERE event_type <> 'error'),
    e AS (SELECT clip_id, frame_index,
                 coalesce(lag(frame_index) OVER (PARTITION BY clip_id ORDER BY frame_index), -1) + 1 AS expected FROM have)
    SELECT clip_id, min(expected) AS gap_at, CAST(sum(frame_index - expected) AS BIGINT) AS missing
    FROM e WHERE frame_index <> expected GROUP BY clip_id""")
def frame_order_gaps(spark, sf):
    # Frames that failed to arrive are the ones whose event is an error.
    return audits.frame_order_gaps(V.metric_events(spark, sf).filter("event_type <> 'error'"))


@query("mask_manifest", """
    WITH r AS (SELECT c_custkey AS run_id, c_nationkey % 2 = 0 AS heuristic, c_mktsegment = 'BUILDING' AS seg_sky,
                      c_acctbal > 5000 AS people, CAST(c_nationkey AS INTEGER) AS d FROM customer)
    SELECT run_id, concat_ws(';',
             CASE WHEN seg_sky THEN concat('sky:segmentation:sfm:{"class_id":2,"dilate":', d, '}') END,
             CASE WHEN people THEN concat('people:segmentation:sfm,training:{"class_id":12,"dilate":', d, '}') END,
             CASE WHEN heuristic AND NOT seg_sky THEN concat('sky:heuristic:sfm:{"luma_min":130,"blue_bias":-8,"gradient_max":14,"dilate":', d, '}') END) AS classes,
           CASE WHEN people THEN 'masks,masks_train' ELSE 'masks' END AS folders
    FROM r WHERE heuristic OR seg_sky OR people""")
def mask_manifest(spark, sf):
    c = V.table(spark, sf, "customer")
    d = F.col("c_nationkey").cast("int").alias("dilate")
    runs = c.select(
        F.col("c_custkey").alias("run_id"), (F.col("c_nationkey") % 2 == 0).alias("heuristic_sky"),
        (F.col("c_mktsegment") == "BUILDING").alias("seg_sky"), (F.col("c_acctbal") > 5000).alias("seg_people"),
        F.struct(F.lit(P.SKY_CLASS_ID).alias("class_id"), d).alias("sky_params"),
        F.struct(F.lit(P.PERSON_CLASS_ID).alias("class_id"), d).alias("people_params"),
        F.struct(F.lit(P.SKY_LUMA_MIN).alias("luma_min"), F.lit(P.SKY_BLUE_BIAS).alias("blue_bias"),
                 F.lit(P.SKY_GRADIENT_MAX).alias("gradient_max"), d).alias("heuristic_params"))
    m = masks.mask_manifest(runs)
    shown = F.transform("classes", lambda x: F.concat_ws(
        ":", x["name"], x["source"], F.array_join(x["written_to"], ","), x["params"]))
    return m.select("run_id", F.array_join(shown, ";").alias("classes"),
                    F.array_join(F.array_sort(F.map_values("sidecars")), ",").alias("folders"))
