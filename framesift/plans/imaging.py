"""Queries over pixel columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift import params as P
from framesift.functions import pixels
from framesift.operators import masks, metrics, quality
from framesift.plans import views as V
from framesift.plans.registry import query


def _hex(df, *names):
    for n in names:
        df = df.withColumn(n, F.hex(n))
    return df


@query("scan_frames", V.ctes("frames8") + f"""
    SELECT clip_id, frame_index, width, height, {V.sql_hex('gray')} AS gray FROM frames8""")
def scan_frames(spark, sf):
    return _hex(V.frames8(spark, sf), "gray")


@query("rgb_to_gray", V.ctes("rgb8") + f"""
    SELECT clip_id, frame_index,
           {V.sql_hex('list_transform(range(64), lambda i: (77 * r[i + 1] + 150 * g[i + 1] + 29 * b[i + 1]) // 256)')} AS gray
    FROM rgb8""")
def rgb_to_gray(spark, sf):
    return V.rgb8(spark, sf).select("clip_id", "frame_index", F.hex(pixels.rgb_to_gray("rgb")).alias("gray"))


@query("laplacian_variance", V.ctes("sharp8") + """
    SELECT clip_id, frame_index, round(sharpness, 6) AS sharpness FROM sharp8""")
def laplacian_variance(spark, sf):
    return V.frames8(spark, sf).select(
        "clip_id", "frame_index",
        F.round(pixels.laplacian_variance("gray", "width", "height"), 6).alias("sharpness"))


_MASKED_LAP = """,
    m AS (SELECT clip_id, frame_index, gray, list_transform(gray, lambda v: CASE WHEN v % 5 = 2 THEN 0 ELSE 255 END) AS valid FROM frames8),
    l AS (SELECT clip_id, frame_index,
                 CASE WHEN valid[y * 8 + x + 1] <> 0 AND valid[y * 8 + x] <> 0 AND valid[y * 8 + x + 2] <> 0
                       AND valid[y * 8 + x - 7] <> 0 AND valid[y * 8 + x + 9] <> 0
                      THEN CAST(gray[y * 8 + x] + gray[y * 8 + x + 2] + gray[y * 8 + x - 7]
                          + gray[y * 8 + x + 9] - 4 * gray[y * 8 + x + 1] AS DOUBLE) END AS lap
          FROM m, range(1, 7) AS tx(x), range(1, 7) AS ty(y))"""


@query("laplacian_variance_masked", V.ctes("frames8") + _MASKED_LAP + """
    SELECT clip_id, frame_index, round(CASE WHEN count(lap) = 0 THEN 0.0
           ELSE sum(lap * lap) / count(lap) - (sum(lap) / count(lap)) * (sum(lap) / count(lap)) END, 6) AS sharpness
    FROM l GROUP BY clip_id, frame_index""")
def laplacian_variance_masked(spark, sf):
    f = V.frames8(spark, sf).join(
        V.labels8(spark, sf).select("clip_id", "frame_index",
                                    pixels.label_to_mask("labels", P.SKY_CLASS_ID).alias("valid")),
        ["clip_id", "frame_index"])
    return f.select("clip_id", "frame_index", F.round(
        pixels.laplacian_variance("gray", "width", "height", "valid"), 6).alias("sharpness"))


_DIFF = """list_sum(list_transform(list_zip(a.gray, b.gray), lambda p: abs(p[1] - p[2])))"""


@query("mean_abs_diff", V.ctes("frames8") + f"""
    SELECT a.clip_id, a.frame_index, round({_DIFF} / (64 * 255.0 :: DOUBLE), 9) AS motion
    FROM frames8 a JOIN frames8 b ON b.clip_id = a.clip_id AND b.frame_index = a.frame_index - 1""")
def mean_abs_diff(spark, sf):
    return metrics.consecutive_motion(V.frames8(spark, sf)).withColumn("motion", F.round("motion", 9))


@query("frame_pair_psnr", V.ctes("frames8") + """
    SELECT a.clip_id, a.frame_index, round(10 * log10(255.0 :: DOUBLE * 255.0 / (
           list_sum(list_transform(list_zip(a.gray, b.gray), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 64.0 :: DOUBLE)), 6) AS psnr_db
    FROM frames8 a JOIN frames8 b ON b.clip_id = a.clip_id AND b.frame_index = a.frame_index - 1""")
def frame_pair_psnr(spark, sf):
    return metrics.frame_pair_psnr(V.frames8(spark, sf)).withColumn("psnr_db", F.round("psnr_db", 6))


@query("mask_scale", V.ctes("labels8") + f"""
    SELECT clip_id, frame_index,
           {V.sql_hex('list_transform(range(65), lambda i: labels[least((i // 13) * 8 // 5, 7) * 8 + least((i % 13) * 8 // 13, 7) + 1])')} AS labels
    FROM labels8""")
def mask_scale(spark, sf):
    return V.labels8(spark, sf).select("clip_id", "frame_index", F.hex(pixels.nn_scale(
        "labels", "width", "height", F.lit(13), F.lit(5))).alias("labels"))


def _sql_weights(name: str, src: int, dst: int, kernel: str) -> str:
    """A CTE (d, s, k) of the resampling weights from `src` to `dst` pixels."""
    scale = f"({src} / {dst} :: DOUBLE)"
    width = f"greatest({scale}, 1.0 :: DOUBLE)"
    shape = {
        "bilinear": (1, "greatest(0.0 :: DOUBLE, 1.0 - abs(x))"),
        "lanczos3": (3, "CASE WHEN x = 0 THEN 1.0 :: DOUBLE ELSE sin(pi() * x) / (pi() * x) "
                        "* (sin(pi() * (x / 3.0)) / (pi() * (x / 3.0))) END"),
    }
    support, value = shape[kernel]
    return f"""{name} AS (
        SELECT d, s, CAST(q + CASE WHEN row_number() OVER (PARTITION BY d ORDER BY q DESC, s) = 1
                     THEN 16384 - sum(q) OVER (PARTITION BY d) ELSE 0 END AS BIGINT) AS k
        FROM (SELECT d, s, CAST(round(v / sum(v) OVER (PARTITION BY d) * 16384) AS BIGINT) AS q
              FROM (SELECT d, s, {value} AS v
                    FROM (SELECT d, s, ((s + 0.5 :: DOUBLE) - (d + 0.5 :: DOUBLE) * {scale}) / {width} AS x
                          FROM range({dst}) AS td(d), range({src}) AS ts(s))
                    WHERE abs(x) < {support})))"""


def _sql_resize(name: str, source: str, size: tuple, to: tuple, kernel: str) -> str:
    """CTEs that take pixels (clip_id, frame_index, x, y, ch, v) to another size."""
    keys = "clip_id, frame_index"
    rounded = "greatest(0, least(255, (sum(v * k) + 8192) >> 14)) AS v"
    return f"""{_sql_weights(name + '_wx', size[0], to[0], kernel)},
        {_sql_weights(name + '_wy', size[1], to[1], kernel)},
        {name}_h AS (SELECT {keys}, w.d AS x, y, ch, {rounded} FROM {source} p JOIN {name}_wx w ON w.s = p.x
                     GROUP BY {keys}, w.d, y, ch),
        {name} AS (SELECT {keys}, x, w.d AS y, ch, {rounded} FROM {name}_h p JOIN {name}_wy w ON w.s = p.y
                   GROUP BY {keys}, x, w.d, ch)"""


_PX = """,
    px AS (SELECT clip_id, frame_index, i % 8 AS x, i // 8 AS y, ch,
                  CAST(CASE ch WHEN 1 THEN r[i + 1] WHEN 2 THEN g[i + 1] ELSE b[i + 1] END AS BIGINT) AS v
           FROM rgb8, range(64) AS t(i), range(1, 4) AS u(ch)), """


def _sql_joined(source: str, name: str, where: str = "") -> str:
    return f"""SELECT clip_id, frame_index, string_agg(printf('%02X', CAST(v AS INTEGER)), '' ORDER BY y, x, ch) AS {name}
               FROM {source} {where} GROUP BY clip_id, frame_index"""


@query("metric_thumbnail", V.ctes("rgb8") + _PX + _sql_resize("t", "px", (8, 8), (4, 4), "bilinear")
       + _sql_joined("t", "thumb"))
def metric_thumbnail(spark, sf):
    return V.rgb8(spark, sf).select("clip_id", "frame_index", F.hex(
        pixels.metric_thumbnail("rgb", "width", "height", 4)).alias("thumb"))


@query("resize_frames", V.ctes("rgb8") + _PX + _sql_resize("a", "px", (8, 8), (24, 16), "lanczos3") + ", "
       + _sql_resize("b", "a", (24, 16), (4, 6), "lanczos3")
       + f"SELECT * FROM ({_sql_joined('a', 'enlarged')}) JOIN ({_sql_joined('b', 'reduced')}) USING (clip_id, frame_index)")
def resize_frames(spark, sf):
    small = V.rgb8(spark, sf).withColumn("out", pixels.resize_rgb(
        "rgb", "width", "height", F.lit(24), F.lit(16)))
    back = pixels.resize_rgb("out", F.lit(24), F.lit(16), F.lit(4), F.lit(6))
    return small.select("clip_id", "frame_index", F.hex("out").alias("enlarged"), F.hex(back).alias("reduced"))


@query("cover_crop_frames", V.ctes("rgb8") + _PX + _sql_resize("a", "px", (8, 8), (6, 6), "lanczos3")
       + _sql_joined("a", "cropped", "WHERE y BETWEEN 1 AND 4"))
def cover_crop_frames(spark, sf):
    from framesift.functions.geometry import cover_crop
    box = cover_crop(F.col("width"), F.col("height"), F.lit(6), F.lit(4))
    f = V.rgb8(spark, sf)
    for name, c in box.items():
        f = f.withColumn(name, c)
    scaled = f.withColumn("scaled", pixels.resize_rgb("rgb", "width", "height", "scaled_w", "scaled_h"))
    return scaled.select("clip_id", "frame_index", F.hex(pixels.crop_rgb(
        "scaled", "scaled_w", "scaled_h", "crop_x", "crop_y", F.lit(6), F.lit(4))).alias("cropped"))


@query("label_argmax", f"""
    WITH l AS (SELECT vec_id, list_transform(range(16), lambda p: [embedding[p + 1], embedding[p + 17], embedding[p + 33], embedding[p + 49]]) AS px
               FROM embeddings)
    SELECT vec_id, {V.sql_hex('list_transform(px, lambda v: list_position(v, list_max(v)) - 1)')} AS labels FROM l""")
def label_argmax(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select("vec_id", F.hex(pixels.label_argmax("embedding", 4)).alias("labels"))


@query("label_to_mask", V.ctes("masks8") + f"""
    SELECT clip_id, frame_index, class, {V.sql_hex('mask')} AS mask FROM masks8""")
def label_to_mask(spark, sf):
    return _hex(_class_masks(spark, sf), "mask")


def _layers():
    return {"sky": pixels.label_to_mask("labels", 2), "people": pixels.label_to_mask("labels", 3)}


def _class_masks(spark, sf):
    pair = F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), m.alias("mask")) for c, m in _layers().items()]))
    return V.labels8(spark, sf).select("clip_id", "frame_index", pair.alias("p")).select(
        "clip_id", "frame_index", "p.class", "p.mask")


@query("mask_routing", V.ctes("masks8") + """
    SELECT clip_id, frame_index, class, sidecar, len(list_filter(mask, lambda v: v <> 0)) AS valid_px
    FROM masks8 JOIN (VALUES ('sky', 'sfm'), ('people', 'sfm'), ('people', 'training')) AS r(class, sidecar) USING (class)""")
def mask_routing(spark, sf):
    return masks.mask_routing(_class_masks(spark, sf)).select(
        "clip_id", "frame_index", "class", "sidecar",
        F.round(pixels.valid_fraction("mask") * 64).cast("long").alias("valid_px"))


@query("mask_intersect", V.ctes("masks8") + """,
    r AS (SELECT clip_id, frame_index, sidecar, mask FROM masks8
          JOIN (VALUES ('sky', 'sfm'), ('people', 'sfm'), ('people', 'training')) AS t(class, sidecar) USING (class)),
    x AS (SELECT clip_id, frame_index, sidecar, i, min(mask[i + 1]) AS v FROM r, range(64) AS t(i) GROUP BY ALL)
    SELECT clip_id, frame_index, sidecar, string_agg(printf('%02X', v), '' ORDER BY i) AS mask
    FROM x GROUP BY clip_id, frame_index, sidecar""")
def mask_intersect(spark, sf):
    return _hex(masks.mask_intersect(V.labels8(spark, sf), _layers()), "mask")


@query("mask_dilate", V.ctes("masks8") + """,
    p AS (SELECT clip_id, frame_index, i % 8 AS x, i // 8 AS y, mask[i + 1] AS v
          FROM masks8, range(64) AS t(i) WHERE class = 'sky'),
    h AS (SELECT clip_id, frame_index, x, y, min(v) OVER (PARTITION BY clip_id, frame_index, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM p),
    d AS (SELECT clip_id, frame_index, x, y, min(v) OVER (PARTITION BY clip_id, frame_index, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM h)
    SELECT clip_id, frame_index, string_agg(printf('%02X', v), '' ORDER BY y, x) AS mask FROM d GROUP BY ALL""")
def mask_dilate(spark, sf):
    sky = pixels.label_to_mask("labels", 2)
    return V.labels8(spark, sf).select("clip_id", "frame_index", F.hex(
        pixels.mask_dilate(sky, "width", "height", 1)).alias("mask"))


@query("valid_fraction", V.ctes("masks8") + """
    SELECT clip_id, frame_index, class, len(list_filter(mask, lambda v: v <> 0)) / 64.0 :: DOUBLE AS valid
    FROM masks8""")
def valid_fraction(spark, sf):
    return _class_masks(spark, sf).select(
        "clip_id", "frame_index", "class", pixels.valid_fraction("mask").alias("valid"))


@query("masked_fraction", V.ctes("masks8") + """
    SELECT clip_id, frame_index,
           CASE WHEN clip_id % 2 = 0 THEN 1.0 - len(list_filter(mask, lambda v: v <> 0)) / 64.0 :: DOUBLE ELSE 0.0 END AS masked
    FROM masks8 WHERE class = 'sky'""")
def masked_fraction(spark, sf):
    # Masking is on for every other clip.
    mask = F.when(F.col("clip_id") % 2 == 0, pixels.label_to_mask("labels", 2))
    return V.labels8(spark, sf).withColumn("mask", mask).select(
        "clip_id", "frame_index", pixels.masked_fraction("mask").alias("masked"))


_SKY = """,
    gpx AS (SELECT clip_id, frame_index, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
                   (77 * r[i + 1] + 150 * g[i + 1] + 29 * b[i + 1]) // 256 AS l, b[i + 1] - r[i + 1] AS bias
            FROM rgb8, range(64) AS t(i)),
    cand AS (SELECT * FROM gpx WHERE l >= 120 AND bias >= -30),
    sky AS (SELECT clip_id, frame_index, x, y, l FROM cand WHERE y = 0
            UNION
            SELECT c.clip_id, c.frame_index, c.x, c.y, c.l
            FROM sky s JOIN cand c ON c.clip_id = s.clip_id AND c.frame_index = s.frame_index
             AND abs(c.x - s.x) + abs(c.y - s.y) = 1 AND abs(c.l - s.l) <= 30),
    m AS (SELECT g.clip_id, g.frame_index, g.x, g.y, CASE WHEN s.x IS NULL THEN 255 ELSE 0 END AS v
          FROM gpx g LEFT JOIN sky s ON s.clip_id = g.clip_id AND s.frame_index = g.frame_index AND s.x = g.x AND s.y = g.y),
    dh AS (SELECT clip_id, frame_index, x, y, min(v) OVER (PARTITION BY clip_id, frame_index, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM m),
    dv AS (SELECT clip_id, frame_index, x, y, min(v) OVER (PARTITION BY clip_id, frame_index, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM dh)"""


@query("sky_mask", V.ctes("rgb8", recursive=True) + _SKY + """
    SELECT clip_id, frame_index, string_agg(printf('%02X', v), '' ORDER BY y, x) AS mask FROM dv GROUP BY ALL""")
def sky_mask(spark, sf):
    f = V.rgb8(spark, sf).withColumn("gray", pixels.rgb_to_gray("rgb"))
    return f.select("clip_id", "frame_index", F.hex(pixels.sky_mask(
        "rgb", "gray", "width", "height", 120, -30, 30, 1)).alias("mask"))


@query("judge_frames", V.ctes("rgb8", recursive=True) + _SKY + """,
    lap AS (SELECT a.clip_id, a.frame_index,
                   CAST(w.l + e.l + n.l + s.l - 4 * a.l AS DOUBLE) AS lap,
                   av.v <> 0 AND wv.v <> 0 AND ev.v <> 0 AND nv.v <> 0 AND sv.v <> 0 AS ok
            FROM gpx a
            JOIN gpx w ON w.clip_id = a.clip_id AND w.frame_index = a.frame_index AND w.x = a.x - 1 AND w.y = a.y
            JOIN gpx e ON e.clip_id = a.clip_id AND e.frame_index = a.frame_index AND e.x = a.x + 1 AND e.y = a.y
            JOIN gpx n ON n.clip_id = a.clip_id AND n.frame_index = a.frame_index AND n.x = a.x AND n.y = a.y - 1
            JOIN gpx s ON s.clip_id = a.clip_id AND s.frame_index = a.frame_index AND s.x = a.x AND s.y = a.y + 1
            JOIN dv av ON av.clip_id = a.clip_id AND av.frame_index = a.frame_index AND av.x = a.x AND av.y = a.y
            JOIN dv wv ON wv.clip_id = w.clip_id AND wv.frame_index = w.frame_index AND wv.x = w.x AND wv.y = w.y
            JOIN dv ev ON ev.clip_id = e.clip_id AND ev.frame_index = e.frame_index AND ev.x = e.x AND ev.y = e.y
            JOIN dv nv ON nv.clip_id = n.clip_id AND nv.frame_index = n.frame_index AND nv.x = n.x AND nv.y = n.y
            JOIN dv sv ON sv.clip_id = s.clip_id AND sv.frame_index = s.frame_index AND sv.x = s.x AND sv.y = s.y)
    SELECT clip_id, frame_index, round(CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 0.0 ELSE
             sum(lap * lap) FILTER (WHERE ok) / count(*) FILTER (WHERE ok)
             - (sum(lap) FILTER (WHERE ok) / count(*) FILTER (WHERE ok)) * (sum(lap) FILTER (WHERE ok) / count(*) FILTER (WHERE ok)) END, 6) AS sharpness
    FROM lap GROUP BY clip_id, frame_index""")
def judge_frames(spark, sf):
    sky = dict(luma_min=120, blue_bias=-30, gradient_max=30, dilate=1)
    return metrics.judge_frames(V.rgb8(spark, sf), heuristic_sky=sky).select(
        "clip_id", "frame_index", F.round("sharpness", 6).alias("sharpness"))


@query("judge_people", V.ctes("rgb8", "masks8") + """,
    p AS (SELECT clip_id, frame_index, class, i % 8 AS x, i // 8 AS y, mask[i + 1] AS v FROM masks8, range(64) AS t(i)),
    h AS (SELECT clip_id, frame_index, class, x, y, min(v) OVER (PARTITION BY clip_id, frame_index, class, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v
          FROM p WHERE class = 'people'),
    d AS (SELECT clip_id, frame_index, x, y, min(v) OVER (PARTITION BY clip_id, frame_index, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM h),
    t AS (SELECT clip_id, frame_index, string_agg(printf('%02X', v), '' ORDER BY y, x) AS training FROM d GROUP BY ALL),
    s AS (SELECT clip_id, frame_index, string_agg(printf('%02X', least(d.v, p.v)), '' ORDER BY y, x) AS sfm
          FROM d JOIN p USING (clip_id, frame_index, x, y) WHERE p.class = 'sky' GROUP BY ALL)
    SELECT clip_id, frame_index, sfm, training FROM s JOIN t USING (clip_id, frame_index)""")
def judge_people(spark, sf):
    """Sky and people from label maps: both limit the metrics, only people the trainer."""
    rgb, labels = V.rgb8(spark, sf), V.labels8(spark, sf).select("clip_id", "frame_index", "labels")
    f = rgb.join(labels, ["clip_id", "frame_index"])
    out = f.select("clip_id", "frame_index", pixels.judge(
        "rgb", "width", "height", "labels", "width", "height", sky_id=2, people_id=3,
        sky_dilate=0, people_dilate=1).alias("j"))
    return _hex(out.select("clip_id", "frame_index", "j.sfm", "j.training"), "sfm", "training")


@query("label_smoothing", V.ctes("labels8") + """,
    p AS (SELECT clip_id, frame_index, i, labels[i + 1] AS label FROM labels8, range(64) AS t(i)),
    t AS (SELECT a.clip_id, a.frame_index, a.i, b.label, count(*) AS n, min(b.frame_index) AS first_seen
          FROM p a JOIN p b ON b.clip_id = a.clip_id AND b.i = a.i
                           AND b.frame_index BETWEEN a.frame_index - 4 AND a.frame_index
          GROUP BY a.clip_id, a.frame_index, a.i, b.label),
    s AS (SELECT clip_id, frame_index, i, label FROM t
          QUALIFY row_number() OVER (PARTITION BY clip_id, frame_index, i ORDER BY n DESC, first_seen) = 1)
    SELECT clip_id, frame_index, string_agg(printf('%02X', label), '' ORDER BY i) AS labels
    FROM s GROUP BY clip_id, frame_index""")
def label_smoothing(spark, sf):
    return _hex(masks.label_smoothing(V.labels8(spark, sf), 4), "labels")


_DISP = """
    WITH d AS (SELECT vec_id AS pair_id, p, (p % 4 + 0.5) * 480 AS cx, (p // 4 + 0.5) * 270 AS cy,
                      CAST(embedding[p * 4 + 1] AS DOUBLE) * 12 AS dx, CAST(embedding[p * 4 + 2] AS DOUBLE) * 12 AS dy,
                      abs(CAST(embedding[p * 4 + 3] AS DOUBLE)) * 100 AS std
               FROM embeddings, range(16) AS t(p)),
    s AS (SELECT *, CASE WHEN std < 3 THEN 'low texture' WHEN abs(dx) > 5 OR abs(dy) > 5 THEN 'spurious' ELSE 'ok' END AS status,
                 (cx - 960) AS rx, (cy - 540) AS ry FROM d),
    a AS (SELECT pair_id, list_sort(list(sqrt(dx * dx + dy * dy)) FILTER (WHERE status = 'ok')) AS m,
                 count(*) FILTER (WHERE status = 'ok') AS patches, count(*) FILTER (WHERE status = 'spurious') AS spurious,
                 count(*) FILTER (WHERE status = 'low texture') AS low_texture,
                 sum(sqrt(dx * dx + dy * dy)) FILTER (WHERE status = 'ok') AS total,
                 sum(rx * dx + ry * dy) FILTER (WHERE status = 'ok') / sum(rx * rx + ry * ry) FILTER (WHERE status = 'ok') AS scale
          FROM s GROUP BY pair_id)"""


@query("registration_summary", _DISP + """
    SELECT pair_id, patches, spurious, low_texture,
           CASE WHEN patches = 0 THEN 'Infinity' :: DOUBLE ELSE round(m[patches // 2 + 1], 6) END AS median,
           CASE WHEN patches = 0 THEN 'Infinity' :: DOUBLE ELSE round(total / patches, 6) END AS mean,
           CASE WHEN patches = 0 THEN 'Infinity' :: DOUBLE ELSE round(m[patches * 9 // 10 + 1], 6) END AS p90,
           CASE WHEN patches = 0 THEN 'Infinity' :: DOUBLE ELSE round(list_max(m), 6) END AS max,
           CASE WHEN patches = 0 THEN 'Infinity' :: DOUBLE ELSE round(abs(scale) * sqrt(960.0 * 960.0 + 540.0 * 540.0), 6) END AS corner_px
    FROM a""")
def registration_summary(spark, sf):
    e = V.table(spark, sf, "embeddings")
    at = F.explode(F.sequence(F.lit(0), F.lit(15)))
    d = e.select(F.col("vec_id").alias("pair_id"), "embedding", at.alias("p"))

    def value(k):
        return F.get("embedding", F.col("p") * 4 + k).cast("double")
    d = d.select(
        "pair_id", F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.col("p").alias("patch"),
        ((F.col("p") % 4 + 0.5) * 480).alias("cx"), ((F.floor(F.col("p") / 4) + 0.5) * 270).alias("cy"),
        (value(0) * 12).alias("dx"), (value(1) * 12).alias("dy"), (F.abs(value(2)) * 100).alias("std"))
    d = d.withColumn("status", quality.patch_status(F.col("std"), F.col("dx"), F.col("dy")))
    out = quality.registration_summary(d).drop("scale")
    for n in ("median", "mean", "p90", "max", "corner_px"):
        out = out.withColumn(n, F.round(n, 6))
    return out
