"""Queries that follow the frames of a clip in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import pixels
from framesift.operators import records, selection, stems
from framesift.operators.motion import motion_gated
from framesift.plans import views as V
from framesift.plans.registry import query

FLOOR = 100.0
SHARP_FLOOR = 4250.0


def sharp8(spark, sf):
    """8x8 frames with their sharpness."""
    return V.frames8(spark, sf).withColumn(
        "sharpness", pixels.laplacian_variance("gray", "width", "height"))


def flagship(spark, sf):
    """Motion-gated selection behind a blur floor, recorded per clip."""
    decisions = motion_gated(sharp8(spark, sf), 0.07, 4, floor=SHARP_FLOOR)
    return records.clip_record(decisions).orderBy("clip_id")


@query("blur_floor", V.ctes("metric_events") + f"""
    SELECT clip_id, frame_index, NOT (sharpness < {FLOOR}) AS passes FROM metric_events""")
def blur_floor(spark, sf):
    return selection.blur_floor(V.metric_events(spark, sf), FLOOR).select("clip_id", "frame_index", "passes")


_NTH = f""",
    p AS (SELECT clip_id, frame_index, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS rn
          FROM metric_events WHERE NOT (sharpness < {FLOOR}))"""


@query("select_every_nth", V.ctes("metric_events") + _NTH + """
    SELECT m.clip_id, m.frame_index, coalesce((rn - 1) % 5 = 0, false) AS keep
    FROM metric_events m LEFT JOIN p ON p.clip_id = m.clip_id AND p.frame_index = m.frame_index""")
def select_every_nth(spark, sf):
    return selection.every_nth(V.metric_events(spark, sf), 5, FLOOR)


@query("clip_record", V.ctes("metric_events") + _NTH + """,
    d AS (SELECT m.clip_id, m.frame_index, coalesce((rn - 1) % 5 = 0, false) AS keep
          FROM metric_events m LEFT JOIN p ON p.clip_id = m.clip_id AND p.frame_index = m.frame_index)
    SELECT clip_id, count(*) AS frames_decoded, count(*) FILTER (WHERE keep) AS frames_kept,
           min(frame_index) FILTER (WHERE keep) AS first_kept, max(frame_index) FILTER (WHERE keep) AS last_kept
    FROM d GROUP BY clip_id""")
def clip_record(spark, sf):
    return records.clip_record(selection.every_nth(V.metric_events(spark, sf), 5, FLOOR))


@query("clip_kept_list", V.ctes("metric_events") + _NTH + """
    SELECT clip_id, frame_index // 65536 AS chunk, string_agg(frame_index, ',' ORDER BY frame_index) AS kept_frames
    FROM p WHERE (rn - 1) % 5 = 0 GROUP BY ALL""")
def clip_kept_list(spark, sf):
    chunks = selection.kept_chunks(selection.every_nth(V.metric_events(spark, sf), 5, FLOOR))
    return chunks.withColumn("kept_frames", F.array_join(F.col("kept_frames").cast("array<string>"), ","))


_MOTION = """,
    f AS (SELECT clip_id, frame_index, gray, sharpness,
                 row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) - 1 AS i
          FROM sharp8 {where}),
    run AS (
        SELECT clip_id, 0 :: BIGINT AS i, gray AS anchor, 0 AS n, NULL :: DOUBLE AS best_s,
               NULL :: BIGINT AS best_i, NULL :: INTEGER[] AS best_g, frame_index AS kept
        FROM f WHERE i = 0
        UNION ALL
        SELECT clip_id, i, CASE WHEN opens AND m >= 4 THEN bg ELSE anchor END,
               CASE WHEN NOT opens OR m >= 4 THEN 0 ELSE m END,
               CASE WHEN opens THEN bs END, CASE WHEN opens THEN bi END, CASE WHEN opens THEN bg END,
               CASE WHEN opens AND m >= 4 THEN bi END
        FROM (SELECT r.clip_id, f.i, r.anchor, r.n + 1 AS m,
                     r.n > 0 OR list_sum(list_transform(list_zip(f.gray, r.anchor), lambda p: abs(p[1] - p[2]))) / (64 * 255.0 :: DOUBLE) >= 0.07 AS opens,
                     CASE WHEN r.n = 0 OR f.sharpness >= r.best_s THEN f.sharpness ELSE r.best_s END AS bs,
                     CASE WHEN r.n = 0 OR f.sharpness >= r.best_s THEN f.frame_index ELSE r.best_i END AS bi,
                     CASE WHEN r.n = 0 OR f.sharpness >= r.best_s THEN f.gray ELSE r.best_g END AS bg
              FROM run r JOIN f ON f.clip_id = r.clip_id AND f.i = r.i + 1)),
    kept AS (SELECT clip_id, kept AS frame_index FROM run WHERE kept IS NOT NULL
             UNION
             SELECT clip_id, best_i FROM run WHERE n > 0
             QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY i DESC) = 1
                 AND i = (SELECT max(i) FROM f WHERE f.clip_id = run.clip_id))
    SELECT s.clip_id, s.frame_index, k.frame_index IS NOT NULL AS keep
    FROM sharp8 s LEFT JOIN kept k ON k.clip_id = s.clip_id AND k.frame_index = s.frame_index"""


@query("select_motion", V.ctes("sharp8", recursive=True) + _MOTION.format(where=""))
def select_motion(spark, sf):
    return motion_gated(sharp8(spark, sf), 0.07, 4)


@query("select_motion_floor", V.ctes("sharp8", recursive=True)
       + _MOTION.format(where="WHERE NOT (sharpness < 4250)"))
def select_motion_floor(spark, sf):
    return motion_gated(sharp8(spark, sf), 0.07, 4, floor=SHARP_FLOOR)


_RANKED = """,
    r AS (SELECT clip_id, frame_index, floor(sharpness / 50) AS sharpness {extra} FROM metric_events)"""


def _tied(spark, sf):
    return V.metric_events(spark, sf).withColumn(
        "sharpness", F.floor(F.col("sharpness") / 50).cast("double"))


@query("window_sharpest", V.ctes("metric_events") + _RANKED.format(extra=", frame_index // 8 AS window_id") + """
    SELECT clip_id, window_id, frame_index, sharpness FROM r
    QUALIFY row_number() OVER (PARTITION BY clip_id, window_id ORDER BY sharpness DESC, frame_index DESC) = 1""")
def window_sharpest(spark, sf):
    windows = _tied(spark, sf).withColumn("window_id", F.expr("frame_index div 8"))
    return selection.window_sharpest(windows, "clip_id", "window_id")


@query("sharpest_per_clip", V.ctes("metric_events") + _RANKED.format(extra="") + """
    SELECT clip_id, frame_index, sharpness FROM r
    QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY sharpness DESC, frame_index DESC) = 1""")
def sharpest_per_clip(spark, sf):
    return selection.window_sharpest(_tied(spark, sf), "clip_id")


@query("unique_stems", """
    WITH c AS (SELECT o_orderkey AS position, concat('GX', o_custkey) AS stem FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY position) - 1 AS k FROM c)
    SELECT position, stem, CASE WHEN k = 0 THEN stem ELSE concat(stem, '_', k) END AS name FROM r""")
def unique_stems(spark, sf):
    c = V.clips(spark, sf).select(F.col("clip_id").alias("position"), "stem")
    return stems.unique_stems(c)


@query("unique_stems_colliding", """
    WITH RECURSIVE c AS (
        SELECT o_orderkey AS position, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i,
               concat('GX', o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN '_1' WHEN '2-HIGH' THEN '_2'
                                            WHEN '5-LOW' THEN '_1_1' ELSE '' END) AS stem FROM orders),
    w AS (SELECT o_custkey, 0 :: BIGINT AS i, NULL :: BIGINT AS position, NULL :: VARCHAR AS stem,
                 NULL :: VARCHAR AS name, [] :: VARCHAR[] AS taken FROM c WHERE i = 1
          UNION ALL
          SELECT o_custkey, i, position, stem, name, list_append(taken, name)
          FROM (SELECT c.o_custkey, c.i, c.position, c.stem, w.taken,
                       CASE WHEN NOT list_contains(w.taken, c.stem) THEN c.stem
                            ELSE list_filter(list_transform(range(1, 1000), lambda n: concat(c.stem, '_', n)),
                                             lambda m: NOT list_contains(w.taken, m))[1] END AS name
                FROM w JOIN c ON c.o_custkey = w.o_custkey AND c.i = w.i + 1))
    SELECT position, stem, name FROM w WHERE i > 0""")
def unique_stems_colliding(spark, sf):
    """Orders whose stems collide with numbered ones: GX7, GX7_1, GX7_2, GX7_1_1, ..."""
    o = V.table(spark, sf, "orders")
    tail = (F.when(F.col("o_orderpriority") == "1-URGENT", "_1")
            .when(F.col("o_orderpriority") == "2-HIGH", "_2")
            .when(F.col("o_orderpriority") == "5-LOW", "_1_1").otherwise(""))
    c = o.select(F.col("o_orderkey").alias("position"),
                 F.concat(F.lit("GX"), F.col("o_custkey"), tail).alias("stem"))
    return stems.unique_stems(c)


@query("zero_kept_guard", V.ctes("metric_events") + f"""
    SELECT count(*) FILTER (WHERE NOT (sharpness < {FLOOR})) AS kept,
           count(*) FILTER (WHERE NOT (sharpness < {FLOOR})) > 0 AS usable FROM metric_events""")
def zero_kept_guard(spark, sf):
    decided = selection.every_nth(V.metric_events(spark, sf), 1, FLOOR)
    return decided.agg(F.count_if("keep").alias("kept")).withColumn("usable", F.col("kept") > 0)
