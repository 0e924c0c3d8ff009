"""Frame-shaped views of the given tables, in Spark and as SQL fragments.

Every view covers its whole table.  `SQL` holds the same definitions for the
oracle; `ctes("a", "b")` pulls in what a, b need.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from framesift.functions import pixels
from framesift.operators.ordering import dense_index, index_bucket
from framesift.session import materialise

SIDE = 8
PIXELS = SIDE * SIDE


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(selector: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(selector == i, F.lit(values[i])).otherwise(out)
    return out


WIDTHS = [3840, 1920, 2704]
HEIGHTS = [2880, 1080, 1520]


def embedding_frames(spark, sf) -> DataFrame:
    """Numbered embeddings: (clip_id, frame_index, embedding); clip = label."""
    emb = table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("clip_id"), "vec_id", "embedding")
    # Numbered once and stored, as frames of a dataset are; queries read it as often as they need.
    return materialise(dense_index(emb, ["clip_id"], ["vec_id"], index_bucket("vec_id", 4096), "frame_index"),
                       "embedding-frames")


def _size(df: DataFrame) -> DataFrame:
    return df.withColumn("width", F.lit(SIDE)).withColumn("height", F.lit(SIDE))


def frames8(spark, sf) -> DataFrame:
    """8x8 gray frames."""
    return _size(embedding_frames(spark, sf)).select(
        "clip_id", "frame_index", "width", "height", pixels.quantise("embedding").alias("gray"))


def rgb8(spark, sf) -> DataFrame:
    """8x8 RGB frames."""
    return _size(embedding_frames(spark, sf)).select(
        "clip_id", "frame_index", "width", "height",
        pixels.quantise("embedding", "rgb").alias("rgb"))


def labels8(spark, sf) -> DataFrame:
    """8x8 label maps with five labels."""
    @F.arrow_udf(T.BinaryType())
    def fold(column):
        from framesift.functions.arrays import binary_from_rows, byte_rows
        return binary_from_rows([v % 5 for v in byte_rows(column)])
    return frames8(spark, sf).withColumn("labels", fold("gray")).drop("gray")


def metric_events(spark, sf) -> DataFrame:
    """Frame metrics without pixels: (clip_id, frame_index, sharpness, event_type)."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("clip_id"), "ts", "event_id",
        F.col("value").alias("sharpness"), "event_type")
    # Hours as text sort like time and do not depend on the session time zone.
    hour = F.date_format("ts", "yyyy-MM-dd HH")
    return materialise(dense_index(ev, ["clip_id"], ["ts", "event_id"], hour, "frame_index").select(
        "clip_id", "frame_index", "sharpness", "event_type"), "metric-events")


def event_clip_fps(clip: Column) -> Column:
    return _pick(F.pmod(clip, F.lit(4)), [0.5, 1.0, 2.0, 10.0])


def clips(spark, sf) -> DataFrame:
    """One clip per order, with NULL frame counts and durations among them."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    fps = _pick(key % 2, [59.94, 29.97])
    frames = F.lit(100) + (key * 37) % 5000
    return o.select(
        key.alias("clip_id"),
        F.concat(F.lit("in/d"), key % 97, F.lit("/GX"), F.col("o_custkey"), F.lit(".mp4")).alias("path"),
        F.concat(F.lit("GX"), F.col("o_custkey")).alias("stem"),
        _pick(key % 3, WIDTHS).alias("width"),
        _pick(key % 3, HEIGHTS).alias("height"),
        fps.alias("fps"),
        F.when(key % 7 != 3, frames).alias("frames"),
        F.when(key % 5 != 4, frames / fps).alias("duration_s"),
        F.col("o_custkey").alias("profile_id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def profile_rows(spark, sf) -> DataFrame:
    """One lens profile per part, some of them unusable."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    usable = key % 11 != 0
    return p.select(
        key.alias("profile_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("camera_brand"),
        F.col("p_type").alias("camera_model"),
        F.when(usable, _pick(F.col("p_size") % 3, WIDTHS)).otherwise(0).alias("calib_w"),
        F.when(usable, _pick(F.col("p_size") % 3, HEIGHTS)).otherwise(0).alias("calib_h"),
        F.when(key % 5 == 0, 0.0).otherwise(_pick(key % 2, [59.94, 29.97])).alias("fps"),
        F.col("p_retailprice").alias("k00"),
        (F.col("p_retailprice") + 3.0).alias("k11"),
        _pick(key % 4, [1.0, 0.0, 1.33, 1.0]).alias("stretch_x"),
        _pick(key % 4, [1.0, 1.0, 0.0, 1.25]).alias("stretch_y"),
        F.when(key % 7 != 0, F.array(F.lit(0.18), F.lit(-0.04), F.lit(0.19), F.lit(-0.14)))
        .otherwise(F.array().cast("array<double>")).alias("coeffs"),
    )


def profile_json(spark, sf) -> DataFrame:
    """The same profiles as JSON documents, the way lens files carry them."""
    doc = F.to_json(F.struct(
        "name", "camera_brand", "camera_model", "fps",
        F.struct(F.col("calib_w").alias("w"), F.col("calib_h").alias("h")).alias("calib_dimension"),
        F.col("stretch_x").alias("input_horizontal_stretch"),
        F.col("stretch_y").alias("input_vertical_stretch"),
        F.struct(
            F.array(F.array("k00", F.lit(0.0), F.col("calib_w") / 2),
                    F.array(F.lit(0.0), F.col("k11"), F.col("calib_h") / 2),
                    F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("camera_matrix"),
            F.col("coeffs").alias("distortion_coeffs")).alias("fisheye_params"),
    ))
    return profile_rows(spark, sf).select("profile_id", doc.alias("document"))


def profile_paths(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")),
                 F.lit("_"), "p_type", F.lit(".json")).alias("path")).distinct()


EXTENSIONS = ["mp4", "MOV", "json", "onnx", "txt", "webm"]


def listing(spark, sf) -> DataFrame:
    """A folder listing with files of all kinds, one per page."""
    key = F.col("page_id")
    return table(spark, sf, "pages").select(
        F.concat(F.lit("in/d"), key % 5, F.lit("/f"), key, F.lit("."),
                 _pick(key % 6, EXTENSIONS)).alias("path"))


def kept_frames(spark, sf) -> DataFrame:
    """What an earlier run recorded as kept: (clip_id, stem, frame_index)."""
    return metric_events(spark, sf).filter("event_type = 'click'").select(
        "clip_id", F.concat(F.lit("user"), "clip_id").alias("stem"), "frame_index")


# --- the same views for the oracle -------------------------------------------------

def _case(selector: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {selector} {arms} ELSE {values[-1]} END"


_GRAY = ("list_transform(embedding, lambda e: CAST(least(255, greatest(0, "
         "floor((CAST(e AS DOUBLE) + 1.0) * 127.5))) AS INTEGER))")

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "frames8": ((), f"""
        SELECT CAST(label AS BIGINT) AS clip_id,
               row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index,
               8 AS width, 8 AS height, {_GRAY} AS gray
        FROM embeddings"""),
    "rgb8": (("frames8",), """
        SELECT clip_id, frame_index, gray AS r,
               list_transform(range(64), lambda i: gray[(i + 1) % 64 + 1]) AS g,
               list_transform(range(64), lambda i: gray[(i + 7) % 64 + 1]) AS b
        FROM frames8"""),
    "labels8": (("frames8",), """
        SELECT clip_id, frame_index, list_transform(gray, lambda v: v % 5) AS labels FROM frames8"""),
    "masks8": (("labels8",), """
        SELECT clip_id, frame_index, class,
               list_transform(labels, lambda l: CASE WHEN l = id THEN 0 ELSE 255 END) AS mask
        FROM labels8, (VALUES ('sky', 2), ('people', 3)) AS c(class, id)"""),
    "pixels8": (("frames8",), """
        SELECT clip_id, frame_index, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
               gray[i + 1] AS v
        FROM frames8, range(64) AS t(i)"""),
    "lum8": (("rgb8",), """
        SELECT clip_id, frame_index, list_transform(range(64), lambda i:
               (77 * r[i + 1] + 150 * g[i + 1] + 29 * b[i + 1]) // 256) AS gray FROM rgb8"""),
    "sharp8": (("frames8",), """
        SELECT clip_id, frame_index, any_value(gray) AS gray,
               sum(lap * lap) / count(*) - (sum(lap) / count(*)) * (sum(lap) / count(*)) AS sharpness
        FROM (SELECT clip_id, frame_index, gray,
                     CAST(gray[y * 8 + x] + gray[y * 8 + x + 2] + gray[y * 8 + x - 7]
                          + gray[y * 8 + x + 9] - 4 * gray[y * 8 + x + 1] AS DOUBLE) AS lap
              FROM frames8, range(1, 7) AS tx(x), range(1, 7) AS ty(y))
        GROUP BY clip_id, frame_index"""),
    "metric_events": ((), """
        SELECT user_id AS clip_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
               value AS sharpness, event_type
        FROM events"""),
    "kept_frames": (("metric_events",), """
        SELECT clip_id, concat('user', clip_id) AS stem, frame_index
        FROM metric_events WHERE event_type = 'click'"""),
    "clips": ((), f"""
        SELECT o_orderkey AS clip_id,
               concat('in/d', o_orderkey % 97, '/GX', o_custkey, '.mp4') AS path,
               concat('GX', o_custkey) AS stem,
               CAST({_case('o_orderkey % 3', WIDTHS)} AS INTEGER) AS width,
               CAST({_case('o_orderkey % 3', HEIGHTS)} AS INTEGER) AS height,
               CAST({_case('o_orderkey % 2', [59.94, 29.97])} AS DOUBLE) AS fps,
               CASE WHEN o_orderkey % 7 <> 3 THEN 100 + (o_orderkey * 37) % 5000 END AS frames,
               CASE WHEN o_orderkey % 5 <> 4 THEN (100 + (o_orderkey * 37) % 5000)
                    / CAST({_case('o_orderkey % 2', [59.94, 29.97])} AS DOUBLE) END AS duration_s,
               o_custkey AS profile_id, o_orderpriority AS priority, o_orderstatus AS status
        FROM orders"""),
    "profiles": ((), f"""
        SELECT p_partkey AS profile_id, p_name AS name,
               trim(concat(p_brand, ' ', p_type)) AS camera,
               CAST(CASE WHEN p_partkey % 11 <> 0 THEN {_case('p_size % 3', WIDTHS)} ELSE 0 END AS INTEGER) AS calib_w,
               CAST(CASE WHEN p_partkey % 11 <> 0 THEN {_case('p_size % 3', HEIGHTS)} ELSE 0 END AS INTEGER) AS calib_h,
               CAST(CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE {_case('p_partkey % 2', [59.94, 29.97])} END AS DOUBLE) AS fps,
               p_retailprice AS k00, p_retailprice + 3.0 AS k11,
               CAST({_case('p_partkey % 4', [1.0, 0.0, 1.33, 1.0])} AS DOUBLE) AS stretch_x,
               CAST({_case('p_partkey % 4', [1.0, 1.0, 0.0, 1.25])} AS DOUBLE) AS stretch_y
        FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0"""),
    "profile_paths": ((), """
        SELECT DISTINCT concat(p_brand, '/', replace(p_name, ' ', '_'), '_', p_type, '.json') AS path
        FROM part"""),
    "listing": ((), f"""
        SELECT concat('in/d', page_id % 5, '/f', page_id, '.',
                      {_case('page_id % 6', [f"'{e}'" for e in EXTENSIONS])}) AS path
        FROM pages"""),
}


def ctes(*names: str, recursive: bool = False) -> str:
    """`WITH ...` for the named views and everything they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in SQL[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    body = ", ".join(f"{n} AS ({SQL[n][1].strip()})" for n in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}"


SQL["sharpl8"] = (("lum8",), SQL["sharp8"][1].replace("frames8", "lum8"))


def sql_hex(list_expr: str) -> str:
    return f"array_to_string(list_transform({list_expr}, lambda v: printf('%02X', v)), '')"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def dumps(value) -> str:
    return json.dumps(value, separators=(",", ":"))
