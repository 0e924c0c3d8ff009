"""Streaming queries: each runs until its input is drained and returns what it wrote."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from framesift.plans import views as V
from framesift.plans.ordered import _MOTION, sharp8
from framesift.plans.registry import query
from framesift.session import materialise, scratch_path
from framesift.sources import images
from framesift.sources import manifest as manifest_source
from framesift.streaming import io as stream_io
from framesift.streaming import ordered as O
from framesift.streaming import segments as S


def _rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _arrivals(frames, clip: str = "clip_id", marked_clips=None) -> tuple[str, object]:
    """The frames as files in scrambled order, then one end marker per clip (or for some)."""
    spark = frames.sparkSession
    _rocksdb(spark)
    path = scratch_path(spark, "arrivals")
    marked = frames.withColumn("is_end", F.lit(False))
    marked.repartition(3, F.hash("clip_id", "frame_index")).write.parquet(path)
    ends = spark.read.parquet(path).select("clip_id").distinct()
    if marked_clips is not None:
        ends = ends.filter(marked_clips)
    for name, kind in marked.dtypes:
        if name != clip:
            ends = ends.withColumn(name, F.lit(True) if name == "is_end" else F.lit(None).cast(kind))
    ends.select(marked.columns).write.mode("append").parquet(path)
    return path, marked.schema


def _drained(frames, operator, **source):
    """Run a streaming operator over the arrivals and read its output table."""
    spark = frames.sparkSession
    path, schema = _arrivals(frames)
    stream = stream_io.stream_frames_source(spark, path, schema, **source)
    out = scratch_path(spark, "streamed")
    stream_io.run_available(operator(stream), out, f"{out}-checkpoint")
    return spark.read.parquet(out)


@query("stream_frames_source", "SELECT event_id, user_id, event_type, value FROM events")
def stream_frames_source(spark, sf):
    schema = V.table(spark, sf, "events").schema
    stream = stream_io.stream_frames_source(spark, sf, schema, glob="events.parquet")
    out = scratch_path(spark, "streamed")
    stream_io.run_available(stream.select("event_id", "user_id", "event_type", "value"), out,
                            f"{out}-checkpoint")
    return spark.read.parquet(out)


@query("stream_reorder", V.ctes("metric_events") + """
    SELECT clip_id, frame_index, frame_index AS emitted FROM metric_events""")
def stream_reorder(spark, sf):
    frames = V.metric_events(spark, sf).select("clip_id", "frame_index")
    return _drained(frames, O.stream_reorder).filter("kind = 'frame'").select(
        "clip_id", "frame_index", "emitted")


@query("stream_gap_detect", V.ctes("metric_events") + """,
    have AS (SELECT clip_id, frame_index FROM metric_events WHERE event_type <> 'error'),
    e AS (SELECT clip_id, frame_index,
                 coalesce(lag(frame_index) OVER (PARTITION BY clip_id ORDER BY frame_index), -1) + 1 AS expected FROM have)
    SELECT clip_id, min(expected) AS gap_at FROM e WHERE frame_index <> expected GROUP BY clip_id""")
def stream_gap_detect(spark, sf):
    """Every other clip has an end marker; the others fall silent and are ended by their timers."""
    frames = V.metric_events(spark, sf).filter("event_type <> 'error'").select("clip_id", "frame_index")
    path, schema = _arrivals(frames, marked_clips=F.col("clip_id") % 2 == 0)
    clips = spark.read.parquet(path).select("clip_id").distinct().count()
    # All frames come in one batch, so no clip is silent before its frames are here.
    stream = stream_io.stream_frames_source(spark, path, schema, max_files=None)
    out = scratch_path(spark, "streamed")
    with stream_io.state_partitions(spark):
        run = (O.stream_reorder(stream, silent=1.0, remember=86400.0).writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", f"{out}-checkpoint").trigger(processingTime="100 milliseconds").start())
    try:
        stream_io.wait_for_rows(run, out, O.ORDERED, "kind in ('end', 'gap')", clips)
    finally:
        run.stop()
    return spark.read.schema(O.ORDERED).parquet(out).filter("kind = 'gap'").select("clip_id", F.col("frame_index").alias("gap_at"))


def _selectable(spark, sf):
    return sharp8(spark, sf).select(
        "clip_id", "frame_index", "sharpness", "gray", F.lit(None).cast("binary").alias("valid"))


@query("stream_select", V.ctes("sharp8", recursive=True) + _MOTION.format(where=""))
def stream_select(spark, sf):
    """Equal to the batch selection, from scrambled arrivals over several batches, with every clip cut into segments."""
    path, schema = _arrivals(_selectable(spark, sf))
    out = scratch_path(spark, "streamed")

    def rows(messages):
        stream = stream_io.stream_frames_source(spark, path, schema, max_files=2)
        return S.stream_motion(stream, messages, 0.07, 4, segment=128)
    found = S.SegmentedRun(out, f"{out}-checkpoint").drain(rows, spark)
    return found.filter("kind = 'decision'").select("clip_id", "frame_index", "keep")


class _FailsOnce:
    """Writes each batch under its number, and fails in one of them when its rows are written but not yet recorded."""

    def __init__(self, out: str, batch: int):
        self.out, self.batch, self.failed = out, batch, False

    def __call__(self, rows, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
        if batch == self.batch and not self.failed:
            self.failed = True
            raise RuntimeError("stopped inside a batch")


@query("stream_resume", V.ctes("sharp8", recursive=True) + _MOTION.format(where=""))
def stream_resume(spark, sf):
    """The query fails inside its second batch, after the rows were written and before the batch was committed.  Started again it
    does that batch once more, from the state that the first one left, and nothing is decided twice."""
    path, schema = _arrivals(_selectable(spark, sf))
    out = scratch_path(spark, "streamed")
    sink = _FailsOnce(out, 1)
    for attempt in range(2):
        stream = O.stream_select(stream_io.stream_frames_source(spark, path, schema, max_files=2), 0.07, 4)
        with stream_io.state_partitions(spark):
            run = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}-checkpoint")
                   .trigger(availableNow=True).start())
        try:
            run.awaitTermination()
        except StreamingQueryException:
            if attempt:
                raise
    if not sink.failed:
        raise RuntimeError("the batch to fail in never came")
    return spark.read.parquet(out).filter("kind = 'decision'").select("clip_id", "frame_index", "keep")


@query("stream_smoothing", V.ctes("labels8") + """,
    p AS (SELECT clip_id, frame_index, i, labels[i + 1] AS label FROM labels8, range(64) AS t(i)),
    t AS (SELECT a.clip_id, a.frame_index, a.i, b.label, count(*) AS n, min(b.frame_index) AS first_seen
          FROM p a JOIN p b ON b.clip_id = a.clip_id AND b.i = a.i
                           AND b.frame_index BETWEEN a.frame_index - 2 AND a.frame_index
          GROUP BY a.clip_id, a.frame_index, a.i, b.label),
    s AS (SELECT clip_id, frame_index, i, label FROM t
          QUALIFY row_number() OVER (PARTITION BY clip_id, frame_index, i ORDER BY n DESC, first_seen) = 1)
    SELECT clip_id, frame_index, string_agg(printf('%02X', label), '' ORDER BY i) AS labels
    FROM s GROUP BY clip_id, frame_index""")
def stream_smoothing(spark, sf):
    frames = V.labels8(spark, sf).select("clip_id", "frame_index", "labels")
    return _drained(frames, lambda s: O.stream_smoothing(s, 3)).filter("kind = 'frame'").select(
        "clip_id", "frame_index", F.hex("labels").alias("labels"))


@query("stream_dataset_sink", V.ctes("sharp8", recursive=True)
       + _MOTION.format(where="").rsplit("SELECT s.clip_id", 1)[0] + """
    SELECT concat('clip', clip_id) AS stem, k.frame_index, n.frames_kept, c.frames_decoded
    FROM kept k JOIN (SELECT clip_id, count(*) AS frames_kept FROM kept GROUP BY clip_id) n USING (clip_id)
    JOIN (SELECT clip_id, count(*) AS frames_decoded, max(frame_index) AS last FROM sharp8 GROUP BY clip_id) c USING (clip_id)
    WHERE NOT (clip_id % 4 = 3 AND last > 5)""")
def stream_dataset_sink(spark, sf):
    """Kept frames written while they are decided, whole clips recorded.  Frame 5 of
    every fourth clip is lost, so these clips have no record."""
    stored = scratch_path(spark, "stored")
    images.frames_to_table(V.rgb8(spark, sf).withColumn("stem", F.concat(F.lit("clip"), "clip_id")), stored)
    frames = spark.read.parquet(stored)
    lost = (F.col("clip_id") % 4 == 3) & (F.col("frame_index") == 5)
    path, schema = _arrivals(_selectable(spark, sf).filter(~lost))
    clips = materialise(frames.select("clip_id", "stem").distinct(), "clips")
    out = scratch_path(spark, "dataset")
    stream = stream_io.stream_frames_source(spark, path, schema, 2)
    sink = stream_io.dataset_sink(lambda kept: images.kept_only(frames, kept), clips, out, "run")
    with stream_io.state_partitions(spark):
        (O.stream_select(stream, 0.07, 4, lists=True).writeStream.foreachBatch(sink)
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
         .awaitTermination())
    records = manifest_source.recorded_clips(spark, f"{out}/manifest", "run").select("stem", "frames_kept", "frames_decoded")
    return images.read_image_frames(spark, f"{out}/images").select("stem", "frame_index").join(records, "stem")


@query("stream_progress", V.ctes("metric_events") + """,
    p AS (SELECT clip_id, frame_index, row_number() OVER (PARTITION BY clip_id ORDER BY frame_index) AS rn
          FROM metric_events WHERE NOT (sharpness < 100))
    SELECT (SELECT count(*) FROM metric_events) AS decoded,
           (SELECT count(*) FROM p WHERE (rn - 1) % 5 = 0) AS kept""")
def stream_progress(spark, sf):
    """The counters that the deciding operator holds, read from its state after the query was stopped and started again."""
    frames = V.metric_events(spark, sf).select(
        "clip_id", "frame_index", "sharpness", F.lit(b"").alias("gray"),
        F.lit(None).cast("binary").alias("valid"))
    path, schema = _arrivals(frames)
    out, source = scratch_path(spark, "streamed"), scratch_path(spark, "arriving")
    arrived = spark.read.schema(schema).parquet(path)
    late = (F.hash("clip_id", "frame_index") % 2 == 0) | F.col("is_end")
    for part in (arrived.filter(~late), arrived.filter(late)):
        part.write.mode("append").parquet(source)
        stream = O.stream_every_nth(stream_io.stream_frames_source(spark, source, schema), 5, 100.0)
        stream_io.run_available(stream, out, f"{out}-checkpoint")
    return stream_io.progress(spark, f"{out}-checkpoint").agg(F.sum("decoded").alias("decoded"), F.sum("kept").alias("kept"))
