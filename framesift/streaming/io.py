"""Stream sources, the dataset sink and progress."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from framesift.operators import selection
from framesift.sources import images
from framesift.sources import manifest


def stream_frames_source(spark: SparkSession, path: str, schema: T.StructType,
                         max_files: int | None = 1000, glob: str | None = None) -> DataFrame:
    """Frame files of a table as they arrive; `max_files` per batch is the back-pressure."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_image_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New image files of a folder: (path, modificationTime, length, content)."""
    return (spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files)
            .schema("path string, modificationTime timestamp, length long, content binary").load(path))


@contextmanager
def state_partitions(spark: SparkSession, count: int | None = None):
    """Start stateful queries with as many state stores as there are cores.

    A stream's partition count is fixed with its checkpoint and not adapted at run
    time, so the batch default would open hundreds of stores on a small machine.
    """
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(count or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything there is into a Parquet folder, then stop."""
    with state_partitions(df.sparkSession):
        query = (df.writeStream.format("parquet").option("path", path)
                 .option("checkpointLocation", checkpoint).outputMode(mode)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return query


def wait_for_rows(query: StreamingQuery, path: str, schema: str, condition: str, count: int, seconds: float = 120.0) -> None:
    """Wait until a running query has written so many rows of a kind.

    It fails when batches have read no input and made no such row for `seconds`; a batch under way is waited for, however long
    it takes.  Rows are counted again only when a batch was finished.
    """
    spark = SparkSession.active()
    found, batch, moved = -1, None, time.time()
    while True:
        active, last = query.isActive, query.lastProgress
        done = last and (last["runId"], last["batchId"])
        if found < 0 or done != batch or not active:
            now = spark.read.schema(schema).parquet(path).filter(condition).count()
            if now >= count:
                return
            if now > found or (done != batch and last["numInputRows"]):
                moved = time.time()
            found = now
        idle, batch = done != batch or not query.status["isTriggerActive"], done
        if not active:
            query.awaitTermination()
            raise RuntimeError(f"the query ended with {found} of {count} rows with {condition}")
        if idle and time.time() - moved > seconds:
            raise TimeoutError(f"{found} of {count} rows with {condition}, and nothing for {seconds} seconds")
        time.sleep(0.2)


def dataset_sink(frames_of: Callable[[DataFrame], DataFrame], clips: DataFrame, out: str, run_id: str,
                 ext: str = "png") -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that writes kept frames as they are decided.

    It takes decisions made with `lists`: the `end` row of a clip comes with all its kept frames, which the operator's state
    held.  Images come first, and a clip is recorded in the batch that brings its end, from the rows of that batch
    alone; a clip with a gap never gets one and so is never recorded.  A batch is staged while it is worked on and
    the one before it is dropped, so the stage does not grow with the run.  Every step replaces what an earlier
    attempt at the same batch left, so a batch that runs twice counts once.
    `frames_of` fetches pixels for decisions; `clips` holds the clips' own columns,
    which the record takes over.
    """
    # Before the stream starts: a micro-batch runs in a copy of this session.
    images.register_sink(SparkSession.active())
    table = f"{out}/manifest"

    def write(decided: DataFrame, batch: int) -> None:
        spark = decided.sparkSession
        manifest.stage_decisions(decided.select("clip_id", "kind", "frame_index", "keep"), table, run_id, batch)
        manifest.drop_staged(spark, table, run_id, batch)
        mine = manifest.staged_decisions(spark, table, run_id, batch)
        kept = mine.filter("kind = 'decision' and keep").select("clip_id", "frame_index", "keep")
        images.write_images(frames_of(kept), f"{out}/images", ext)
        ended = mine.filter("kind = 'end'").select("clip_id", F.col("frame_index").alias("frames_decoded"))
        if not ended.limit(1).count():
            return
        lists = mine.filter("kind = 'kept'").select("clip_id", "frame_index", "keep")
        counts = lists.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames_kept"))
        record = clips.join(ended, "clip_id").join(counts, "clip_id", "left").withColumn("frames_kept", F.coalesce("frames_kept", F.lit(0)))
        manifest.record_clips(record, selection.kept_chunks(lists), table, run_id, batch)
    return write


def progress(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """(clip_id, decoded, kept) so far, read from the state of a stopped or running query as of its last finished batch.

    It is the state that decides, so the counters go on where they were when a query is started again.
    """
    rows = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "counts").load(checkpoint)
    # A state that expires has its value one level further in.
    value = "value.value" if "ttlExpirationMs" in rows.schema["value"].dataType.names else "value"
    return rows.select("key.clip_id", f"{value}.decoded", f"{value}.kept")


class Progress(StreamingQueryListener):
    """Run counters of streaming queries that carry `counted` metrics."""

    def __init__(self):
        self.decoded = self.kept = self.batches = 0
        self._moved = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("frames")
        if row is not None:
            with self._moved:
                self.decoded += row["decoded"] or 0
                self.kept += row["kept"] or 0
                self.batches += 1
                self._moved.notify_all()

    def wait_for(self, decoded: int, seconds: float = 60.0) -> bool:
        """Events reach a listener after the batch; wait until they cover `decoded` frames."""
        with self._moved:
            return self._moved.wait_for(lambda: self.decoded >= decoded, seconds)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counted(decisions: DataFrame) -> DataFrame:
    """Count frames on their way through; no extra pass, no shuffle."""
    decided = F.col("kind") == "decision"
    return decisions.observe("frames", F.count_if(decided).alias("decoded"),
                             F.count_if(decided & F.col("keep")).alias("kept"))
