import random

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from framesift.operators.motion import motion_gated
from framesift.streaming import io as stream_io
from framesift.streaming import ordered as O

SCHEMA = "clip_id long, frame_index long, sharpness double, gray binary, valid binary, is_end boolean"


def clip_rows(clip, n, rng):
    level, out = 100, []
    for i in range(n):
        level = (level + rng.choice([0, 1, 3, 40 if rng.random() < 0.2 else 2])) % 256
        out.append((clip, i, float(rng.randrange(6)), bytes((level + rng.randrange(4)) % 256 for _ in range(16)),
                    None, False))
    return out


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, out, operator, **kw):
    stream = stream_io.stream_frames_source(
        spark, source, spark.createDataFrame([], SCHEMA).schema, **kw)
    stream_io.run_available(operator(stream), out, out + "-checkpoint")
    return spark.read.parquet(out)


def test_scrambled_stream_over_restarts_equals_batch(spark, tmp_path):
    """Frames arrive out of order over three runs of the query; each run picks up
    where the one before stopped."""
    rng = random.Random(1)
    rows = clip_rows(1, 40, rng) + clip_rows(2, 25, rng)
    batch = motion_gated(spark.createDataFrame(rows, SCHEMA), 0.02, 4)
    want = sorted(tuple(r) for r in batch.select("clip_id", "frame_index", "keep").collect())
    rng.shuffle(rows)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [rows[:20], rows[20:45], rows[45:] + [(c, None, None, None, None, True) for c in (1, 2)]]
    for part in parts:
        put(spark, part, source)
        got = run(spark, source, out, lambda s: O.stream_select(s, 0.02, 4), max_files=1)
        held_back = got.filter("kind = 'decision'").count()
    assert held_back == len(want)
    made = got.filter("kind = 'decision'").select("clip_id", "frame_index", "keep")
    assert sorted(tuple(r) for r in made.collect()) == want
    assert sorted((r.clip_id, r.frame_index) for r in got.filter("kind = 'end'").collect()) == [(1, 40), (2, 25)]


def test_a_lost_frame_is_a_gap_and_nothing_is_flushed(spark, tmp_path):
    rows = [r for r in clip_rows(1, 10, random.Random(0)) if r[1] != 4]
    source = str(tmp_path / "in")
    put(spark, rows + [(1, None, None, None, None, True)], source)
    got = run(spark, source, str(tmp_path / "out"), O.stream_reorder)
    assert [r.frame_index for r in got.filter("kind = 'gap'").collect()] == [4]
    assert sorted(r.frame_index for r in got.filter("kind = 'frame'").collect()) == [0, 1, 2, 3]


def test_a_copy_of_a_frame_is_decided_once(spark, tmp_path):
    rows = clip_rows(1, 6, random.Random(0))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, rows[:4], source)
    run(spark, source, out, lambda s: O.stream_every_nth(s, 2))
    put(spark, rows[2:] + [(1, None, None, None, None, True)], source)
    got = run(spark, source, out, lambda s: O.stream_every_nth(s, 2))
    assert sorted((r.frame_index, r.keep) for r in got.filter("kind = 'decision'").collect()) == \
        [(i, i % 2 == 0) for i in range(6)]


@pytest.mark.parametrize("window", [1, 4])
def test_stream_smoothing_equals_batch(spark, tmp_path, window):
    from framesift.operators.masks import label_smoothing
    rng = np.random.default_rng(window)
    rows = [(1, i, bytes(rng.integers(0, 3, 5).tolist()), False) for i in range(12)]
    schema = "clip_id long, frame_index long, labels binary, is_end boolean"
    frames = spark.createDataFrame(rows + [(1, None, None, True)], schema)
    frames.write.parquet(str(tmp_path / "in"))
    stream = stream_io.stream_frames_source(spark, str(tmp_path / "in"), frames.schema)
    out = str(tmp_path / "out")
    stream_io.run_available(O.stream_smoothing(stream, window), out, out + "-c")
    got = {r.frame_index: r.labels for r in spark.read.parquet(out).filter("kind = 'frame'").collect()}
    batch = label_smoothing(frames.filter("not is_end"), window)
    assert got == {r.frame_index: r.labels for r in batch.collect()}


def test_new_image_files_stream_in(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a_000001.png").write_bytes(b"x")
    out = str(tmp_path / "out")
    stream = stream_io.stream_image_files(spark, str(folder)).select("path", "length")
    stream_io.run_available(stream, out, out + "-c")
    (folder / "a_000002.png").write_bytes(b"xy")
    stream = stream_io.stream_image_files(spark, str(folder)).select("path", "length")
    stream_io.run_available(stream, out, out + "-c")
    assert sorted(r.length for r in spark.read.parquet(out).collect()) == [1, 2]


def test_sink_is_idempotent_per_batch(spark, tmp_path):
    from framesift.sources import manifest as M
    frames = spark.createDataFrame([(1, "c", i, 1, 1, bytes([i] * 3)) for i in range(3)],
                                   "clip_id long, stem string, frame_index long, width int, height int, rgb binary")
    schema = "clip_id long, kind string, frame_index long, keep boolean"
    first = spark.createDataFrame([(1, "decision", 0, True), (2, "decision", 0, False), (2, "gap", 1, None)], schema)
    second = spark.createDataFrame([(1, "decision", 1, False), (1, "decision", 2, True), (1, "kept", 0, True), (1, "kept", 2, True),
                                    (1, "end", 3, None)], schema)
    clips = spark.createDataFrame([(1, "c"), (2, "d")], "clip_id long, stem string")
    sink = stream_io.dataset_sink(lambda kept: frames.join(kept, ["clip_id", "frame_index"], "left_semi"),
                                  clips, str(tmp_path), "r")
    sink(first, 0)
    assert M.recorded_clips(spark, str(tmp_path / "manifest"), "r") is None
    for _ in range(2):
        sink(second, 1)
    got = M.recorded_clips(spark, str(tmp_path / "manifest"), "r").collect()
    assert [(r.clip_id, r.stem, r.frames_decoded, r.frames_kept) for r in got] == [(1, "c", 3, 2)]
    assert [r.kept_frames for r in M.recorded_kept(spark, str(tmp_path / "manifest"), "r").collect()] == [[0, 2]]
    names = sorted(p.name for p in (tmp_path / "images").iterdir() if p.name.endswith(".png"))
    assert names == ["c_000000.png", "c_000002.png"]
    # What was staged is dropped with the next batch.
    assert [p.name for p in (tmp_path / "manifest" / "staged" / "run_id=r").iterdir()] == ["batch=1"]


def test_one_long_clip_backwards(spark, tmp_path):
    """Far more frames are early than are held in memory; all come out in order."""
    n = 3000
    assert n > 2 * O.AHEAD_ROWS
    frames = spark.range(n).select(F.lit(7).cast("long").alias("clip_id"), (F.lit(n - 1) - F.col("id")).alias("frame_index"),
                                   F.lit(False).alias("is_end"))
    ends = spark.createDataFrame([(7, None, True)], "clip_id long, frame_index long, is_end boolean")
    frames.coalesce(1).union(ends).write.parquet(str(tmp_path / "in"))
    stream = stream_io.stream_frames_source(spark, str(tmp_path / "in"), ends.schema)
    out = str(tmp_path / "out")
    stream_io.run_available(O.stream_reorder(stream), out, out + "-c")
    got = spark.read.parquet(out)
    assert got.filter("kind = 'frame' AND frame_index = emitted").count() == n
    assert [r.frame_index for r in got.filter("kind = 'end'").collect()] == [n]


def test_a_copy_of_an_early_frame_is_no_gap(spark, tmp_path):
    schema = "clip_id long, frame_index long, is_end boolean"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, 0, False), (1, 2, False)], [(1, 2, False), (1, 1, False), (1, 2, False), (1, None, True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = stream_io.stream_frames_source(spark, source, spark.createDataFrame([], schema).schema)
        stream_io.run_available(O.stream_reorder(stream), out, out + "-c")
    got = sorted((r.kind, r.frame_index) for r in spark.read.parquet(out).collect())
    assert got == [("end", 3), ("frame", 0), ("frame", 1), ("frame", 2)]


def test_killed_inside_a_batch(spark, tmp_path):
    """The sink fails when the images of a batch are written and its record is not: the batch is done again from the same
    state, and images and records are those of an undisturbed run."""
    from framesift.sources import manifest as M
    rng = random.Random(5)
    rows = clip_rows(1, 30, rng) + clip_rows(2, 20, rng)
    rng.shuffle(rows)
    pixels = spark.createDataFrame([(r[0], f"c{r[0]}", r[1], 1, 1, bytes(3)) for r in rows],
                                   "clip_id long, stem string, frame_index long, width int, height int, rgb binary")
    clips = pixels.select("clip_id", "stem").distinct()
    source, found = str(tmp_path / "in"), {}
    for part in (rows[:15], rows[15:35], rows[35:] + [(c, None, None, None, None, True) for c in (1, 2)]):
        put(spark, part, source)
    for name, failing in (("whole", None), ("killed", 2)):
        out = str(tmp_path / name)
        sink = stream_io.dataset_sink(lambda kept: pixels.join(kept, ["clip_id", "frame_index"], "left_semi"), clips, out, "r")
        states = []

        def write(decided, batch):
            states.append((batch, snapshot(spark, f"{out}-c") if batch else None))
            if batch == failing and len([b for b, _ in states if b == batch]) == 1:
                real = M.record_clips
                M.record_clips = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed"))
                try:
                    sink(decided, batch)
                finally:
                    M.record_clips = real
            else:
                sink(decided, batch)
        for attempt in range(2):
            stream = stream_io.stream_frames_source(spark, source, spark.createDataFrame([], SCHEMA).schema, max_files=1)
            with stream_io.state_partitions(spark):
                query = (O.stream_select(stream, 0.02, 4, lists=True).writeStream.foreachBatch(write)
                         .option("checkpointLocation", out + "-c").trigger(availableNow=True).start())
            try:
                query.awaitTermination()
            except StreamingQueryException:
                if failing is None or attempt:
                    raise
                assert M.recorded_clips(spark, f"{out}/manifest", "r") is None
        again = [s for b, s in states if b == failing]
        assert failing is None or (len(again) == 2 and again[0] == again[1])
        found[name] = (
            sorted((r.clip_id, r.frames_decoded, r.frames_kept) for r in M.recorded_clips(spark, f"{out}/manifest", "r").collect()),
            sorted((r.clip_id, r.chunk, r.kept_frames) for r in M.recorded_kept(spark, f"{out}/manifest", "r").collect()),
            sorted(p.name for p in (tmp_path / name / "images").iterdir() if p.name.endswith(".png")))
    assert found["whole"] == found["killed"] and [r[1] for r in found["whole"][0]] == [30, 20]


def snapshot(spark, checkpoint):
    """What the operator's state held after the last committed batch."""
    rows = spark.read.format("statestore").option("stateVarName", "next_emit").load(checkpoint)
    return sorted((r.key.clip_id, r.value.value) for r in rows.collect())


def test_late_frames_timers_and_counters(spark, tmp_path):
    """Without a marker a silent clip ends by its timer; what comes after an end is `late`; counters outlive it all."""
    rng = random.Random(2)
    rows = [r for r in clip_rows(1, 9, rng)] + [r for r in clip_rows(2, 9, rng) if r[1] != 3]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def start():
        stream = stream_io.stream_frames_source(spark, source, spark.createDataFrame([], SCHEMA).schema)
        with stream_io.state_partitions(spark):
            return (O.stream_every_nth(stream, 2, silent=1.5, remember=3600.0, lists=True).writeStream.format("parquet").option("path", out)
                    .option("checkpointLocation", out + "-c").trigger(processingTime="100 milliseconds").start())
    put(spark, rows, source)
    query = start()
    schema = O.DECISIONS
    stream_io.wait_for_rows(query, out, schema, "kind in ('end', 'gap')", 2)
    query.stop()
    put(spark, [rows[4], (2, 3, 1.0, bytes(16), None, False)], source)
    query = start()
    stream_io.wait_for_rows(query, out, schema, "kind = 'late'", 2)
    query.stop()
    got = spark.read.parquet(out)
    assert sorted((r.clip_id, r.kind, r.frame_index) for r in got.where("kind not in ('decision', 'kept')").collect()) == [
        (1, "end", 9), (1, "late", 4), (2, "gap", 3), (2, "late", 3)]
    assert sorted((r.clip_id, r.frame_index) for r in got.where("kind = 'kept'").collect()) == [(1, i) for i in (0, 2, 4, 6, 8)]
    assert sorted(tuple(r) for r in stream_io.progress(spark, out + "-c").collect()) == [(1, 9, 5), (2, 3, 2)]
    for name in ("next_emit", "rule", "timer"):
        assert spark.read.format("statestore").option("stateVarName", name).load(out + "-c").count() == 0


def test_a_long_batch_is_waited_for(spark, tmp_path):
    """The time to wait is counted while nothing is done, not while a batch is under way."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1,)], "a long").coalesce(1).write.parquet(source)

    def slow(batches):
        import time
        for batch in batches:
            time.sleep(6 if len(batch) else 0)
            yield batch
    stream = spark.readStream.schema("a long").parquet(source).mapInPandas(slow, "a long")
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c")
             .trigger(processingTime="100 milliseconds").start())
    try:
        stream_io.wait_for_rows(query, out, "a long", "a = 1", 1, seconds=2)
        with pytest.raises(TimeoutError, match="1 of 2 rows"):
            stream_io.wait_for_rows(query, out, "a long", "a = 1", 2, seconds=2)
    finally:
        query.stop()


class Calls:
    """State in memory that counts the round trips to it."""

    def __init__(self):
        self.calls, self.values, self.maps = 0, {}, {}

    def getValueState(self, name, schema, ttl=None):
        return _State(self, self.values.setdefault(name, {}))

    def getMapState(self, name, key, schema, ttl=None):
        return _State(self, self.maps.setdefault(name, {}))


class _State:
    def __init__(self, owner, held):
        self.owner, self.held = owner, held

    def __getattribute__(self, name):
        if name not in ("owner", "held"):
            object.__getattribute__(self, "owner").calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[()]

    def update(self, value):
        self.held[()] = value

    def clear(self):
        self.held.clear()

    def keys(self):
        return list(self.held)

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        self.held.pop(key, None)


@pytest.mark.parametrize("ahead", [None, 0])
def test_early_frames_cost_no_round_trip_each(ahead):
    """Every other frame comes first; with no bytes to hold them, what is early goes to the state store within a batch, too."""
    import pandas as pd
    n, state, out = 4096, Calls(), []
    rng = random.Random(3)
    odd, even = list(range(1, n, 2)), list(range(0, n, 2))
    for batch in (odd, even + odd[:5] + [None]):
        rng.shuffle(batch)
        processor = O.Smooth(3)
        if ahead is not None:
            processor.ahead_rows = processor.ahead_bytes = ahead
        processor.init(state)
        rows = [(7, i, None if i is None else bytes([i % 251]), i is None) for i in batch]
        pdfs = [pd.DataFrame(rows[a:a + 300], columns=["clip_id", "frame_index", "labels", "is_end"]) for a in range(0, len(rows), 300)]
        for made in processor.handleInputRows((7,), iter(pdfs), None):
            out += made.itertuples(index=False, name=None)
    assert [r[1:3] for r in out] == [*(("frame", i) for i in range(n)), ("end", n)]
    assert [r[3] for r in out[:5]] == [bytes([v]) for v in (0, 0, 0, 1, 2)]
    assert state.calls < (n / 8 if ahead is None else 3 * n) and not state.maps["early"]
