import random
import time

import pytest
from pyspark.sql import functions as F

from framesift.operators.motion import motion_gated
from framesift.operators.selectors import Frame, MotionRule
from framesift.streaming import io as stream_io
from framesift.streaming import segments as S
from stream_states import Segmented, scrambled

SCHEMA = "clip_id long, frame_index long, sharpness double, gray binary, valid binary, is_end boolean"


def clip_rows(clip, n, rng, still=0.8):
    level, out = 100, []
    for i in range(n):
        level = (level + (rng.choice([0, 1]) if rng.random() < still else rng.choice([3, 40, 90]))) % 256
        out.append((clip, i, float(rng.randrange(6)), bytes((level + rng.randrange(4)) % 256 for _ in range(16)), None, False))
    return out


def end(clip):
    return clip, None, None, None, None, True


class Stream:
    def __init__(self, spark, tmp_path):
        self.spark, self.source = spark, str(tmp_path / "in")
        self.run = S.SegmentedRun(str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        self.schema = spark.createDataFrame([], SCHEMA).schema

    def put(self, rows, parts=1):
        self.spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode("append").parquet(self.source)

    def build(self, **options):
        def rows(messages):
            frames = stream_io.stream_frames_source(self.spark, self.source, self.schema, max_files=2)
            return S.stream_motion(frames, messages, **options)
        return rows

    def drain(self, tidy=False, **options):
        return self.run.drain(self.build(**options), self.spark, tidy)


def decisions(df):
    return sorted(tuple(r) for r in df.where("kind = 'decision'").select("clip_id", "frame_index", "keep").collect())


def kinds(df, kind):
    return sorted((r.clip_id, r.frame_index) for r in df.where(F.col("kind") == kind).collect())


def states(spark, run, operator):
    """Keys with state after the last batch, read by the state data source."""
    return (spark.read.format("statestore").option("operatorId", operator)
            .option("stateVarName", {0: "path", 1: "runs"}[operator]).load(run.checkpoint).count())


def plain(rows, threshold, window, floor):
    out = []
    for clip in sorted({r[0] for r in rows}):
        rule = MotionRule(threshold, window)
        for _, i, sharpness, gray, _, _ in sorted(r for r in rows if r[0] == clip):
            if floor is not None and sharpness < floor:
                out.append((clip, i, False))
            else:
                out += [(clip, *d) for d in rule.push(Frame(i, sharpness, S.np.frombuffer(gray, S.np.uint8)))]
        out += [(clip, *d) for d in rule.finish()]
    return sorted(out)


@pytest.mark.parametrize("seed", range(60))
def test_any_arrivals_equal_the_rule(seed):
    """Short segments and little lead-in, so that true states are often not among the likely ones and runs are asked for; messages come
    at once or late; frames come twice."""
    rng = random.Random(seed)
    still, floor = rng.choice([0.5, 0.8, 0.98]), rng.choice([None, 2.0])
    rows = [r for c in (1, 2) for r in clip_rows(c, rng.randint(1, 90), rng, still)]
    sim = Segmented(lambda: MotionRule(0.02, 4), floor, rng.choice([5, 10, 16]), rng.choice([0, 2, 4]))
    for part in scrambled(rows, rng, rng.randint(1, 6)):
        sim.batch(part + rng.sample(rows, rng.randint(0, 3)), rng.random() < 0.7)
    assert not sim.of("end")
    sim.batch([end(1), end(2)])
    sim.settle()
    assert sim.decided() == plain(rows, 0.02, 4, floor)
    assert sim.of("end") == [(c, sum(r[0] == c for r in rows)) for c in (1, 2)] and not sim.of("gap")
    # Ended clips leave their tombstone and counters alone.
    assert all(v <= {"ended", "counts"} for v in sim.held().values())
    sim.batch([rows[0], (2, 500, 1.0, bytes(16), None, False), end(1)])
    sim.settle()
    assert sim.of("late") == sorted([rows[0][:2], (2, 500)]) and all(v <= {"ended", "counts"} for v in sim.held().values())


@pytest.mark.parametrize("seed", range(20))
def test_any_lost_frame_is_a_gap(seed):
    rng = random.Random(seed)
    rows = clip_rows(1, 60, rng)
    lost = rng.randrange(59)
    sim = Segmented(lambda: MotionRule(0.02, 4), None, rng.choice([5, 16]), 3)
    for part in scrambled([r for r in rows if r[1] != lost], rng, 4):
        sim.batch(part)
    sim.batch([end(1)])
    sim.settle()
    assert sim.of("gap") == [(1, lost)] and not sim.of("end")
    made = sim.decided()
    assert made == [d for d in plain(rows, 0.02, 4, None) if d[1] < lost][:len(made)] and len(made) >= lost - 8
    assert all(v <= {"ended", "counts"} for v in sim.held().values())


def test_timers_of_silent_clips():
    rng = random.Random(3)
    rows = clip_rows(1, 33, rng) + [r for r in clip_rows(2, 33, rng) if r[1] != 20]
    sim = Segmented(lambda: MotionRule(0.02, 4), None, 8, 3, silent=5.0, remember=60.0)
    for part in (rows[:40], rows[40:]):
        sim.batch(part)
        sim.wait(4000)
        assert not sim.of("end") and not sim.of("gap")
        sim.settle()
    sim.wait(6000)
    sim.settle()
    assert sim.of("end") == [(1, 33)] and sim.of("gap") == [(2, 20)]
    assert [d for d in sim.decided() if d[0] == 1] == [d for d in plain(rows, 0.02, 4, None) if d[0] == 1]
    assert all(not h.timers for h in sim.second.values())


def test_scrambled_segments_equal_batch(spark, tmp_path):
    """On Spark, over two runs of the query: equal to the batch form, and no state is left behind."""
    rng = random.Random(1)
    rows = clip_rows(1, 60, rng, 0.9) + clip_rows(2, 40, rng, 0.9) + clip_rows(4, 3, rng)
    stream = Stream(spark, tmp_path)
    shuffled = rng.sample(rows, len(rows))
    options = dict(threshold=0.02, window=4, segment=10, warmup=4)
    stream.put(shuffled[:70])
    stream.drain(**options)
    stream.put(shuffled[70:] + [end(c) for c in (1, 2, 4)])
    got = stream.drain(tidy=True, **options)
    batch = motion_gated(spark.createDataFrame(rows, SCHEMA), 0.02, 4)
    assert decisions(got) == sorted(tuple(r) for r in batch.select("clip_id", "frame_index", "keep").collect())
    assert kinds(got, "end") == [(1, 60), (2, 40), (4, 3)] and not kinds(got, "gap")
    assert got.where("kind = 'message' AND frame_index = 1").count() > 0
    assert states(spark, stream.run, 0) == 0 and states(spark, stream.run, 1) == 0


def test_one_clip_uses_many_tasks(spark, tmp_path):
    rows = clip_rows(7, 400, random.Random(3))
    stream = Stream(spark, tmp_path)
    stream.put(rows + [end(7)])
    query = stream.run.start(stream.build(threshold=0.02, window=4, segment=20, warmup=4)(stream.run.messages(spark)), availableNow=True)
    query.awaitTermination()
    held = (spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "runs").load(stream.run.checkpoint)
            .groupBy("partition_id").count().collect())
    assert len(held) == spark.sparkContext.defaultParallelism


def test_a_silent_clip_ends_by_a_timer(spark, tmp_path):
    """No marker ever comes: after the timeout one clip ends and one, which lacks a frame, is a gap.  A frame after that is late."""
    rng = random.Random(4)
    rows = clip_rows(1, 23, rng) + [r for r in clip_rows(2, 23, rng) if r[1] != 12]
    stream = Stream(spark, tmp_path)
    stream.put(rows, 2)
    query = stream.run.start(stream.build(threshold=0.02, window=4, segment=10, warmup=4, silent=2.0, remember=3600.0)(
        stream.run.messages(spark)), processingTime="200 milliseconds")
    try:
        stream_io.wait_for_rows(query, stream.run.out, S.RESULT, "kind in ('end', 'gap')", 2, 90)
        stream.put([rows[2], (2, 12, 1.0, bytes(16), None, False)])
        stream_io.wait_for_rows(query, stream.run.out, S.RESULT, "kind = 'late'", 2, 90)
        until = time.time() + 60
        while time.time() < until and states(spark, stream.run, 1):
            time.sleep(0.5)
    finally:
        query.stop()
    got = stream.run.read(spark)
    assert kinds(got, "end") == [(1, 23)] and kinds(got, "gap") == [(2, 12)] and kinds(got, "late") == [(1, 2), (2, 12)]
    assert [d for d in decisions(got) if d[0] == 1] == [d for d in plain(rows, 0.02, 4, None) if d[0] == 1]
    assert states(spark, stream.run, 0) == 0 and states(spark, stream.run, 1) == 0


def test_in_order(spark, tmp_path):
    rng = random.Random(6)
    frames = [(c, i, None, None, None, False) for c in (1, 2) for i in range(35)]
    rng.shuffle(frames)
    stream = Stream(spark, tmp_path)
    stream.put(frames + [end(1), end(2)])
    got = stream.run.drain(lambda m: S.stream_in_order(stream_io.stream_frames_source(
        spark, stream.source, stream.schema), m, segment=8), spark)
    made = got.where("kind = 'decision'").collect()
    assert sorted((r.clip_id, r.frame_index, r.emitted) for r in made) == [(c, i, i) for c in (1, 2) for i in range(35)]
    assert kinds(got, "end") == [(1, 35), (2, 35)]
