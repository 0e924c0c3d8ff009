import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import audits, records, replay, selection
from framesift.operators.motion import motion_gated
from framesift.operators.selectors import Counted, Frame, MotionRule
from framesift.operators.stems import unique_stems

METRIC = "clip_id long, frame_index long, sharpness double, gray binary"


def frames(spark, rows, clip=0):
    return spark.createDataFrame(
        [(clip, i, float(s), bytes([g] * 16)) for i, (s, g) in enumerate(rows)], METRIC)


def kept(df):
    return sorted(r.frame_index for r in df.filter("keep").collect())


def test_every_nth(spark):
    d = selection.every_nth(frames(spark, [(1, 0)] * 10), 3)
    assert kept(d) == [0, 3, 6, 9]
    assert d.count() == 10


def test_every_nth_counts_only_frames_past_the_floor_across_segments(spark):
    rng = random.Random(3)
    rows = [(rng.choice([5, 50]), 0) for _ in range(200)]
    passing = [i for i, r in enumerate(rows) if r[0] >= 10]
    for segment in (7, 4096):
        assert kept(selection.every_nth(frames(spark, rows), 4, 10.0, segment)) == passing[::4]


def test_every_nth_refuses_zero(spark):
    with pytest.raises(ValueError):
        selection.every_nth(frames(spark, [(1, 0)]), 0)


def test_blur_floor_drops_in_any_mode(spark):
    f = frames(spark, [(50, 0), (5, 0), (50, 0)])
    assert kept(selection.every_nth(f, 1, 10.0)) == [0, 2]
    nan = frames(spark, [(float("nan"), 0), (10, 0), (9.99, 0)])
    assert kept(selection.every_nth(nan, 1, 10.0)) == [0, 1]


# Two still scenes with one cut between them; the second frame after the cut is the sharpest of its window,
# and the scene then changes once more, too late to fill a window.
CUT = [(40, 10), (90, 12), (70, 11), (30, 12), (20, 90), (65, 91), (60, 90), (64, 92), (80, 91), (10, 160), (15, 161)]


def test_a_window_opens_at_a_cut_and_keeps_its_sharpest_frame(spark):
    d = motion_gated(frames(spark, CUT), 0.1, 4)
    assert kept(d) == [0, 5, 10]
    assert d.count() == len(CUT)


def test_motion_threshold_is_inclusive_and_last_of_equals_wins(spark):
    # 51/255 is exactly 0.2 in double arithmetic as the rule computes it.
    f = frames(spark, [(1, 0), (1, 51), (7, 51), (7, 51), (1, 0)])
    assert kept(motion_gated(f, 51 * 16 / (16 * 255.0), 3)) == [0, 3, 4]


def test_window_of_zero_is_one(spark):
    f = frames(spark, [(1, 0), (1, 255), (9, 255)])
    assert kept(motion_gated(f, 0.5, 0)) == [0, 1]


def test_fully_masked_frames_are_static(spark):
    schema = METRIC + ", valid binary"
    rows = [(0, i, 1.0, bytes([i * 100] * 4), bytes(4) if i else None) for i in range(3)]
    assert kept(motion_gated(spark.createDataFrame(rows, schema), 0.01, 1)) == [0]


def sequential(rows, threshold, window, floor=None):
    out = []
    by_clip = {}
    for c, i, s, g in rows:
        by_clip.setdefault(c, []).append((i, s, g))
    for c, items in by_clip.items():
        rule = MotionRule(threshold, window)
        for i, s, g in sorted(items):
            if floor is not None and s < floor:
                out.append((c, i, False))
                continue
            out += [(c, *d) for d in rule.push(Frame(i, s, np.frombuffer(g, np.uint8)))]
        out += [(c, *d) for d in rule.finish()]
    return sorted(out)


@pytest.mark.parametrize("segment,warmup,window,floor", [
    (5, 3, 3, None), (8, 0, 4, 2.0), (6, 6, 9, None), (16, 8, 2, 1.0), (4096, 64, 5, 2.0)])
def test_segments_give_the_sequential_result(spark, segment, warmup, window, floor):
    rng = random.Random(segment * 100 + window)
    rows = []
    for clip, n in ((0, 1), (1, 37), (2, 150)):
        level = 100
        for i in range(n):
            # Mostly slow drift, with cuts, so windows open all over the place.
            level = (level + rng.choice([0, 0, 1, 3, 60 if rng.random() < 0.1 else 2])) % 256
            gray = bytes((level + rng.randrange(4)) % 256 for _ in range(16))
            rows.append((clip, i, float(rng.randrange(6)), gray))
    df = spark.createDataFrame(rows, METRIC).repartition(3)
    got = motion_gated(df, 0.02, window, floor, segment, warmup)
    assert sorted(tuple(r) for r in got.select("clip_id", "frame_index", "keep").collect()) == \
        sequential(rows, 0.02, window, floor)


def test_segments_that_never_agree_still_end_right(spark):
    # Two far levels in turn: which frames are kept depends on the very first one.
    rows = [(0, i, 1.0, bytes([(i % 3) * 120] * 4)) for i in range(60)]
    got = motion_gated(spark.createDataFrame(rows, METRIC), 0.3, 2, None, 4, 0)
    assert sorted(tuple(r) for r in got.select("clip_id", "frame_index", "keep").collect()) == \
        sequential(rows, 0.3, 2)


@pytest.mark.parametrize("kind", ["still", "moving"])
def test_a_long_clip_takes_few_rounds(spark, monkeypatch, kind):
    """Still footage carries one state through many segments; in moving footage
    windows follow each other and their phase never fades."""
    from framesift.operators import motion as engine
    rounds, inner = [], engine._in_order
    monkeypatch.setattr(engine, "_in_order", lambda *a: (rounds.append(1), inner(*a))[1])
    rng = np.random.default_rng(0)
    n = 2400
    if kind == "moving":
        gray = rng.integers(0, 256, (n, 16), dtype=np.uint8)
    else:
        gray = (100 + 90 * (np.arange(n) >= 1500)[:, None] + rng.integers(0, 3, (n, 16))).astype(np.uint8)
    rows = [(0, i, float(rng.integers(0, 9)), gray[i].tobytes()) for i in range(n)]
    df = spark.createDataFrame(rows, METRIC).repartition(3)
    got = motion_gated(df, 0.05, 8, None, 64, 16)
    assert sorted(tuple(r) for r in got.select("clip_id", "frame_index", "keep").collect()) == \
        sequential(rows, 0.05, 8)
    assert len(rounds) <= (1 if kind == "moving" else 9)


def test_every_nth_rule_matches_the_batch_form():
    rule = Counted(3)
    assert [rule.push(Frame(i, 0.0, np.zeros(1, np.uint8)))[0][1] for i in range(7)] == \
        [True, False, False, True, False, False, True]


def test_window_sharpest_takes_nan_then_the_latest(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0), (0, 1, 3.0), (0, 2, 3.0), (1, 0, float("nan")), (1, 1, 9.0)],
        "clip_id long, frame_index long, sharpness double")
    best = {r.clip_id: r.frame_index for r in selection.window_sharpest(df, "clip_id").collect()}
    assert best == {0: 2, 1: 0}


# --- replay ---

def stemmed(spark, n):
    return spark.range(n).select(
        F.lit(0).cast("long").alias("clip_id"), F.lit("clip").alias("stem"), F.col("id").alias("frame_index"))


def recorded(spark, indexes, stem="clip"):
    return spark.createDataFrame([(stem, i) for i in indexes], "stem string, frame_index long")


def test_replay_keeps_exactly_the_recorded_frames(spark):
    d = replay.replay_selection(stemmed(spark, 10), recorded(spark, [0, 4, 5, 9]))
    assert kept(d) == [0, 4, 5, 9] and d.count() == 10


def test_replay_names_missing_frames(spark):
    row = replay.replay_missing(stemmed(spark, 10), recorded(spark, [0, 4, 40])).collect()
    assert len(row) == 1 and "1 of 3" in row[0].message


def test_replaying_a_selection_gives_it_back(spark):
    f = frames(spark, CUT).withColumn("stem", F.lit("clip"))
    d = motion_gated(f, 0.05, 3)
    again = replay.replay_selection(f, d.filter("keep").select(F.lit("clip").alias("stem"), "frame_index"))
    assert kept(again) == kept(d)


def test_replay_preflight_takes_the_last_of_equal_stems(spark):
    m = spark.createDataFrame([("a", 0, [1]), ("a", 1, [2, 3]), ("b", 2, [])],
                              "stem string, position int, kept_frames array<long>")
    clips = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "clip_id long, stem string")
    got = {r.stem: (r.recorded, r.problem is None) for r in replay.replay_preflight(clips, m).collect()}
    assert got == {"a": (2, True), "b": (0, False), "c": (0, False)}


# --- audits ---

def test_gap_is_reported_where_it_starts(spark):
    f = spark.createDataFrame([(0, i) for i in range(10) if i != 4], "clip_id long, frame_index long")
    for segment in (4, 4096):
        assert [tuple(r) for r in audits.frame_order_gaps(f, segment).collect()] == [(0, 4, 1)]
    with pytest.raises(ValueError, match="missing from number 4"):
        audits.require_no_gaps(f)
    assert audits.frame_order_gaps(f.filter("frame_index < 4")).count() == 0


def test_first_frame_missing_is_a_gap_at_zero(spark):
    f = spark.createDataFrame([(0, 2), (0, 3)], "clip_id long, frame_index long")
    assert [tuple(r) for r in audits.frame_order_gaps(f).collect()] == [(0, 0, 2)]


def test_coverage_gap_vectors(spark):
    hover = list(range(0, 300, 3)) + list(range(323, 600, 3))
    hole = list(range(0, 200, 10)) + list(range(500, 700, 10))
    rows = [(0, i) for i in hover] + [(1, i) for i in hole] + [(2, 5)]
    k = spark.createDataFrame(rows, "clip_id long, frame_index long")
    clips = spark.createDataFrame([(c, 10.0) for c in range(4)], "clip_id long, fps double")
    got = {r.clip_id: r.gap_s for r in audits.coverage_gap(k, clips).collect()}
    assert got == {0: None, 1: 31.0, 2: None, 3: None}


def test_zero_kept_is_an_error_for_the_run_only(spark):
    d = frames(spark, [(1, 0)]).select("clip_id", "frame_index", F.lit(False).alias("keep"))
    with pytest.raises(ValueError, match="no frame was kept"):
        selection.zero_kept_guard(d)
    selection.zero_kept_guard(d.unionByName(d.withColumn("keep", F.lit(True))))


def test_kept_chunks_are_bounded_and_sorted(spark):
    d = spark.range(100).select(
        F.lit(1).alias("clip_id"), F.col("id").alias("frame_index"), (F.col("id") % 3 == 0).alias("keep"))
    rows = selection.kept_chunks(d.repartition(5), 30).orderBy("chunk").collect()
    assert [r.chunk for r in rows] == [0, 1, 2, 3]
    assert sum((r.kept_frames for r in rows), []) == list(range(0, 100, 3))


def test_progress_has_no_eta_before_anything_is_known(spark):
    p = spark.createDataFrame(
        [(0, 100, 10, 10, 2.0), (1, None, 10, 10, 2.0), (2, 100, 0, 0, 2.0), (3, 0, 5, 5, 1.0), (4, 5, 9, 9, 3.0)],
        "clip_id long, clip_total_frames long, clip_decoded long, decoded_this_run long, elapsed_s double")
    got = {r.clip_id: r.eta_s for r in records.progress_rates(p).collect()}
    assert got == {0: 18.0, 1: None, 2: None, 3: None, 4: 0.0}


# --- stems ---

def greedy(stems):
    taken, out = set(), []
    for s in stems:
        name, n = s, 1
        if s in taken:
            while f"{s}_{n}" in taken:
                n += 1
            name = f"{s}_{n}"
        taken.add(name)
        out.append(name)
    return out


def named(spark, stems):
    df = spark.createDataFrame(list(enumerate(stems)), "position long, stem string")
    return [r.name for r in unique_stems(df).orderBy("position").collect()]


def test_stem_vector(spark):
    assert named(spark, ["clip", "clip", "clip_1", "clip", "other"]) == \
        ["clip", "clip_1", "clip_1_1", "clip_2", "other"]


@pytest.mark.parametrize("seed", range(3))
def test_stems_match_the_list_walk(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "a_1", "a_2", "a_3", "a_1_1", "a_1_2", "a_01", "a_0", "b", "b_1", "b_2_1", "_1", "a_2_1_1"]
    stems = [rng.choice(pool) for _ in range(60)]
    got = named(spark, stems)
    assert got == greedy(stems)
    assert len(set(got)) == len(got)
