"""Ordered selection rules on clips of any length.

A rule is a state machine over the frames of a clip, but its state is small: for
the motion gate the last kept frame, or the open window.  So a clip is cut into
segments that run in parallel, each from every state it is likely to start in:

* the state a few frames of lead-in end in, and
* every window that may be open at its start, one per frame it could begin with.

Runs of one segment that reach the same state go on as one, so this costs little
more than a single run.  Afterwards the true states are followed from segment to
segment.  Where one was not tried yet (a long still stretch, say), that segment
runs once more from it, and so do all other places where a segment ended in a
state its successor has not tried, in parallel.  A state that passed through k
segments unchanged is tried on the next 2k at once, so still stretches of any
length take few rounds.  Every round settles at least one more segment of every
clip, so this always ends, with exactly the sequential result.

Only thumbnails and states travel; rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from framesift import params as P
from framesift.functions.arrays import byte_rows
from framesift.operators.ordering import with_halo
from framesift.operators.selection import passes_floor
from framesift.operators.selectors import Frame, MotionRule, ResumableSelector
from framesift.session import materialise

# Order of a segment's rows: what its predecessor held, its lead-in, its own frames.
ANCHOR, PENDING, LEAD_IN, OWN = 0, 1, 2, 3
HELD = {ANCHOR: "anchor", PENDING: "pending"}
ALWAYS = 1 << 62

MakeRule = Callable[[], ResumableSelector]


def _schema(clip_type: T.DataType) -> T.StructType:
    longs = ["segment", "lane", "branch"]
    return T.StructType(
        [T.StructField("clip_id", clip_type)] + [T.StructField(n, T.LongType()) for n in longs]
        + [T.StructField("kind", T.StringType()),
           T.StructField("frame_index", T.LongType()),
           T.StructField("keep", T.BooleanType()),
           T.StructField("at", T.LongType()),
           T.StructField("anchor", T.LongType()),
           T.StructField("open", T.LongType()),
           T.StructField("into", T.LongType()),
           T.StructField("sharpness", T.DoubleType()),
           T.StructField("gray", T.BinaryType()),
           T.StructField("valid", T.BinaryType())])


class _Out:
    """Output rows of one Arrow batch."""

    def __init__(self, clip_type: pa.DataType):
        i, s = pa.int64(), pa.string()
        self.types = {"clip_id": clip_type, "segment": i, "lane": i, "branch": i, "kind": s,
                      "frame_index": i, "keep": pa.bool_(), "at": i, "anchor": i, "open": i, "into": i,
                      "sharpness": pa.float64(), "gray": pa.binary(), "valid": pa.binary()}
        self.columns: dict[str, list] = {n: [] for n in self.types}

    def add(self, key: tuple, branch: int, kind: str, **values) -> None:
        row = dict(zip(("clip_id", "segment", "lane"), key), branch=branch, kind=kind, **values)
        for name, column in self.columns.items():
            column.append(row.get(name))

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(self.columns[n], t) for n, t in self.types.items()]
        self.columns = {n: [] for n in self.types}
        return pa.RecordBatch.from_arrays(arrays, names=list(self.types))


class _Segment:
    """All runs of one segment; `branches` are those still apart."""

    def __init__(self, key: tuple, make_rule: MakeRule):
        self.key, self.make_rule = key, make_rule
        self.branches: dict[int, ResumableSelector] = {0: make_rule()}
        self.started = False

    def take(self, role: int, frame: Frame, out: _Out) -> None:
        if role in HELD:
            self.branches[0].restore(HELD[role], frame)
            return
        if role == OWN and not self.started:
            self._start(out)
        for b, rule in self.branches.items():
            for index, keep in rule.push(frame):
                if self.started:
                    out.add(self.key, b, "decision", frame_index=index, keep=keep, at=frame.index)
        if role == LEAD_IN:
            # Of the lead-in's extra runs only windows still open can matter.
            self.branches = {b: r for b, r in self.branches.items() if b == 0 or r.is_open()}
            begun = self.make_rule().begun_at(frame)
            if begun is not None:
                self.branches[max(self.branches) + 1] = begun
        elif len(self.branches) > 1:
            self._merge(frame.index, out)

    def _start(self, out: _Out) -> None:
        apart: dict[tuple, int] = {}
        for b, rule in list(self.branches.items()):
            if rule.key() in apart:
                del self.branches[b]
                continue
            apart[rule.key()] = b
            out.add(self.key, b, "in", anchor=rule.key()[0], open=rule.key()[1])
        self.started = True

    def _merge(self, at: int, out: _Out) -> None:
        apart: dict[tuple, int] = {}
        for b, rule in list(self.branches.items()):
            first = apart.setdefault(rule.key(), b)
            if first != b:
                out.add(self.key, b, "merge", into=first, at=at)
                del self.branches[b]

    def close(self, out: _Out) -> None:
        if not self.started:
            return
        for b, rule in self.branches.items():
            out.add(self.key, b, "out", anchor=rule.key()[0], open=rule.key()[1])
            for kind, f in rule.held():
                out.add(self.key, b, kind, frame_index=f.index, sharpness=f.sharpness,
                        gray=f.gray.tobytes(), valid=None if f.valid is None else f.valid.tobytes())
            # Counts only if the clip turns out to end here.
            for index, keep in rule.finish():
                out.add(self.key, b, "finish", frame_index=index, keep=keep)

    def own_buffers(self) -> None:
        """What outlives a batch must not point into it."""
        for rule in self.branches.values():
            for _, f in rule.held():
                f.gray = np.array(f.gray)
                if f.valid is not None:
                    f.valid = np.array(f.valid)


def _run_segments(make_rule: MakeRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Segment | None = None
        out: _Out | None = None
        for batch in batches:
            out = out or _Out(batch.column("clip_id").type)
            grays, valids = byte_rows(batch.column("gray")), byte_rows(batch.column("valid"))
            masked = np.asarray(batch.column("valid").is_valid())
            keys = zip(*(batch.column(n).to_pylist() for n in ("clip_id", "segment", "lane")))
            rows = zip(keys, *(batch.column(n).to_pylist() for n in ("role", "frame_index", "sharpness")))
            for i, (key, role, index, sharpness) in enumerate(rows):
                if current is None or current.key != key:
                    if current is not None:
                        current.close(out)
                    current = _Segment(key, make_rule)
                current.take(role, Frame(
                    index, float("nan") if sharpness is None else sharpness, grays[i],
                    valids[i] if masked[i] else None), out)
            if current is not None:
                current.own_buffers()
            yield out.batch()
        if current is not None:
            current.close(out)
            yield out.batch()
    return run


def _in_order(rows: DataFrame, make_rule: MakeRule, number: int) -> DataFrame:
    done = (
        rows.repartition("clip_id", "segment", "lane")
        .sortWithinPartitions("clip_id", "segment", "lane", "role", "frame_index")
        .mapInArrow(_run_segments(make_rule), _schema(rows.schema["clip_id"].dataType))
    )
    return materialise(done.withColumn("round", F.lit(number)), "rule")


# --- following states from segment to segment ------------------------------------------

_WALK = ["clip_id", "segment", "round", "lane", "branch", "kind", "at", "anchor", "open", "into"]


def _walk_schema(clip_type: T.DataType) -> T.StructType:
    names = ["segment", "round", "lane", "branch", "after", "upto", "from_segment", "ask"]
    return T.StructType([T.StructField("clip_id", clip_type), T.StructField("kind", T.StringType())]
                        + [T.StructField(n, T.LongType()) for n in names])


def _walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The true path through a clip's segments as far as it is known (`path`), and
    which states to try where (`ask`).

    Its input is a few rows per segment, no frames.
    """
    tried: dict[int, dict[tuple, tuple]] = {}
    ends: dict[tuple, tuple] = {}
    merges: dict[tuple, tuple] = {}

    def whole(v):
        return None if pd.isna(v) else int(v)

    for r in rows.itertuples(index=False):
        where = (int(r.segment), int(r.round), int(r.lane), int(r.branch))
        state = (whole(r.anchor), whole(r.open))
        if r.kind == "in":
            tried.setdefault(where[0], {}).setdefault(state, where)
        elif r.kind == "out":
            ends[where] = state
        else:
            merges[where] = (*where[:3], int(r.into)), int(r.at)

    def follow(where: tuple):
        """Stretches (branch, after, upto) of a run, and the branch it ends on."""
        parts, after = [], -1
        while where in merges:
            into, at = merges[where]
            parts.append((where, after, at))
            where, after = into, at
        return parts + [(where, after, ALWAYS)], where

    out = []
    segments = sorted(tried)
    coming: dict[tuple, tuple] = {(None, None): (0, None)}
    true: tuple | None = (None, None)
    path = []
    for i, segment in enumerate(segments):
        going: dict[tuple, tuple] = {}
        following = None
        for state, (still, source) in coming.items():
            start = tried[segment].get(state)
            if start is None:
                reach = max(1, 2 * still) if state[1] is None else 1
                for target in segments[i:i + reach]:
                    if state not in tried[target]:
                        out.append(("ask", target, *source[1:], None, None, source[0], len(out)))
                continue
            parts, last = follow(start)
            end = ends[last]
            going.setdefault(end, (still + 1 if end == state else 0, last))
            if state == true:
                path.append(parts)
                following = end
        true = following
        # Where other runs of this segment led, unless they just passed through.
        for state, start in tried[segment].items():
            if state not in coming:
                last = follow(start)[1]
                if ends[last] != state:
                    going.setdefault(ends[last], (0, last))
        coming = going
    if true is not None:
        out = []
    for i, parts in enumerate(path):
        for (segment, number, lane, branch), after, upto in parts:
            final = upto == ALWAYS and len(path) == len(segments) and i == len(path) - 1
            out.append(("last" if final else "path", segment, number, lane, branch, after, upto, None, None))
    names = ["kind", "segment", "round", "lane", "branch", "after", "upto", "from_segment", "ask"]
    made = pd.DataFrame(out, columns=names)
    made.insert(0, "clip_id", key[0])
    return made.astype({n: "Int64" for n in names[1:]})


def motion_gated(frames: DataFrame, threshold: float = P.MOTION_THRESHOLD,
                 window: int = P.MOTION_WINDOW, floor: float | None = None,
                 segment: int = P.SEGMENT_FRAMES, warmup: int = P.WARMUP_FRAMES, stored: bool = False) -> DataFrame:
    """Motion-gated decisions: the sharpest frame of each window that opens when a
    frame differs enough from the last kept one."""
    return run_rule(frames, lambda: MotionRule(threshold, window), floor, segment, warmup, stored)


def run_rule(frames: DataFrame, make_rule: MakeRule, floor: float | None = None,
             segment: int = P.SEGMENT_FRAMES, warmup: int = P.WARMUP_FRAMES, stored: bool = False) -> DataFrame:
    """Decisions (clip_id, frame_index, keep) of any resumable rule for frames
    with columns (clip_id, frame_index, sharpness, gray[, valid]).

    Segments that run again read their frames again, so the input is stored first
    unless it is `stored` already.  Jobs run while the result is being built: one
    round per guess that was wrong somewhere, at most one per segment of a clip.
    """
    if "valid" not in frames.columns:
        frames = frames.withColumn("valid", F.lit(None).cast("binary"))
    frames = frames.select("clip_id", F.col("frame_index").cast("long").alias("frame_index"),
                           F.col("sharpness").cast("double").alias("sharpness"), "gray", "valid")
    if not stored:
        frames = materialise(frames, "rule-input")
    seen = frames.filter(passes_floor(floor))
    own = (seen.withColumn("segment", F.expr(f"frame_index div {int(segment)}"))
           .withColumn("role", F.lit(OWN)))
    rows = with_halo(seen, "frame_index", segment, min(warmup, segment))
    rows = (rows.withColumn("role", F.when(F.col("is_halo"), LEAD_IN).otherwise(OWN))
            .drop("is_halo").withColumn("lane", F.lit(0).cast("long")))
    done = _in_order(rows, make_rule, 0)
    number = 0
    while True:
        steps = done.filter("kind in ('in', 'out', 'merge')").select(*_WALK)
        walked = materialise(steps.groupBy("clip_id").applyInPandas(
            _walk, _walk_schema(frames.schema["clip_id"].dataType)), "rule-walk")
        asks = walked.filter("kind = 'ask'")
        if not asks.limit(1).count():
            break
        number += 1
        # Only the stretch that is asked for is read: these bounds reach the scan.
        span = asks.agg(F.min("clip_id").alias("low"), F.max("clip_id").alias("high"),
                        F.min("segment").alias("first"), F.max("segment").alias("last")).first()
        near = own.filter(F.col("clip_id").between(span.low, span.high) & F.col("frame_index").between(
            span.first * segment, (span.last + 1) * segment - 1))
        again = near.join(asks.select("clip_id", "segment", F.col("ask").alias("lane")),
                         ["clip_id", "segment"])
        source = asks.select(
            "clip_id", F.col("from_segment").alias("segment"), "round", "lane", "branch",
            F.col("segment").alias("_to"), F.col("ask").alias("_ask"))
        held = (done.filter("kind in ('anchor', 'pending')")
                .join(source, ["clip_id", "segment", "round", "lane", "branch"])
                .withColumn("role", F.when(F.col("kind") == "anchor", ANCHOR).otherwise(PENDING))
                .drop("segment", "lane").withColumnRenamed("_to", "segment")
                .withColumnRenamed("_ask", "lane"))
        more = _in_order(again.unionByName(held.select(again.columns)), make_rule, number)
        done = done.unionByName(more)
        if number % 8 == 0:
            done = materialise(done, "rule")

    chosen = walked.select("clip_id", "segment", "round", "lane", "branch", "kind", "after", "upto")
    run = ["clip_id", "segment", "round", "lane", "branch"]
    decided = (done.filter("kind = 'decision'").select(*run, "frame_index", "keep", "at")
               .join(chosen.select(*run, "after", "upto"), run)
               .filter("at > after and at <= upto").select("clip_id", "frame_index", "keep"))
    flushed = (done.filter("kind = 'finish'").select(*run, "frame_index", "keep")
               .join(chosen.filter("kind = 'last'").select(*run), run, "left_semi")
               .select("clip_id", "frame_index", "keep"))
    out = decided.unionByName(flushed)
    if floor is not None:
        out = out.unionByName(frames.filter(~passes_floor(floor)).select(
            "clip_id", "frame_index", F.lit(False).alias("keep")))
    return out
