"""Ordered rules on a stream, with one clip spread over many tasks.

A clip is cut into segments of consecutive frame numbers, and two stateful operators follow each other:

* `SegmentRuns`, keyed by (clip, segment), puts the frames of a segment in order as they arrive and runs the rule over
  them from every state it is likely to start in, as the batch form does.  All pixel work is done here.  It
  hands on what the runs have decided, where they met, and the few frames their last state consists of.
* `Compose`, keyed by clip, knows the true state of the clip and follows it from run to run.  It sees some numbers per
  segment and no frames but those of states.  What lies on the true path is decided.

Where the true state was not tried in the next segment (a long still stretch, say), `Compose` asks for another run from
it; where a segment is done with, it is let go.  Both are rows of kind `message` in the output, which come back as a
second source: the output is written with one folder per kind (`SegmentedRun` does), so the folder of messages is
read as a stream.  A message that comes twice changes nothing.

A clip ends with its end marker, or, if `silent` is given, when nothing of it has come for so many seconds (a
processing-time timer): with an `end` row, or with a `gap` row that names the first frame that is missing.  An ended clip
leaves nothing but a tombstone, which is dropped after `remember` seconds (state with a time to live); a frame that comes
after the end is a `late` row and leaves no state.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from framesift import params as P
from framesift.operators.motion import HELD, LEAD_IN, OWN, _Segment
from framesift.operators.selectors import Frame, MotionRule, ResumableSelector
from framesift.session import exists, file_system
from framesift.streaming.io import state_partitions

#: Frames of a segment: what one task holds of a clip at a time.
SEGMENT = 512
MESSAGES = "clip_id long, segment long, body binary"
RESULT = "clip_id long, kind string, frame_index long, keep boolean, emitted long, segment long, body binary"
_ROLE_OF = {name: role for role, name in HELD.items()}
_NOTES = "clip_id long, segment long, body binary"
_RESULT = [f.split()[0] for f in RESULT.split(", ")]

MakeRule = Callable[[], ResumableSelector]


class Passing:
    """Every frame is kept when its turn comes; there is nothing to hold."""

    def push(self, frame: Frame) -> list[tuple[int, bool]]:
        return [(frame.index, True)]

    def finish(self) -> list[tuple[int, bool]]:
        return []

    def key(self) -> tuple[int | None, int | None]:
        return None, None

    def held(self) -> list[tuple[str, Frame]]:
        return []

    def restore(self, kind: str, frame: Frame) -> None:
        raise ValueError("a rule without state holds no frames")

    def is_open(self) -> bool:
        return False

    def begun_at(self, frame: Frame) -> None:
        return None


class _Collected:
    """What the runs of a segment have made since it was last handed on."""

    def __init__(self):
        self.starts: dict[tuple, int] = {}
        self.merges: dict[int, tuple[int, int]] = {}
        self.decisions: dict[int, list[tuple[int, bool, int]]] = {}

    def add(self, key: tuple, branch: int, kind: str, **row) -> None:
        if kind == "decision":
            self.decisions.setdefault(branch, []).append((row["frame_index"], row["keep"], row["at"]))
        elif kind == "in":
            self.starts[row["anchor"], row["open"]] = branch
        else:
            self.merges[branch] = row["into"], row["at"]


class _Lane:
    """The runs of one segment from the states that are likely, or from one that was asked for."""

    def __init__(self, key: tuple, make_rule: MakeRule):
        self.runs = _Segment(key, make_rule)
        self.made = _Collected()

    def take(self, role: int, frame: Frame) -> None:
        self.runs.take(role, frame, self.made)

    def start(self) -> None:
        if not self.runs.started:
            self.runs._start(self.made)

    def __getstate__(self):
        """Rules are stored, how one is made is not."""
        return {"runs": {k: v for k, v in vars(self.runs).items() if k != "make_rule"}, "made": self.made}

    def __setstate__(self, state):
        self.runs, self.made = _Segment.__new__(_Segment), state["made"]
        vars(self.runs).update(state["runs"])

    def hand_on(self) -> dict:
        made, self.made = self.made, _Collected()
        ends = {}
        for b, rule in self.runs.branches.items():
            held = [(kind, f.index, f.sharpness, f.gray.tobytes(), None if f.valid is None else f.valid.tobytes())
                    for kind, f in rule.held()]
            ends[b] = rule.key(), held, copy.copy(rule).finish()
        return {"starts": made.starts, "merges": made.merges, "decisions": made.decisions, "ends": ends}


def _frame(row: tuple) -> Frame:
    index, sharpness, gray, valid = row
    return Frame(index, float("nan") if sharpness is None else float(sharpness),
                 np.frombuffer(gray or b"", np.uint8).copy(), None if valid is None else np.frombuffer(valid, np.uint8).copy())


class SegmentRuns(StatefulProcessor):
    """Order and runs within one segment.  Its frames stay until the segment is let go, for runs that are asked for."""

    def __init__(self, make_rule: MakeRule, floor: float | None, size: int, warmup: int):
        self.make_rule, self.floor, self.size, self.warmup = make_rule, floor, size, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("runs", "value binary")
        self.frames = handle.getListState("frames", "value binary")

    def _fresh(self, segment: int) -> dict:
        first = max(0, segment * self.size - self.warmup)
        return {"have": np.zeros((segment + 1) * self.size - first, bool), "next": 0, "own": False, "lanes": {}}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clip, segment = key
        if segment < 0:
            for _ in rows:
                pass
            yield self._note(clip, segment, {"marker": True})
            return
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self._fresh(segment)
        for lane in state["lanes"].values():
            lane.runs.make_rule = self.make_rule
        first = (segment + 1) * self.size - len(state["have"])
        new: dict[int, tuple] = {}
        asked, let_go = [], False
        for pdf in rows:
            for body in pdf["body"][pdf["body"].notna()]:
                message = pickle.loads(body)
                let_go |= "release" in message
                if "lane" in message and message["lane"] not in state["lanes"]:
                    asked.append(message)
            for row in pdf[pdf["body"].isna()][["frame_index", "sharpness", "gray", "valid"]].itertuples(index=False, name=None):
                index = int(row[0])
                # A copy of a frame that is here already changes nothing.
                if not state["have"][index - first]:
                    state["have"][index - first] = True
                    new[index] = (index, *(None if x is None or x is pd.NA else x for x in row[1:]))
        fresh = sorted(i for i in new if i >= segment * self.size)
        state["own"] |= bool(fresh)
        if new:
            self.frames.appendValue((pickle.dumps(list(new.values())),))
        stored: dict[int, tuple] | None = None

        def at(index: int) -> tuple:
            nonlocal stored
            if index in new:
                return new[index]
            if stored is None:
                stored = {r[0]: r for blob in self.frames.get() for r in pickle.loads(blob[0])}
            return stored[index]

        lanes, low = state["lanes"], None
        if state["own"] and 0 not in lanes:
            lanes[0] = _Lane((clip, segment, 0), self.make_rule)
        for message in asked:
            lane = lanes[message["lane"]] = _Lane((clip, segment, message["lane"]), self.make_rule)
            for kind, *held in message["held"]:
                lane.take(_ROLE_OF[kind], _frame(tuple(held)))
            lane.start()
            for index in range(segment * self.size, first + state["next"]):
                self._push(lane, at(index), segment, None)
        if 0 in lanes:
            low = []
            while state["next"] < len(state["have"]) and state["have"][state["next"]]:
                row = at(first + state["next"])
                for number, lane in lanes.items():
                    if number == 0 or row[0] >= segment * self.size:
                        self._push(lane, row, segment, low if number == 0 else None)
                state["next"] += 1
        if state["own"] or asked:
            begun = first + state["next"] >= segment * self.size
            if begun and 0 in lanes:
                lanes[0].start()
            done = max(0, first + state["next"] - segment * self.size)
            beyond = int(state["have"][max(state["next"], segment * self.size - first):].sum())
            yield self._note(clip, segment, {"new": fresh, "done": done, "beyond": beyond, "low": low or [], "first": first + state["next"],
                                             "lanes": {n: lane.hand_on() for n, lane in lanes.items() if lane.runs.started}})
        if let_go:
            self.state.clear()
            self.frames.clear()
        else:
            self.state.update((pickle.dumps(state),))

    def _push(self, lane: _Lane, row: tuple, segment: int, low: list[int] | None) -> None:
        """The next frame of a lane; one below the floor never reaches the rule and is a decision by itself."""
        own = row[0] >= segment * self.size
        if self.floor is not None and row[1] is not None and float(row[1]) < self.floor:
            if own and low is not None:
                low.append(row[0])
            if own:
                lane.start()
            return
        lane.take(OWN if own else LEAD_IN, _frame(row))

    @staticmethod
    def _note(clip, segment: int, body: dict) -> pd.DataFrame:
        return pd.DataFrame({"clip_id": [clip], "segment": [segment], "body": [pickle.dumps(body)]})

    def close(self) -> None:
        pass


class Compose(StatefulProcessor):
    """The true path of a clip through the runs of its segments."""

    def __init__(self, size: int, silent: float | None, remember: float | None):
        self.size, self.silent, self.remember = size, silent, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("path", "value binary")
        self.ended = (handle.getValueState("ended", "frames long") if self.remember is None
                      else handle.getValueState("ended", "frames long", int(self.remember * 1000)))

    @staticmethod
    def _fresh() -> dict:
        #: Segment, true state at its start with its frames, run that began there and how far it was followed.
        return {"cur": 0, "key": (None, None), "held": [], "branch": None, "at": -1, "seen": {}, "asked": {}, "lanes": {},
                "marker": False, "emitted": 0, "timer": None}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clip = key[0]
        notes = [(int(s), pickle.loads(b)) for pdf in rows for s, b in zip(pdf["segment"], pdf["body"])]
        if self.ended.exists():
            out = [("late", i, None, None, None, None) for _, n in notes for i in n.get("new", ())]
            out += self._let_go({t for s, _ in notes if s >= 0 for t in (s, s + 1)})
            if out:
                yield self._made(clip, out)
            return
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else self._fresh()
        for segment, note in notes:
            if segment < 0:
                state["marker"] = True
            elif segment >= state["cur"]:
                self._add(state, segment, note)
        # What comes for a segment that is done with are copies, and so is the lead-in they are for the next one.
        out = self._let_go({t for s, _ in notes if s >= 0 for t in (s, s + 1) if t < state["cur"]})
        yield from self._go_on(clip, state, out, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing of the clip has come for so long that it counts as ended."""
        if self.state.exists():
            state = pickle.loads(self.state.get()[0])
            state["marker"], state["timer"] = True, None
            yield from self._go_on(key[0], state, [], timerValues)

    @staticmethod
    def _add(state: dict, segment: int, note: dict) -> None:
        own = state["seen"].setdefault(segment, {"lanes": {}, "low": []})
        own["done"], own["beyond"], own["first"] = note["done"], note["beyond"], note["first"]
        own["low"] += note["low"]
        for number, made in note["lanes"].items():
            lane = own["lanes"].setdefault(number, {"starts": {}, "merges": {}, "decisions": {}, "ends": {}})
            for part in ("starts", "merges"):
                lane[part].update(made[part])
            for b, decisions in made["decisions"].items():
                lane["decisions"].setdefault(b, []).extend(decisions)
            lane["ends"] = made["ends"]

    def _go_on(self, clip, state: dict, out: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        waits = self._follow(state, out)
        if state["marker"] and not waits:
            self._finish(state, out)
            self._timer(state, None)
            self.state.clear()
            self.ended.update((state["emitted"],))
        else:
            if self.silent is not None:
                self._timer(state, timerValues.getCurrentProcessingTimeInMs() + int(self.silent * 1000))
            self.state.update((pickle.dumps(state),))
        if out:
            yield self._made(clip, out)

    def _timer(self, state: dict, at: int | None) -> None:
        if state["timer"] is not None:
            self.handle.deleteTimer(state["timer"])
        if at is not None:
            self.handle.registerTimer(at)
        state["timer"] = at

    def _follow(self, state: dict, out: list[tuple]) -> bool:
        """Decide what is on the true path; whether a run is waited for that was asked for."""
        while state["cur"] in state["seen"]:
            segment = state["cur"]
            own = state["seen"][segment]
            if state["branch"] is None:
                found = next(((n, lane["starts"][state["key"]]) for n, lane in own["lanes"].items() if state["key"] in lane["starts"]), None)
                if found is None:
                    return self._ask(state, own, out)
                state["branch"], state["at"] = found, -1
            self._decide(state, own, out)
            if own["done"] < self.size:
                return False
            number, b = state["branch"]
            state["key"], state["held"], _ = own["lanes"][number]["ends"][b]
            state["branch"] = None
            del state["seen"][segment]
            state["asked"].pop(segment, None)
            state["lanes"].pop(segment, None)
            state["cur"] += 1
            out += self._let_go({segment})
        return False

    def _ask(self, state: dict, own: dict, out: list[tuple]) -> bool:
        """A run of the segment from the true state, once its own runs have begun (the state may be among theirs)."""
        segment = state["cur"]
        # Frames may be missing in front of the segment's own runs, but not in front of its first frame: the path
        # has come to there.  An own run that has not begun yet only lacks lead-in that is still on its way.
        if state["key"] not in state["asked"].setdefault(segment, set()):
            number = state["lanes"][segment] = state["lanes"].get(segment, 0) + 1
            state["asked"][segment].add(state["key"])
            body = pickle.dumps({"lane": number, "held": state["held"]})
            out.append(("message", 1, None, None, segment, body))
        return True

    def _decide(self, state: dict, own: dict, out: list[tuple]) -> None:
        number, b = state["branch"]
        lane = own["lanes"][number]
        decided = [(i, False) for i in own["low"]]
        own["low"] = []
        while True:
            upto = lane["merges"].get(b, (None, 1 << 62))
            decided += [(i, k) for i, k, at in lane["decisions"].get(b, ()) if state["at"] < at <= upto[1]]
            if upto[0] is None:
                break
            b, state["at"] = upto[0], max(state["at"], upto[1])
        latest = max((d[2] for d in lane["decisions"].get(b, ())), default=-1)
        # All runs have seen every frame up to here, decided or not.
        state["at"] = max(state["at"], latest)
        state["branch"] = number, b
        lane["decisions"].pop(b, None)
        self._emit(state, decided, out)

    @staticmethod
    def _emit(state: dict, decided: list[tuple[int, bool]], out: list[tuple]) -> None:
        for i, keep in sorted(decided):
            out.append(("decision", i, keep, state["emitted"], None, None))
            state["emitted"] += 1

    def _finish(self, state: dict, out: list[tuple]) -> None:
        own = state["seen"].get(state["cur"])
        if own is None:
            expected, whole = state["cur"] * self.size, not state["seen"]
        else:
            expected = state["cur"] * self.size + own["done"]
            whole = not own["beyond"] and len(state["seen"]) == 1
        if not whole:
            out.append(("gap", expected, None, None, None, None))
        else:
            if own is not None:
                number, b = state["branch"]
                self._emit(state, own["lanes"][number]["ends"][b][2], out)
            else:
                self._emit(state, self._flushed(state["held"]), out)
            out.append(("end", expected, None, None, None, None))
        # Frames are kept as lead-in of the segment behind theirs, too.
        out += self._let_go({t for s in {state["cur"], *state["seen"]} for t in (s, s + 1)})

    def _flushed(self, held: list[tuple]) -> list[tuple[int, bool]]:
        """The clip ends where a segment does: its last state is flushed from the frames it consists of."""
        rule = self.make_rule()
        for kind, *row in held:
            rule.restore(kind, _frame(tuple(row)))
        return rule.finish()

    make_rule: MakeRule = Passing

    @staticmethod
    def _let_go(segments: set[int]) -> list[tuple]:
        body = pickle.dumps({"release": True})
        return [("message", 0, None, None, s, body) for s in sorted(segments)]

    @staticmethod
    def _made(clip, out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["kind", "frame_index", "keep", "emitted", "segment", "body"])
        made.insert(0, "clip_id", clip)
        return made[_RESULT].astype({"frame_index": "Int64", "keep": "boolean", "emitted": "Int64", "segment": "Int64"})

    def close(self) -> None:
        pass


def segmented(frames: DataFrame, messages: DataFrame, make_rule: MakeRule, floor: float | None = None, segment: int = SEGMENT,
              warmup: int = P.WARMUP_FRAMES, silent: float | None = None, remember: float | None = None) -> DataFrame:
    """Rows of kind `decision`, `end`, `gap`, `late` and `message` for a stream of frames (clip_id, frame_index, sharpness, gray,
    valid, is_end) and the messages of this query's own output."""
    size, warmup = int(segment), min(int(warmup), int(segment))
    for name, kind in (("sharpness", "double"), ("gray", "binary"), ("valid", "binary")):
        if name not in frames.columns:
            frames = frames.withColumn(name, F.lit(None).cast(kind))
    own = F.expr(f"frame_index div {size}")
    # The last frames of a segment are the next one's lead-in; a marker goes past all segments.
    lead = F.col("frame_index") % size >= size - warmup
    segments = F.when(F.col("is_end"), F.array(F.lit(-1).cast("long"))).when(lead, F.array(own, own + 1)).otherwise(F.array(own))
    arrived = frames.select("clip_id", F.explode(segments).alias("segment"), "frame_index", F.col("sharpness").cast("double").alias("sharpness"),
                            "gray", "valid", F.lit(None).cast("binary").alias("body"))
    told = messages.select("clip_id", "segment", F.lit(None).cast("long").alias("frame_index"), F.lit(None).cast("double").alias("sharpness"),
                           F.lit(None).cast("binary").alias("gray"), F.lit(None).cast("binary").alias("valid"), "body")
    mode = "None" if silent is None and remember is None else "ProcessingTime"
    notes = arrived.unionByName(told).groupBy("clip_id", "segment").transformWithStateInPandas(
        SegmentRuns(make_rule, floor, size, warmup), T._parse_datatype_string(_NOTES), "Append", mode)
    compose = Compose(size, silent, remember)
    compose.make_rule = make_rule
    return notes.groupBy("clip_id").transformWithStateInPandas(compose, T._parse_datatype_string(RESULT), "Append", mode)


class SegmentedRun:
    """A segmented rule written to a folder, one subfolder for each kind of row."""

    def __init__(self, out: str, checkpoint: str):
        self.out, self.checkpoint = out, checkpoint

    def messages(self, spark: SparkSession) -> DataFrame:
        """What earlier batches of the same query have asked for."""
        folder = f"{self.out}/kind=message"
        file_system(spark, folder).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
        return spark.readStream.schema(MESSAGES).parquet(folder)

    def start(self, rows: DataFrame, **trigger) -> StreamingQuery:
        with state_partitions(rows.sparkSession):
            return (rows.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint)
                    .partitionBy("kind").outputMode("append").trigger(**trigger).start())

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of all batches that were finished."""
        return spark.read.schema(RESULT).parquet(self.out)

    def open_requests(self, spark: SparkSession) -> int:
        return spark.read.schema(RESULT).parquet(self.out).where("kind = 'message' AND frame_index = 1").count()

    def drain(self, build: Callable[[DataFrame], DataFrame], spark: SparkSession, tidy: bool = False) -> DataFrame:
        """Run until all input is decided.  `build` makes the rows from the messages.

        What is asked for in the last batch is done in further ones, without starting the query anew for each.  With `tidy`
        what the last batch let go is let go before this returns.  Not for rows with timers, whose queries never
        run out of batches.
        """
        before = self.open_requests(spark) if exists(spark, f"{self.out}/_spark_metadata") else 0
        rows = build(self.messages(spark))
        self.start(rows, availableNow=True).awaitTermination()
        now = self.open_requests(spark)
        if now != before or tidy:
            query = self.start(rows, processingTime="0 seconds")
            try:
                while True:
                    query.processAllAvailable()
                    before, now = now, self.open_requests(spark)
                    if now == before:
                        break
            finally:
                query.stop()
        return self.read(spark)


def stream_motion(frames: DataFrame, messages: DataFrame, threshold: float = P.MOTION_THRESHOLD, window: int = P.MOTION_WINDOW,
                  floor: float | None = None, **options) -> DataFrame:
    """Motion-gated decisions of a stream, segment by segment."""
    return segmented(frames, messages, lambda: MotionRule(threshold, window), floor, **options)


def stream_in_order(frames: DataFrame, messages: DataFrame, **options) -> DataFrame:
    """Frame numbers in order (`emitted` counts them), gaps and ends."""
    return segmented(frames, messages, Passing, warmup=0, **options)
