"""Per-clip operators on a stream of frames.

Frames of a clip may arrive in any order and over many micro-batches.  Each
processor holds back what came early, hands frames on strictly by number, and
ends the clip at its end marker (`is_end` true) with an `end` row, or with a `gap`
row if a frame is missing.  With `silent` a clip also ends when nothing of it has come for so many
seconds, by a processing-time timer.  What a clip costs in state is
the frames that are early, plus the rule's own few frames; `streaming.segments` runs rules that can be resumed on many
tasks a clip.

What stays of an ended clip is a tombstone and its counters, for `remember` seconds if that is given (state with a time to live):
a frame that comes after the end is a `late` row and leaves no other state.  The counters (frames decided, frames
kept) are what `io.progress` reads.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framesift import params as P
from framesift.functions import kernels
from framesift.operators.masks import odd_window
from framesift.operators.selectors import Counted, Frame, MotionRule
from framesift.sources.file_sets import STRETCH

DECISIONS = "clip_id long, kind string, frame_index long, keep boolean"
ORDERED = "clip_id long, kind string, frame_index long, emitted long"
SMOOTHED = "clip_id long, kind string, frame_index long, labels binary"
COUNTS = "decoded long, kept long"

#: Rows that a processor hands on together, and frames ahead of their turn that it holds outside the state store: so many
#: at least, and then as many as fit these bytes.
OUT_ROWS = 4096
AHEAD_ROWS = 1024
AHEAD_BYTES = 32 << 20
#: Frame numbers whose early frames are stored and fetched together.
BLOCK = 64


class InOrder(StatefulProcessor):
    """Restores frame order per clip.  Subclasses see ordered frames only."""

    payload: list[str] = []
    output: list[str] = []
    #: Seconds after which a clip counts as ended, and for which an ended one is remembered; None: for ever.
    silent: float | None = None
    remember: float | None = None
    #: Whether the end of a clip brings all its kept frames again, as `kept` rows.
    lists = False
    #: Frames that are taken together.
    together = 1
    ahead_rows, ahead_bytes = AHEAD_ROWS, AHEAD_BYTES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next_emit = handle.getValueState("next_emit", "value long")
        # Early frames lie in blocks of frame numbers, in as many parts as there were times to put some away.
        self.early = handle.getMapState("early", "block long, part long", "payload binary")
        self.rule = handle.getValueState("rule", "value binary")
        self.timer = handle.getValueState("timer", "at long")
        self.kept = handle.getMapState("kept", "stretch long", "bits binary")
        ttl = [] if self.remember is None else [int(self.remember * 1000)]
        self.ended = handle.getValueState("ended", "frames long", *ttl)
        self.counts = handle.getValueState("counts", COUNTS, *ttl)

    def fresh(self):
        """The rule's state for a new clip."""
        return None

    def take(self, rule, index: int, row: tuple):
        """Output rows for the next frame, and the rule's new state."""
        raise NotImplementedError

    def take_many(self, rule, index: int, rows: list[tuple]):
        """The same for frames that follow each other, at most `together`."""
        out: list[tuple] = []
        for row in rows:
            made, rule = self.take(rule, index, row)
            out.extend(made)
            index += 1
        return out, rule

    def finish(self, rule) -> list[tuple]:
        return []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clip = key[0]
        if self.ended.exists():
            late = sorted({int(i) for pdf in rows for i in pdf["frame_index"][~pdf["is_end"].astype(bool)]})
            for a in range(0, len(late), OUT_ROWS):
                yield self._made(clip, [("late", i, *[None] * (len(self.output) - 3)) for i in late[a:a + OUT_ROWS]])
            return
        self._begin()
        ended = False
        out: list[tuple] = []
        for pdf in rows:
            marks = pdf["is_end"].to_numpy(bool)
            ended |= bool(marks.any())
            numbers = pdf["frame_index"].to_numpy()[~marks].astype(np.int64)
            order = np.argsort(numbers, kind="stable")
            columns = (pdf[c].to_numpy(object)[~marks][order] for c in self.payload)
            for index, *values in zip(numbers[order].tolist(), *columns):
                # A number handed on or stored before is a copy of it; nothing is decided twice.
                if index >= self.expected and not self._is_stored(index):
                    self._hold(index, tuple(values))
                if len(self.ahead) >= self.together and index >= self.expected and self.expected in self.ahead:
                    out.extend(self._hand_on())
                    if len(out) >= OUT_ROWS:
                        yield self._made(clip, out)
                        out = []
                if len(self.ahead) > self.ahead_rows + self.together and self.held > self.ahead_bytes:
                    self._put_away()
        yield from self._close_batch(clip, out, ended, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing of the clip has come for so long that it counts as ended."""
        if not self.ended.exists():
            self._begin()
            self.timer.clear()
            yield from self._close_batch(key[0], [], True, timerValues)

    def _begin(self) -> None:
        # Every question to the state store is a round trip: a clip that is new has no state, and one that is not has all of it.
        self.known = self.next_emit.exists()
        self.expected = self.next_emit.get()[0] if self.known else 0
        # Frames ahead of their turn: a bounded number here, the others in the state store, of which the numbers are known as
        # bits, with the number of parts, by block.
        self.now, self.stored = pickle.loads(self.rule.get()[0]) if self.known else (self.fresh(), {})
        self.ahead: dict[int, tuple] = {}
        self.held = 0
        self.tally = [0, 0]
        self.bits: dict[int, bytearray] = {}

    def _close_batch(self, clip, out: list[tuple], ended: bool, timerValues) -> Iterator[pd.DataFrame]:
        for made in self._in_turn():
            out.extend(made)
            if len(out) >= OUT_ROWS:
                yield self._made(clip, out)
                out = []
        if ended:
            if self.ahead or self.stored:
                out.append(("gap", self.expected, *[None] * (len(self.output) - 3)))
            else:
                last = self.finish(self.now)
                self._count(last)
                out.extend(last)
                yield from self._listed(clip)
                out.append(("end", self.expected, *[None] * (len(self.output) - 3)))
        if out:
            yield self._made(clip, out)
        # Counters with a time to live may be gone, or outlive a tombstone.
        counted = self.known if self.remember is None else self.counts.exists()
        before = self.counts.get() if counted else (0, 0)
        self.counts.update((before[0] + self.tally[0], before[1] + self.tally[1]))
        if ended:
            self._set_timer(None)
            if self.known or self.stored:
                for state in (self.next_emit, self.early, self.rule, self.kept):
                    state.clear()
            self.ended.update((self.expected,))
            return
        self._put_away()
        for stretch, bits in self.bits.items():
            self.kept.updateValue((stretch,), (bytes(bits),))
        self.next_emit.update((self.expected,))
        self.rule.update((pickle.dumps((self.now, self.stored)),))
        if self.silent is not None:
            self._set_timer(timerValues.getCurrentProcessingTimeInMs() + int(self.silent * 1000))

    def _set_timer(self, at: int | None) -> None:
        if self.known and self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _count(self, out: list[tuple]) -> None:
        """Count what is handed on; with `lists` kept frames are noted, one bit each."""
        for kind, index, *rest in out:
            if kind in ("frame", "decision") and index is not None:
                self.tally[0] += 1
                if kind == "decision" and rest[0]:
                    self.tally[1] += 1
                    if self.lists:
                        self._note(index)

    def _note(self, index: int) -> None:
        stretch = index // STRETCH
        if stretch not in self.bits:
            there = self.known and self.kept.containsKey((stretch,))
            old = self.kept.getValue((stretch,))[0] if there else bytes(STRETCH // 8)
            self.bits[stretch] = bytearray(old)
        self.bits[stretch][index % STRETCH // 8] |= 1 << index % 8

    def _listed(self, clip) -> Iterator[pd.DataFrame]:
        """All kept frames of a clip that ends, some thousand at a time."""
        if not self.lists:
            return
        stored = {k[0] for k in self.kept.keys()} if self.known and self.kept.exists() else set()
        for stretch in sorted(stored | set(self.bits)):
            bits = self.bits.get(stretch) or self.kept.getValue((stretch,))[0]
            found = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")) + stretch * STRETCH
            yield self._made(clip, [("kept", int(i), True) for i in found])

    def _made(self, clip, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(clip, *row) for row in out], columns=self.output)

    def _hold(self, index: int, row: tuple) -> None:
        if index not in self.ahead:
            self.held += 256 + sum(len(v) for v in row if isinstance(v, (bytes, bytearray)))
        self.ahead[index] = row

    def _is_stored(self, index: int) -> bool:
        return bool(self.stored and self.stored.get(index // BLOCK, (0, 0))[0] >> index % BLOCK & 1)

    def _put_away(self) -> None:
        blocks: dict[int, dict[int, tuple]] = {}
        for index, row in self.ahead.items():
            blocks.setdefault(index // BLOCK, {})[index] = row
        for block, rows in blocks.items():
            bits, parts = self.stored.get(block, (0, 0))
            self.early.updateValue((block, parts), (pickle.dumps(rows),))
            self.stored[block] = bits | sum(1 << index % BLOCK for index in rows), parts + 1
        self.ahead, self.held = {}, 0

    def _fetch(self, block: int) -> None:
        """Take the early frames of a block out of the state store."""
        for part in range(self.stored.pop(block)[1]):
            for index, row in pickle.loads(self.early.getValue((block, part))[0]).items():
                self._hold(index, row)
            self.early.removeKey((block, part))

    def _in_turn(self) -> Iterator[list[tuple]]:
        """What the frames whose turn has come make, a few frames at a time."""
        while True:
            rows: list[tuple] = []
            while len(rows) < self.together:
                index = self.expected + len(rows)
                if self._is_stored(index):
                    self._fetch(index // BLOCK)
                if index not in self.ahead:
                    break
                rows.append(self.ahead.pop(index))
            if not self.ahead:
                self.held = 0
            if not rows:
                return
            made, self.now = self.take_many(self.now, self.expected, rows)
            self.expected += len(rows)
            self._count(made)
            yield made

    def _hand_on(self) -> list[tuple]:
        """The frame whose turn it is, and those that follow it and are at hand; what is stored waits for its turn
        at the end of the batch unless it comes next."""
        out: list[tuple] = []
        for made in self._in_turn():
            out.extend(made)
            if len(out) >= OUT_ROWS:
                break
        return out

    def close(self) -> None:
        pass


class Reorder(InOrder):
    """Frame numbers in order, with the order they were handed on."""

    output = ["clip_id", "kind", "frame_index", "emitted"]

    def fresh(self):
        return 0

    def take(self, rule, index, row):
        return [("frame", index, rule)], rule + 1


class Select(InOrder):
    """Any selection rule of `operators.selectors`; frames below the floor are dropped before it."""

    payload = ["sharpness", "gray", "valid"]
    output = ["clip_id", "kind", "frame_index", "keep"]

    def __init__(self, make_rule, floor: float | None = None):
        self.make_rule, self.floor = make_rule, floor

    def fresh(self):
        return self.make_rule()

    def take(self, rule, index, row):
        sharpness, gray, valid = row
        if self.floor is not None and float(sharpness) < self.floor:
            return [("decision", index, False)], rule
        frame = Frame(index, float(sharpness), np.frombuffer(gray, np.uint8),
                      None if valid is None else np.frombuffer(valid, np.uint8))
        return [("decision", i, k) for i, k in rule.push(frame)], rule

    def finish(self, rule):
        return [("decision", i, k) for i, k in rule.finish()]


class Smooth(InOrder):
    """Trailing mode of the label maps."""

    payload = ["labels"]
    output = ["clip_id", "kind", "frame_index", "labels"]
    #: One call of the kernel for so many frames.
    together = 64

    def __init__(self, window: int):
        self.window = odd_window(window)

    def fresh(self):
        return []

    def take_many(self, rule, index, rows):
        w, own = self.window, [row[0] for row in rows]
        if w == 1:
            return [("frame", index + k, b) for k, b in enumerate(own)], []
        history = rule + own
        block = np.stack([np.frombuffer(b, np.uint8) for b in history]).astype(np.int16)
        lead = np.full((w - 1 - len(rule), block.shape[1]), -1, dtype=np.int16)
        modes = kernels.trailing_mode(np.concatenate([lead, block]), w)
        return [("frame", index + k, mode.tobytes()) for k, mode in enumerate(modes)], history[-(w - 1):]


def _run(frames: DataFrame, processor: InOrder, schema: str, silent: float | None = None, remember: float | None = None,
         lists: bool = False) -> DataFrame:
    processor.silent, processor.remember, processor.lists = silent, remember, lists
    mode = "None" if silent is None and remember is None else "ProcessingTime"
    return frames.groupBy("clip_id").transformWithStateInPandas(
        processor, T._parse_datatype_string(schema), "Append", mode)


def stream_reorder(frames: DataFrame, **ending) -> DataFrame:
    """(clip_id, frame_index, is_end) in order; `gap` rows name lost frames.  `ending`: `silent` and `remember` seconds."""
    return _run(frames, Reorder(), ORDERED, **ending)


def stream_select(frames: DataFrame, threshold: float = P.MOTION_THRESHOLD,
                  window: int = P.MOTION_WINDOW, floor: float | None = None, **ending) -> DataFrame:
    """Motion-gated decisions as windows resolve; the end of a clip flushes, and with `lists` repeats what was kept."""
    return _run(frames, Select(lambda: MotionRule(threshold, window), floor), DECISIONS, **ending)


def stream_every_nth(frames: DataFrame, n: int = P.EVERY_NTH, floor: float | None = None, **ending) -> DataFrame:
    return _run(frames, Select(lambda: Counted(n), floor), DECISIONS, **ending)


def stream_rule(frames: DataFrame, make_rule, **ending) -> DataFrame:
    """Decisions of any selection rule; `make_rule` is called once per clip."""
    return _run(frames, Select(make_rule), DECISIONS, **ending)


def stream_smoothing(frames: DataFrame, window: int, **ending) -> DataFrame:
    """Smoothed label maps (clip_id, frame_index, labels)."""
    return _run(frames, Smooth(window), SMOOTHED, **ending)
