"""The state of a processor in memory, so that many random streams can be run without a cluster."""

import random
from collections import defaultdict

import pandas as pd

from framesift.streaming import segments as S


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Several(Value):
    def get(self):
        return iter(self.value or [])

    def appendValue(self, value):
        self.value = [*(self.value or []), value]


class Handle:
    def __init__(self):
        self.states = defaultdict(Value)
        self.timers = set()

    def getValueState(self, name, schema, ttl=None):
        return self.states[name]

    def getListState(self, name, schema, ttl=None):
        return self.states.setdefault(name, Several())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def held(self):
        return {n for n, s in self.states.items() if s.exists()}


class Clock:
    def __init__(self, now=0):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


class Segmented:
    """The two operators of `segments.segmented`, batch by batch."""

    def __init__(self, make_rule, floor=None, segment=8, warmup=3, silent=None, remember=None):
        self.size, self.warmup = segment, min(warmup, segment)
        self.make = lambda: S.SegmentRuns(make_rule, floor, segment, self.warmup)
        self.compose = lambda: S.Compose(segment, silent, remember)
        self.make_rule = make_rule
        self.first, self.second = defaultdict(Handle), defaultdict(Handle)
        self.out, self.messages = [], []
        self.clock = Clock()

    def batch(self, rows, deliver=True):
        """rows: (clip, index, sharpness, gray, valid, is_end); messages of earlier batches come along."""
        keyed = defaultdict(list)
        for clip, index, sharpness, gray, valid, is_end in rows:
            if is_end:
                keyed[clip, -1].append((None, None, None, None, None))
                continue
            own = index // self.size
            for s in (own, own + 1) if index % self.size >= self.size - self.warmup else (own,):
                keyed[clip, s].append((index, sharpness, gray, valid, None))
        told, self.messages = (self.messages, []) if deliver else ([], self.messages)
        for clip, segment, body in told:
            keyed[clip, segment].append((None, None, None, None, body))
        notes = defaultdict(list)
        for key, own in keyed.items():
            processor = self.make()
            processor.init(self.first[key])
            pdf = pd.DataFrame(own, columns=["frame_index", "sharpness", "gray", "valid", "body"])
            for made in processor.handleInputRows(key, iter([pdf]), self.clock):
                notes[key[0]].append(made)
        for clip, own in notes.items():
            self._second(clip, lambda p: p.handleInputRows((clip,), iter(own), self.clock))

    def _second(self, clip, call):
        processor = self.compose()
        processor.make_rule = self.make_rule
        processor.init(self.second[clip])
        for made in call(processor):
            for r in made.itertuples(index=False):
                if r.kind == "message":
                    self.messages.append((r.clip_id, int(r.segment), r.body))
                else:
                    self.out.append((r.clip_id, r.kind, int(r.frame_index), None if pd.isna(r.keep) else bool(r.keep)))

    def wait(self, ms):
        self.clock.now += ms
        for clip, handle in list(self.second.items()):
            for at in sorted(t for t in handle.timers if t <= self.clock.now):
                handle.timers.discard(at)
                self._second(clip, lambda p: p.handleExpiredTimer((clip,), self.clock, None))

    def settle(self):
        for _ in range(10000):
            if not self.messages:
                return
            self.batch([])
        raise AssertionError("messages without end")

    def decided(self):
        return sorted((c, i, k) for c, kind, i, k in self.out if kind == "decision")

    def of(self, kind):
        return sorted((c, i) for c, k, i, _ in self.out if k == kind)

    def held(self):
        return {k: h.held() for k, h in [*self.first.items(), *self.second.items()] if h.held()}


def scrambled(rows, rng, batches):
    rows = rng.sample(rows, len(rows))
    cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(batches - 1))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


__all__ = ["Clock", "Handle", "Segmented", "random", "scrambled"]
