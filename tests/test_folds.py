"""Ordered folds one call at a time: any arrival order, cost of a call, and the end of state."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from fleetlens.streaming.folds import (
    DAY_MS, CellFold, ComponentFold, ContainerFold, OrderedFold, PhaseFold, SequenceFold, SilenceFold, _fields)


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map:
    def __init__(self):
        self.held, self.reads, self.writes = {}, 0, 0

    def getValue(self, key):
        self.reads += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.writes += 1
        self.held[key] = value

    def containsKey(self, key):
        return key in self.held

    def removeKey(self, key):
        del self.held[key]

    def clear(self):
        self.held = {}


class Handle:
    """State of one key, with its timers."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema, ttl=None):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Map())

    def listTimers(self):
        return sorted(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def empty(self):
        return not self.timers and not any(s.held for s in self.states.values())


class Driver:
    """Feeds a fold of one key, with the watermark ``delay`` behind the newest row."""

    def __init__(self, fold: OrderedFold, delay: int, key=("k",)):
        self.fold, self.delay, self.key, self.handle = fold, delay, key, Handle()
        self.newest, self.out = 0, []
        fold.init(self.handle)

    def at(self, watermark):
        return SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)

    def feed(self, rows):
        names = [n for n, _ in _fields(self.fold.row_schema)]
        frame = pd.DataFrame([[r[n] for n in names] for r in rows], columns=names, dtype=object)
        self.collect(self.fold.handleInputRows(self.key, iter([frame]), self.at(self.newest - self.delay)))
        self.newest = max(self.newest, *(r["at_ms"] for r in rows))
        self.tick(self.newest - self.delay)

    def tick(self, watermark):
        for timer in [t for t in self.handle.listTimers() if t <= watermark]:
            if timer in self.handle.timers:
                self.handle.deleteTimer(timer)
                self.collect(self.fold.handleExpiredTimer(self.key, self.at(watermark), None))

    def collect(self, frames):
        for f in frames:
            self.out += [tuple(r) for r in f.itertuples(index=False, name=None)]


def events_of(kind, n, rng):
    at = 1_000_000
    for seq in range(n):
        at += rng.randint(0, 4000)
        yield {**kind(rng, seq), "seq": seq, "at_ms": at}


KINDS = {
    "sequence": (lambda: SequenceFold(), lambda r, i: {"response_id": None if r.random() < 0.1 else i + (r.random() < 0.2)}),
    "container": (lambda: ContainerFold(60), lambda r, i: {
        "event": r.choice(["ALLOCATED", "SURPLUS", "STARTED", "START_FAILED", "RELEASED", "COMPLETED"]), "role_id": 1, "host": 2}),
    "phases": (lambda: PhaseFold(20_000), lambda r, i: {
        "cycle": i // 4, "probe": i % 4, "kind": "dependency" if i % 4 == 0 else "monitor", "success": r.random() < 0.8}),
}


@pytest.mark.parametrize("name", KINDS)
@pytest.mark.parametrize("seed", range(8))
def test_any_order_within_the_delay(name, seed):
    make, kind = KINDS[name]
    rng = random.Random(seed)
    rows = list(events_of(kind, 120, rng))
    delay = 30_000
    late = [(r["at_ms"] + rng.randint(0, delay - 1), r) for r in rows]  # when each arrives
    shuffled = [r for _, r in sorted(late, key=lambda x: x[0])]
    fold = make()
    fold.slot_ms = rng.choice([1, 700, 5000])
    one, other = Driver(make(), delay), Driver(fold, delay)
    one.feed(rows)
    while shuffled:
        n = rng.randint(1, 9)
        part, shuffled = shuffled[:n], shuffled[n:]
        other.feed(part)
    for d in (one, other):
        d.tick(d.newest + 60_000)
        assert len(d.handle.states["waiting"].held) == 0
    assert one.out == other.out and len(one.out) > 5


def test_a_call_reads_only_what_is_due():
    fold = SequenceFold()
    fold.slot_ms = 1000
    d = Driver(fold, delay=10_000_000)
    for i in range(200):
        d.feed([{"response_id": i * 5 + j, "seq": i * 5 + j, "at_ms": 20_000_000 + i * 1000 + j} for j in range(5)])
    waiting = d.handle.states["waiting"]
    assert waiting.reads == 0 and waiting.writes == 200 and len(waiting.held) == 200
    d.tick(20_003_000)  # three of two hundred slots
    assert waiting.reads == 3 and len(waiting.held) == 197


def test_state_ends_after_the_retention_time():
    far = 40 * DAY_MS
    cases = [
        (SequenceFold(), [{"response_id": 1}]),
        (ContainerFold(60), [{"event": e, "role_id": 1, "host": 2} for e in ("ALLOCATED", "STARTED", "COMPLETED")]),
        (CellFold(), [{"effect": e} for e in ("ASSIGNED", "STARTED", "RELEASING", "RELEASED")]),
        (ComponentFold(), [{"kind": "issue", "command": "INSTALL", "result": None}]),
        (SilenceFold(1000, 1000), [{"phase": "LIVE"}]),
        (PhaseFold(1000), [{"cycle": i, "probe": 1, "kind": k, "success": True} for i, k in enumerate(["dependency", "monitor", "monitor"])])]
    for fold, rows in cases:
        d = Driver(fold, delay=1000)
        d.feed([{**r, "seq": i, "at_ms": 10_000 + i} for i, r in enumerate(rows)])
        d.tick(60_000)
        assert not d.handle.empty() and d.handle.timers
        d.tick(far)
        assert d.handle.empty(), type(fold)
        forever = type(fold)(*([1000, 1000] if isinstance(fold, SilenceFold) else [60] if isinstance(fold, (ContainerFold, PhaseFold)) else []))
        forever.retention_ms = None
        d = Driver(forever, delay=1000)
        d.feed([{**r, "seq": i, "at_ms": 10_000 + i} for i, r in enumerate(rows)])
        d.tick(60_000)
        d.tick(far)
        assert not d.handle.empty()


def test_what_is_open_is_kept():
    cases = [(ContainerFold(60), [{"event": "ALLOCATED", "role_id": 1, "host": 2}, {"event": "STARTED", "role_id": 1, "host": 2}],
              {"event": "COMPLETED", "role_id": 1, "host": 2}, "FAILED"),
             (CellFold(), [{"effect": "ASSIGNED"}, {"effect": "STARTED"}], {"effect": "FAILED"}, 1)]
    for fold, rows, last, want in cases:
        d = Driver(fold, delay=1000)
        d.feed([{**r, "seq": i, "at_ms": 10_000 + i} for i, r in enumerate(rows)])
        d.tick(40 * DAY_MS)
        assert not d.handle.empty()
        d.feed([{**last, "seq": 9, "at_ms": 50 * DAY_MS}])
        d.tick(51 * DAY_MS)
        assert want in d.out[-1]
        d.tick(90 * DAY_MS)
        assert d.handle.empty()


def test_a_forgotten_agent_breaks_nothing():
    d = Driver(SequenceFold(), delay=1000)
    d.feed([{"response_id": 5, "seq": 1, "at_ms": 10_000}])
    d.tick(20 * DAY_MS)
    d.feed([{"response_id": 1, "seq": 2, "at_ms": 30 * DAY_MS}, {"response_id": 3, "seq": 3, "at_ms": 30 * DAY_MS + 1}])
    d.tick(31 * DAY_MS)
    assert d.out == [("k", 3, 3, 1)]
