"""Waiting rows of a stream's key: in order whatever the batches, few of them in the worker at a time."""

import random

import pandas as pd
import pytest

from driftline.streaming import processors
from driftline.streaming.processors import OrderedProcessor


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


class Map:
    def __init__(self):
        self.d = {}

    def updateValue(self, k, v):
        assert k not in self.d
        self.d[k] = v

    def getValue(self, k):
        return self.d[k]

    def removeKey(self, k):
        del self.d[k]

    def keys(self):
        return iter(list(self.d))


class Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return Map()

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


class Seen(OrderedProcessor):
    ROW = "ts_ms long, role long, event_id long, hash string"
    OUT = ["ts_ms", "event_id"]

    def step(self, key, row, out):
        out.append((row["ts_ms"], row["event_id"]))


def played(rows, batches, marks, late):
    """What comes out when rows come in ``batches`` and the watermark then moves to each of ``marks``."""
    handle, p, out = Handle(), Seen(), []
    p.init(handle)
    for part in batches:
        p.handleInputRows(("k",), iter([pd.DataFrame([rows[i] for i in part], columns=p.columns)]), None)
        assert len(handle.timers) == 1
    for mark in marks:
        while handle.timers and min(handle.timers) <= mark:
            handle.timers.remove(min(handle.timers))
            for frame in p.handleExpiredTimer(("k",), Clock(mark), None):
                out.append(frame)
        seen = pd.concat(out) if out else pd.DataFrame(columns=p.OUT)
        assert seen.ts_ms.max() <= mark if len(seen) else True
        if late and mark == marks[0]:
            p.handleInputRows(("k",), iter([pd.DataFrame(late, columns=p.columns)]), None)
    assert not handle.timers and not p.waits.d
    return [tuple(r) for r in pd.concat(out).itertuples(index=False)]


@pytest.mark.parametrize("seed", range(4))
def test_event_order_whatever_the_batches(monkeypatch, seed):
    monkeypatch.setattr(processors, "BLOCK_ROWS", 7)
    rng = random.Random(seed)
    rows = [(rng.randrange(300), rng.randrange(2), i, rng.choice([None, "h"])) for i in range(500)]
    order = list(range(500))
    rng.shuffle(order)
    cuts = sorted(rng.sample(range(1, 500), 9))
    batches = [order[a:b] for a, b in zip([0, *cuts], [*cuts, 500])]
    late = [(250 + i % 40, 0, 1000 + i, None) for i in range(30)]
    got = played(rows, batches, [100, 180, 181, 1000], late)
    assert got == [(r[0], r[2]) for r in sorted([*rows, *late], key=lambda r: r[:3])]


def test_backlog_of_one_key_is_read_in_blocks():
    """200,000 rows of one key in 20 batches: a block of each batch at most is open, and nothing is written twice."""
    rows = [(i * 7919 % 200_000, 0, i, "h") for i in range(200_000)]
    handle, p = Handle(), Seen()
    p.init(handle)
    for at in range(0, len(rows), 10_000):
        p.handleInputRows(("k",), iter([pd.DataFrame(rows[at : at + 10_000], columns=p.columns)]), None)
    blocks, opened, most = len(p.waits.d), 0, 0
    seen = 0
    for frame in p.handleExpiredTimer(("k",), Clock(150_000), None):
        seen += len(frame)
        opened = blocks - len(p.waits.d)
        most = max(most, opened * processors.BLOCK_ROWS - seen)
    assert seen == 150_001 and most <= 20 * processors.BLOCK_ROWS + processors.FRAME_ROWS
    assert len(p.waits.d) <= blocks - opened + 20
    rest = sum(len(f) for f in p.handleExpiredTimer(("k",), Clock(10**9), None))
    assert rest == 49_999 and not p.waits.d
