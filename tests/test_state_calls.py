"""Few calls to the state of a stream, however many keys and rows it has."""

import json
import random

import pandas as pd
import pytest

from driftline.streaming import processors
from tests.test_waiting_rows import Clock, Handle, Map, Value


class Counted:
    """State of a stream that counts the calls to it; a value can be cleared."""

    def __init__(self, of, calls):
        self.of, self.calls = of, calls

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "clear":
                self.of.v = None
                return None
            return getattr(self.of, name)(*args)

        return call


class CountedHandle(Handle):
    def __init__(self):
        super().__init__()
        self.calls, self.states = [], {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Counted(Map(), self.calls))

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Counted(Value(), self.calls))


def run(p, batches):
    """Rows that come out, and calls to the state: batches of rows, after each of which the watermark is at their last time."""
    handle, out = CountedHandle(), []
    p.init(handle)
    for rows in batches:
        p.handleInputRows((0,), iter([pd.DataFrame(rows, columns=p.columns)]), None)
        mark = max(r[0] for r in rows)
        while handle.timers and min(handle.timers) <= mark:
            handle.timers.remove(min(handle.timers))
            for frame in p.handleExpiredTimer((0,), Clock(mark), None):
                out.extend(frame.itertuples(index=False, name=None))
    return out, handle


def test_calls_to_the_state_do_not_grow_with_keys():
    def calls(n):
        sent = [(10 + i, 0, i, "modify", f"h{i}", "v", "d", f"p{i}") for i in range(n)]
        acks = [(10_000 + i, 2, i, "modify", None, "v", "d", f"p{i}") for i in range(n)]
        out, handle = run(processors.AckProcessor(10**6), [sent, acks])
        assert [(r[2], r[6], r[7]) for r in out] == [(f"p{i}", "put", f"h{i}") for i in range(n)]
        assert handle.states["known"].of.v is None
        return len(handle.calls)

    assert calls(900) == calls(3) < 40


@pytest.mark.parametrize("life_ms", [None, 3000])
def test_rename_queues_are_kept_in_blocks(monkeypatch, life_ms):
    monkeypatch.setattr(processors, "BLOCK_ROWS", 50)
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(4000):
        t += 1
        rows.append((t, int(rng.random() < (0.2 if i < 2000 else 0.8)), i, f"o{i}", f"n{i}", "v", rng.choice(["d", "e"])))
    got, handle = run(processors.RenameProcessor(life_ms), [rows[i : i + 500] for i in range(0, 4000, 500)])
    queues, want = {"d": [], "e": []}, []
    for t, role, i, old, new, _, device in rows:
        queue = queues[device]
        while life_ms and queue and queue[0][1] + life_ms < t:
            want.append(("v", device, *queue.pop(0), None))
        if role == 0:
            queue.append((i, t, old, new))
        elif queue:
            want.append(("v", device, *queue.pop(0), t))
    for device, queue in queues.items():
        while life_ms and queue and queue[0][1] + life_ms <= t:
            want.append(("v", device, *queue.pop(0), None))
    assert [r[:6] for r in sorted(got)] == [r[:6] for r in sorted(want)]
    acked = {r[2]: None if r[6] != r[6] else r[6] for r in got}
    assert acked == {r[2]: r[6] for r in want}
    assert len(handle.calls) < 600 < len(rows)


def test_chunk_numbers_are_kept_over_batches_as_ranges():
    frames = [(100 + k, 1, i, None, "s") for k, i in enumerate([5, 6, 7, 0, 6, 1, 2])]
    rest = [(200 + k, 1, i, None, "s") for k, i in enumerate([2, 3, 3, 4, 8])]
    p = processors.ChunkProcessor(10**6)
    out, handle = run(p, [[(10, 0, -1, 9, "s")], frames])
    assert out[-1][:2] == ("s", 6)
    assert json.loads(handle.states["known"].of.v[0]) == [[["s"], [9, 6, 106, False, [[0, 2], [5, 7]]]]]
    whole, _ = run(processors.ChunkProcessor(10**6), [[(10, 0, -1, 9, "s")], frames, rest])
    assert whole[-1] == ("s", 9, 9, 100, "success") and [r[1] for r in whole] == list(range(10))
