"""Streams with state of their own: acknowledgements, transfers, rounds, key-value changes.

Each processor keeps small facts per key (a hash, a counter, chunk numbers), and the rows that have arrived but that event
time has not passed yet. Rows are acted on when the watermark has passed them, in event order, so the
result does not depend on how they fall into batches; what waits per key is bounded by the lateness. Waiting rows are sorted
blocks in a map by their first time, and are merged block by block, so a worker holds few of them however many wait. The state
lives in RocksDB (see ``sinks.use_rocksdb``).

Every call to the state is a message between two processes. So keys share ``BUCKETS`` groups: the facts of a group's keys are read
once and written once per batch, and the number of calls goes with groups and blocks, not with keys and rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Life of a transfer session, limit of a round, kinds of a round.
SESSION_TTL_MS = 20 * 60 * 1000
ROUND_LIMIT_MS = 30_000
ROUND_KINDS = ("note", "file", "config", "folder")
#: rows handed on in one frame, and waiting rows in a block of the state
FRAME_ROWS, BLOCK_ROWS = 10_000, 1_000
#: groups of keys
BUCKETS = 1_024


class OrderedProcessor(StatefulProcessor):
    """Takes the rows of each key of a group in event order, once no earlier one can come.

    ``ROW`` is the schema of what is kept of a row; its first ``ORDER`` columns, the first of them ``ts_ms``, are a total order.
    ``KEY`` names the string columns that tell the keys of a group apart (none: the group is the key). ``OUT`` names the columns
    of the result. ``facts`` holds what is known of each key while its group is at work, in values that JSON can hold.
    """

    ROW = ""
    ORDER = 3
    KEY: list[str] = []
    OUT: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = [*(c.split()[0] for c in self.ROW.split(", ")), *self.KEY]
        self.whole = [*(c.endswith(" long") for c in self.ROW.split(", ")), *(False for _ in self.KEY)]
        self.waits = handle.getMapState("waits", "head_ms long, serial long", "rows string")
        self.timer = handle.getValueState("timer", "at long, serial long")
        self.known = handle.getValueState("known", "facts string")
        self.facts: dict[tuple, list] = {}
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        """Declare further state of the operator."""

    def step(self, key: tuple, row: dict, out: list[tuple]) -> None:
        """Act on the next row of a key in event order."""

    def elapse(self, key: tuple, now: int, out: list[tuple]) -> None:
        """Act on what has run out for a key by ``now`` (the watermark)."""

    def deadline(self, facts: list) -> int | None:
        """When something of a key runs out next."""
        return None

    def packed(self, facts: list) -> list:
        """Facts of a key as they are stored."""
        return facts

    def _load(self) -> None:
        found = self.known.get()
        self.facts = {tuple(k): f for k, f in json.loads(found[0])} if found else {}
        self.stored = bool(self.facts)

    def _store(self) -> None:
        if self.facts:
            self.known.update((json.dumps([[k, self.packed(f)] for k, f in self.facts.items()]),))
        elif self.stored:
            self.known.clear()

    def _wake(self, at: int | None, serial: int, old: int | None) -> None:
        """Be called when event time has passed ``at``; ``old`` is the time that is set now."""
        if at is not None and old != at and (old is None or at < old):
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            old = at
        self.timer.update((old, serial))

    def _keep(self, rows: list[tuple], serial: int) -> int:
        """Store sorted rows in blocks; gives the next serial number."""
        for at in range(0, len(rows), BLOCK_ROWS):
            block = rows[at : at + BLOCK_ROWS]
            self.waits.updateValue((block[0][0], serial), (json.dumps(block),))
            serial += 1
        return serial

    def _value(self, v, whole: bool):
        return None if v is None or v != v else int(v) if whole else v

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old, serial = self.timer.get() or (None, 0)
        first = None
        for frame in rows:
            kept = zip(*(frame[c].tolist() for c in self.columns))
            ordered = sorted((tuple(self._value(v, w) for v, w in zip(r, self.whole)) for r in kept), key=lambda r: r[: self.ORDER])
            serial = self._keep(ordered, serial)
            first = ordered[0][0] if first is None else min(first, ordered[0][0])
        if first is not None:
            self._wake(first, serial, old)
        return iter(())

    def _due(self, now: int, left: list[tuple]) -> Iterator[tuple]:
        """Rows up to ``now`` in order. Blocks are opened when their first time is reached and go when they are used up;
        what comes later of an opened one is added to ``left``."""
        keys = sorted(tuple(k) for k in self.waits.keys() if k[0] <= now)[::-1]
        heap: list[tuple] = []
        while keys or heap:
            while keys and (not heap or keys[-1][0] <= heap[0][0][0]):
                key = keys.pop()
                block = [tuple(r) for r in json.loads(self.waits.getValue(key)[0])]
                self.waits.removeKey(key)
                heapq.heappush(heap, (block[0][: self.ORDER], key[1], 0, block))
            _, serial, at, block = heapq.heappop(heap)
            if block[at][0] > now:
                left.append(block[at:])
                continue
            if at + 1 < len(block):
                heapq.heappush(heap, (block[at + 1][: self.ORDER], serial, at + 1, block))
            yield block[at]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        serial = (self.timer.get() or (None, 0))[1]
        out: list[tuple] = []
        left: list[tuple] = []
        n = len(self.columns) - len(self.KEY)
        self._load()
        for r in self._due(now, left):
            self.step(r[n:] if self.KEY else key, dict(zip(self.columns, r)), out)
            if len(out) >= FRAME_ROWS:
                yield pd.DataFrame(out, columns=self.OUT)
                out = []
        for k in list(self.facts):
            self.elapse(k, now, out)
        if out:
            yield pd.DataFrame(out, columns=self.OUT)
        self._store()
        for block in left:
            serial = self._keep(block, serial)
        ends = [k[0] for k in self.waits.keys()]
        ends.extend(end for f in self.facts.values() if (end := self.deadline(f)) is not None)
        self.facts = {}
        self._wake(min(ends, default=None), serial, None)

    def close(self) -> None:
        pass


def _in_buckets(rows: DataFrame, processor: OrderedProcessor, schema: str) -> DataFrame:
    """Rows of the processor over ``rows``, whose keys are dealt to groups by their hash."""
    grouped = rows.withColumn("bucket", F.pmod(F.xxhash64(*processor.KEY), F.lit(BUCKETS))).groupBy("bucket")
    return grouped.transformWithStateInPandas(processor, schema, "Append", "EventTime")


ACK_SCHEMA = "vault string, device string, path string, event_id long, ts_ms long, op string, effect string, hash string"


class AckProcessor(OrderedProcessor):
    """Waiting hash and waiting delete of one path."""

    ROW = "ts_ms long, role long, event_id long, op string, hash string"
    KEY = ["vault", "device", "path"]
    OUT = ["vault", "device", "path", "event_id", "ts_ms", "op", "effect", "hash"]

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def deadline(self, facts) -> int | None:
        return facts[3] + self.timeout_ms

    def elapse(self, key, now, out) -> None:
        waiting = self.facts.get(key)
        if waiting is not None and self.deadline(waiting) <= now:
            op, _, event_id, ts_ms = self.facts.pop(key)
            out.append((*key, event_id, ts_ms, op, "timeout", None))

    def step(self, key, row, out) -> None:
        self.elapse(key, row["ts_ms"] - 1, out)
        op = row["op"] if row["role"] == 1 else "delete" if row["op"] == "delete" else "modify"
        if row["role"] == 0:
            self.facts[key] = [op, row["hash"], row["event_id"], row["ts_ms"]]
            return
        kept = tuple(self.facts.get(key, (None, None)))
        if row["role"] == 1:
            effect, h, ends = self._pushed(op, row["hash"], kept)
        else:
            ends = kept[0] == op
            effect = ("put" if op == "modify" else "remove") if ends else "none"
            h = kept[1] if effect == "put" else None
        out.append((*key, row["event_id"], row["ts_ms"], op, effect, h))
        if ends:
            self.facts.pop(key, None)

    @staticmethod
    def _pushed(op: str, pushed: str | None, kept: tuple) -> tuple[str, str | None, bool]:
        """Effect and hash of a push, and whether what waits ends with it (see ``operators.acks.settle``)."""
        if op == "modify":
            return "put", pushed, True
        if op == "mtime":
            return ("put", kept[1], True) if kept[0] == "modify" else ("none", None, False)
        if op == "delete":
            return "remove", None, kept[0] == "modify"
        return "none", None, op == "update" and kept[0] == "delete"


def _two_feeds(first: DataFrame, second: DataFrame, late: str) -> DataFrame:
    """Both feeds with a watermark each, so the slower one counts."""
    return first.withWatermark("ts", late).unionByName(second.withWatermark("ts", late))


def ack_stream(sent: DataFrame, acks: DataFrame, late: str, timeout_ms: int, pushes: DataFrame | None = None) -> DataFrame:
    """Effect of each path acknowledgement, and of each push of the server; what is not answered within ``timeout_ms`` comes out as ``timeout``.

    A path waits for one thing at a time: a newer send replaces the older one, as content cancels a
    waiting delete and a delete drops waiting content. ``pushes`` do what they do in ``operators.acks.settle``.
    """
    columns = ["vault", "device", "path", "event_id", "ts_ms", "ts", "op"]

    def role(df: DataFrame, n: int, hashed: bool) -> DataFrame:
        return df.select(*columns, "hash" if hashed else F.lit(None).cast("string").alias("hash"), F.lit(n).cast("long").alias("role"))

    rows = _two_feeds(role(sent, 0, True), role(acks, 2, False), late)
    if pushes is not None:
        rows = rows.unionByName(role(pushes, 1, True).withWatermark("ts", late))
    return _in_buckets(rows, AckProcessor(timeout_ms), ACK_SCHEMA)


RENAME_SCHEMA = (
    "vault string, device string, event_id long, ts_ms long, old_path string, path string, acked_at long"
)


class RenameProcessor(OrderedProcessor):
    """Renames of one device that wait, first in first out.

    The queue is its first and last rows and, between them, whole blocks in a map, so a batch opens the blocks it
    takes from and not the whole queue. A rename that waits for longer than its life leaves it.
    """

    ROW = "ts_ms long, role long, event_id long, old_path string, path string"
    KEY = ["vault", "device"]
    OUT = ["vault", "device", "event_id", "ts_ms", "old_path", "path", "acked_at"]

    def __init__(self, life_ms: int | None):
        self.life_ms = life_ms

    def start(self, handle) -> None:
        self.blocks = handle.getMapState("blocks", "key string, place long", "rows string")

    def _put(self, key: tuple, rename: tuple) -> None:
        """Facts are the first rows, the next one last, the places of the blocks after them, and the last rows. Without first rows there are no facts."""
        if key not in self.facts:
            self.facts[key] = [[rename], 0, 0, []]
            return
        _, _, end, last = self.facts[key]
        last.append(rename)
        if len(last) >= BLOCK_ROWS:
            self.blocks.updateValue((json.dumps(key), end), (json.dumps(last),))
            self.facts[key][2:] = [end + 1, []]

    def _take(self, key: tuple) -> tuple:
        first, start, end, last = self.facts[key]
        rename = first.pop()
        if not first:
            if start < end:
                at = (json.dumps(key), start)
                last = json.loads(self.blocks.getValue(at)[0])
                self.blocks.removeKey(at)
                self.facts[key][:2] = [last[::-1], start + 1]
            elif last:
                self.facts[key] = [last[::-1], 0, 0, []]
            else:
                del self.facts[key]
        return rename

    def deadline(self, facts) -> int | None:
        return None if self.life_ms is None else facts[0][-1][1] + self.life_ms

    def elapse(self, key, now, out) -> None:
        while self.life_ms is not None and key in self.facts and self.deadline(self.facts[key]) <= now:
            out.append((*key, *self._take(key), None))

    def step(self, key, row, out) -> None:
        self.elapse(key, row["ts_ms"] - 1, out)
        if row["role"] == 0:
            self._put(key, (row["event_id"], row["ts_ms"], row["old_path"], row["path"]))
        elif key in self.facts:
            out.append((*key, *self._take(key), row["ts_ms"]))


def rename_ack_stream(renames: DataFrame, acks: DataFrame, late: str, life_ms: int | None = None) -> DataFrame:
    """Acknowledged renames; an ack takes the oldest waiting rename of its device.

    With ``life_ms``, a rename that waits for longer comes out with a null ``acked_at``, so the queue does not grow for ever.
    """
    key = ["vault", "device", "event_id", "ts_ms", "ts"]
    r = renames.select(*key, "old_path", "path", F.lit(0).cast("long").alias("role"))
    none = F.lit(None).cast("string")
    a = acks.select(*key, none.alias("old_path"), none.alias("path"), F.lit(1).cast("long").alias("role"))
    return _in_buckets(_two_feeds(r, a, late), RenameProcessor(life_ms), RENAME_SCHEMA)


CHUNK_SCHEMA = "session_id string, received long, total_chunks long, percent long, status string"


class ChunkProcessor(OrderedProcessor):
    """Chunk numbers of one session, stored as ranges. Payloads are not kept here; they go to the sink as they come.

    Facts are the number of chunks, how many are there, the last time, whether the session has ended, and the numbers.
    """

    ROW = "ts_ms long, role long, chunk_index long, total_chunks long"
    KEY = ["session_id"]
    OUT = ["session_id", "received", "total_chunks", "percent", "status"]

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def packed(self, facts) -> list:
        if isinstance(facts[4], list):
            return facts
        ranges: list[list[int]] = []
        for i in sorted(facts[4]):
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
        return [*facts[:4], ranges]

    def _seen(self, facts: list) -> set[int]:
        """Numbers of a session; taken out of their ranges when its first row in a batch comes."""
        if isinstance(facts[4], list):
            facts[4] = {i for a, b in facts[4] for i in range(a, b + 1)}
        return facts[4]

    def deadline(self, facts) -> int | None:
        return facts[2] + self.ttl_ms

    def _emit(self, key, total, received, at, status, out) -> None:
        """An ended session is remembered for its life, so that copies of chunks that come after the end open nothing."""
        percent = 0 if total is None else 100 if total == 0 else received * 100 // total
        out.append((*key, received, total, percent, status))
        if status != "pending":
            self.facts[key] = [total or 0, received, at, True, []]

    def elapse(self, key, now, out) -> None:
        facts = self.facts.get(key)
        if facts is not None and self.deadline(facts) <= now:
            total, received, at, ended, _ = facts
            if not ended:
                self._emit(key, total, received, at, "expired", out)
            del self.facts[key]

    def step(self, key, row, out) -> None:
        at = row["ts_ms"]
        self.elapse(key, at - 1, out)
        facts = self.facts.get(key, [None, 0, 0, False, []])
        total, received, _, ended, _ = facts
        if row["role"] == 0:
            total, received = row["total_chunks"], 0 if ended else received
            self.facts[key] = [total, received, at, False, facts[4]]
            self._emit(key, total, received, at, "success" if received >= total else "pending", out)
            return
        if ended:
            return
        index = row["chunk_index"]
        if total is None or index >= total:
            self._emit(key, total, received, at, "error", out)
            return
        before = received * 10 // total
        seen = self._seen(facts)
        if index not in seen:
            seen.add(index)
            received += 1
        facts[1:3] = [received, at]
        if received == total:
            self._emit(key, total, received, at, "success", out)
        elif received * 10 // total > before:
            self._emit(key, total, received, at, "pending", out)


def chunk_stream(opened: DataFrame, frames: DataFrame, late: str, ttl_ms: int = SESSION_TTL_MS) -> DataFrame:
    """State of transfers: a ``pending`` row when a session opens and whenever another tenth of it is there, and one when it ends.

    ``opened`` announces sessions (``session_id``, ``total_chunks``); ``frames`` carries the numbers of
    arrived chunks. A chunk of a session that is not open by then, or past its end, is an error; a chunk
    that comes twice counts once.
    """
    none = F.lit(None).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    a = opened.select("session_id", "ts_ms", "ts", "total_chunks", F.lit(-1).cast("long").alias("chunk_index"), zero.alias("role"))
    b = frames.select("session_id", "ts_ms", "ts", none.alias("total_chunks"), "chunk_index", one.alias("role"))
    return _in_buckets(_two_feeds(a, b, late), ChunkProcessor(ttl_ms), CHUNK_SCHEMA)


ROUND_SCHEMA = "vault string, context string, outcome string, total long, completed long, started_ms long, finished_ms long"


class RoundProcessor(OrderedProcessor):
    """Tasks to do, tasks done and the end of each kind of one round. Facts are its start, the tasks and the done ones by kind."""

    ROW = "ts_ms long, seq long, what string, kind string, n_tasks long"
    ORDER = 2
    KEY = ["vault", "context"]
    OUT = ["vault", "context", "outcome", "total", "completed", "started_ms", "finished_ms"]

    def __init__(self, limit_ms: int, kinds: tuple[str, ...]):
        self.limit_ms, self.kinds = limit_ms, kinds

    def packed(self, facts) -> list:
        return [facts[0], *([[k, n] for k, n in counts.items()] for counts in facts[1:])]

    def _counts(self, facts: list) -> tuple[dict, dict]:
        """Counts by kind (which may be null); read from pairs when the first row of a round in a batch comes."""
        facts[1:] = [dict(counts) for counts in facts[1:]]
        return facts[1], facts[2]

    def deadline(self, facts) -> int | None:
        return facts[0] + self.limit_ms

    def elapse(self, key, now, out) -> None:
        facts = self.facts.get(key)
        if facts is not None and (end := self.deadline(facts)) <= now:
            totals, done = self._counts(facts)
            completed = sum(min(n, totals.get(k, n)) for k, n in done.items())
            out.append((*key, "forced", sum(totals.values()), completed, facts[0], end))
            del self.facts[key]

    def step(self, key, row, out) -> None:
        now, what, kind = row["ts_ms"], row["what"], row["kind"]
        if what == "start":
            self.facts[key] = [now, {}, {}]
            return
        self.elapse(key, now - 1, out)
        if key not in self.facts:
            return
        facts = self.facts[key]
        totals, done = self._counts(facts)
        if what == "end":
            totals[kind] = row["n_tasks"] or 0  # a repeated end of a kind replaces the one before
        else:
            done[kind] = done.get(kind, 0) + 1
        if all(k in totals and done.get(k, 0) >= totals[k] for k in self.kinds):
            total = sum(totals.values())
            out.append((*key, "done", total, total, facts[0], now))
            del self.facts[key]


def round_stream(
    messages: DataFrame, late: str, limit_ms: int = ROUND_LIMIT_MS, kinds: tuple[str, ...] = ROUND_KINDS
) -> DataFrame:
    """Rounds that are ``done`` (the end of every kind came, and as many tasks of each were completed) or ``forced`` after
    the limit. ``messages`` has ``what`` start, end (with ``n_tasks``) or done, and its ``kind``, per vault and context."""
    rows = messages.select("vault", "context", "seq", "ts_ms", "ts", "what", "kind", "n_tasks").withWatermark("ts", late)
    return _in_buckets(rows, RoundProcessor(limit_ms, kinds), ROUND_SCHEMA)


KV_SCHEMA = "vault string, device string, key string, hash string, seq long, ts_ms long"


class KeyValueProcessor(OrderedProcessor):
    """Last hash of one item."""

    ROW = "ts_ms long, seq long, hash string, origin string"
    ORDER = 2
    KEY = ["vault", "device", "key"]
    OUT = ["vault", "device", "key", "hash", "seq", "ts_ms"]

    def step(self, key, row, out) -> None:
        last = self.facts.get(key, [None])[0]
        if row["origin"] == "local" and row["hash"] != last:
            out.append((*key, row["hash"], row["seq"], row["ts_ms"]))
        self.facts[key] = [row["hash"]]


def kv_change_stream(items: DataFrame, late: str) -> DataFrame:
    """Local writes that change an item; a remote write is taken over without a row."""
    rows = items.select("vault", "device", "key", "hash", "origin", "seq", "ts_ms", "ts").withWatermark("ts", late)
    return _in_buckets(rows, KeyValueProcessor(), KV_SCHEMA)
