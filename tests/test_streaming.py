"""Streams cut in many batches, in order and inside the watermark, against the batch operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from driftline.operators import acks, windows
from driftline.operators.rules import RuleBook
from driftline.plans import live_change
from driftline.sources.changes import read_changes
from driftline.streaming import feeds, processors, sinks
from tests.test_operators import EVENTS, random_events

END_MS = 10**9


class Feed:
    """Rows written file by file; each file is one batch of the stream."""

    def __init__(self, spark, root, name, rows, schema, batches, end=None, shuffle=0):
        self.spark, self.path = spark, str(root / name)
        at = [c.split()[0] for c in schema.split(", ")].index("ts_ms")
        rows = sorted(rows, key=lambda r: r[at])
        size = -(-len(rows) // batches)
        groups = [rows[i : i + size] for i in range(0, len(rows), size)]
        if end is not None:
            groups.append(end if isinstance(end, list) else [end])
        for group in groups:
            random.Random(shuffle).shuffle(group)
            df = spark.createDataFrame(group, schema).withColumn("ts", F.timestamp_millis("ts_ms"))
            df.coalesce(1).write.mode("append").parquet(self.path)
            time.sleep(0.01)
        self.schema = schema + ", ts timestamp"

    def stream(self, max_files=1):
        return read_changes(self.spark, self.path, schema=self.schema, max_files=max_files)


def rows_of(spark, root, name, stream):
    out = str(root / name)
    sinks.write_append(stream, out, out + "-check").awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


@pytest.mark.parametrize("batches", [1, 3])
def test_debounce_stream_equals_batch(spark, tmp_path, batches):
    events = random_events(random.Random(21), 120, 3)
    end = (-1, END_MS, "end", "d", "modify", "end", None, None, 0, 0)
    feed = Feed(spark, tmp_path, "ev", events, EVENTS, batches, end)
    got = rows_of(spark, tmp_path, "out", feeds.debounce_stream(feed.stream(), 30, "1 second"))
    want = windows.debounce(spark.createDataFrame(events, EVENTS), 30).collect()
    assert {r.event_id for r in got if r.vault != "end"} == {r.event_id for r in want}


def test_ack_stream_in_batches(spark, tmp_path):
    sinks.use_rocksdb(spark)
    rng = random.Random(23)
    cols = "event_id long, ts_ms long, vault string, device string, path string, op string"
    moves = [(i, 10 + i * 10, rng.random() < 0.5, rng.choice(["modify", "delete"]), f"p{rng.randrange(3)}") for i in range(60)]
    sent = [(i, t, "v", "d", p, op, f"h{i}") for i, t, s, op, p in moves if s]
    back = [(i, t, "v", "d", p, op, t) for i, t, s, op, p in moves if not s]
    # the same feed holds both, so that a batch of sends meets its own acks
    rows = [(i, t, "v", "d", p, op, f"h{i}", s) for i, t, s, op, p in moves]
    feed = Feed(spark, tmp_path, "moves", rows, cols + ", hash string, sent boolean", 4, [(-1, END_MS, "end", "d", "x", "modify", "h", True), (-2, END_MS, "end", "d", "y", "modify", "h", False)])
    both = feed.stream()
    stream = processors.ack_stream(both.filter("sent"), both.filter("NOT sent"), "1 second", 500)
    got = rows_of(spark, tmp_path, "out", stream)
    want = acks.match_acks(spark.createDataFrame(sent, cols + ", hash string"), spark.createDataFrame(back, cols + ", last_time long")).collect()
    assert {(r.event_id, r.effect, r.hash) for r in got if r.effect != "timeout" and r.vault != "end"} == {(r.event_id, r.effect, r.hash) for r in want}
    last = {}
    for i, _, s, op, p in moves:
        if s:
            last[p] = (i, op)
        elif p in last and last[p][1] == op:
            last.pop(p)
    assert {r.event_id for r in got if r.effect == "timeout"} == {i for i, _ in last.values()}


def test_rename_queue_across_batches(spark, tmp_path):
    sinks.use_rocksdb(spark)
    rng = random.Random(25)
    moves = [(i, i * 10, rng.random() < 0.5) for i in range(50)]
    rows = [(i, t, "v", "d", "o", f"n{i}", a) for i, t, a in moves]
    schema = "event_id long, ts_ms long, vault string, device string, old_path string, path string, ack boolean"
    ends = [(-1, END_MS, "end", "d", "o", "n", False), (-2, END_MS, "end", "d", "o", "n", True)]
    both = Feed(spark, tmp_path, "moves", rows, schema, 3, ends).stream()
    got = rows_of(spark, tmp_path, "out", processors.rename_ack_stream(both.filter("NOT ack"), both.filter("ack"), "1 second"))
    df = spark.createDataFrame(rows, schema)
    want = acks.match_rename_acks(df.filter("NOT ack"), df.filter("ack")).filter("acked_at IS NOT NULL").collect()
    assert {(r.event_id, r.acked_at) for r in got} == {(r.event_id, r.acked_at) for r in want} and len(want) > 5


def test_chunk_sessions_across_batches(spark, tmp_path):
    sinks.use_rocksdb(spark)
    opened = [("a", 10, 3), ("b", 10, 2), ("late", 10, 5)]
    frames = [("a", 11, 0), ("a", 12, 0), ("b", 13, 1), ("x", 14, 0), ("a", 15, 2), ("a", 16, 1), ("b", 17, 7), ("late", 18, 4)]
    o = Feed(spark, tmp_path, "o", opened, "session_id string, ts_ms long, total_chunks long", 1, ("end", END_MS * 10, 1))
    f = Feed(spark, tmp_path, "f", frames, "session_id string, ts_ms long, chunk_index long", 4, ("end", END_MS * 10, 0))
    rows = rows_of(spark, tmp_path, "out", processors.chunk_stream(o.stream(), f.stream(), "1 second"))
    final = {r.session_id: (r.status, r.received) for r in rows if r.status in ("success", "error", "expired") and r.session_id != "end"}
    assert final == {"a": ("success", 3), "b": ("error", 1), "x": ("error", 0), "late": ("expired", 1)}


def test_rounds_finish_or_are_forced(spark, tmp_path):
    sinks.use_rocksdb(spark)
    schema = "seq long, ts_ms long, vault string, context string, what string, kind string, n_tasks long"
    kinds = processors.ROUND_KINDS
    rows, n = [], 0
    for c, gap in (("quick", 100), ("slow", 9000), ("silent", 100)):
        steps = [("start", None)] + [("end", 1)] * 4 + [("done", None)] * (4 if c != "silent" else 2)
        for k, (what, tasks) in enumerate(steps):
            kind = None if what == "start" else kinds[(k - 1) % 4]
            rows.append((n, 1000 + k * gap, "v", c, what, kind, tasks))
            n += 1
    # the end of one kind comes four times, then late ones of the others with tasks
    for k, (what, kind, tasks) in enumerate([("start", None, None)] + [("end", "note", 0)] * 4 + [("end", x, 1) for x in kinds[1:]] + [("done", x, None) for x in kinds[1:]]):
        rows.append((n, 1000 + k * 50, "v", "repeated", what, kind, tasks))
        n += 1
    feed = Feed(spark, tmp_path, "r", rows, schema, 3, (-1, END_MS, "end", "end", "start", None, None))
    got = {r.context: (r.outcome, r.total, r.completed, r.finished_ms) for r in rows_of(spark, tmp_path, "out", processors.round_stream(feed.stream(), "1 second"))}
    got.pop("end", None)
    assert got == {"quick": ("done", 4, 4, 1800), "slow": ("forced", 3, 0, 31000), "silent": ("forced", 4, 2, 31000), "repeated": ("done", 3, 3, 1500)}


def test_kv_changes_across_batches(spark, tmp_path):
    sinks.use_rocksdb(spark)
    schema = "seq long, ts_ms long, vault string, device string, key string, hash string, origin string"
    rows = [(0, 0, "v", "d", "k", "1", "local"), (1, 1, "v", "d", "k", "1", "local"), (2, 2, "v", "d", "k", "2", "remote"),
            (3, 3, "v", "d", "k", "2", "local"), (4, 4, "v", "d", "k", "3", "local"), (5, 5, "v", "d", "q", "3", "local")]
    rows = [(seq, ts_ms + 1, *rest) for seq, ts_ms, *rest in rows]  # the watermark starts at 0
    end = (-1, END_MS, "end", "d", "k", "1", "remote")
    got = rows_of(spark, tmp_path, "out", processors.kv_change_stream(Feed(spark, tmp_path, "kv", rows, schema, 3, end).stream(), "1 second"))
    assert {(r.key, r.seq) for r in got} == {("k", 0), ("k", 4), ("q", 5)}


class Shuffled(Feed):
    """Files of one row each, whose order is shuffled within the lateness."""

    def __init__(self, spark, root, name, rows, schema, lateness_ms, seed, end):
        draw = random.Random(seed)
        at = [c.split()[0] for c in schema.split(", ")].index("ts_ms")
        self.spark, self.path, self.schema = spark, str(root / name), schema + ", ts timestamp"
        for row in [*sorted(rows, key=lambda r: r[at] + draw.randrange(lateness_ms)), end]:
            df = spark.createDataFrame([row], schema).withColumn("ts", F.timestamp_millis("ts_ms"))
            df.coalesce(1).write.mode("append").parquet(self.path)
            time.sleep(0.01)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_arrival_does_not_matter(spark, tmp_path, seed):
    """Two feeds, a row or two per batch, out of order inside the lateness: the result is that of the batch operators."""
    sinks.use_rocksdb(spark)
    draw = random.Random(seed)
    cols = "event_id long, ts_ms long, vault string, device string, path string, op string"
    moves = [(i, 10 + i * 10, draw.random() < 0.5, draw.choice(["modify", "delete"]), f"p{draw.randrange(2)}") for i in range(14)]
    sent = [(i, t, "v", "d", p, op, f"h{i}") for i, t, s, op, p in moves if s]
    back = [(i, t, "v", "d", p, op) for i, t, s, op, p in moves if not s]
    a = Shuffled(spark, tmp_path, "sent", sent, cols + ", hash string", 60, seed, (-1, END_MS, "end", "d", "x", "modify", "h"))
    b = Shuffled(spark, tmp_path, "back", back, cols, 60, seed, (-2, END_MS, "end", "d", "y", "modify"))
    got = rows_of(spark, tmp_path, "out", processors.ack_stream(a.stream(2), b.stream(2), "1 minute", 10**6))
    old = F.lit(0).cast("long").alias("last_time")
    want = acks.match_acks(spark.createDataFrame(sent, cols + ", hash string"), spark.createDataFrame(back, cols).select("*", old)).collect()
    assert {(r.event_id, r.effect, r.hash) for r in got if r.effect != "timeout" and r.vault != "end"} == {(r.event_id, r.effect, r.hash) for r in want}

    o = Shuffled(spark, tmp_path, "o", [("a", 10, 3), ("b", 20, 2)], "session_id string, ts_ms long, total_chunks long", 60, seed, ("end", END_MS * 10, 1))
    frames = [("a", 11, 0), ("a", 12, 0), ("b", 23, 1), ("x", 14, 0), ("a", 25, 2), ("a", 36, 1), ("b", 37, 7)]
    f = Shuffled(spark, tmp_path, "f", frames, "session_id string, ts_ms long, chunk_index long", 60, seed, ("end", END_MS * 10, 0))
    rows = rows_of(spark, tmp_path, "chunks", processors.chunk_stream(o.stream(), f.stream(2), "1 minute"))
    steps = sorted((r.session_id, r.received, r.status) for r in rows if r.session_id != "end")
    assert steps == [("a", 0, "pending"), ("a", 1, "pending"), ("a", 2, "pending"), ("a", 3, "success"), ("b", 0, "pending"), ("b", 1, "error"), ("b", 1, "pending"), ("x", 0, "error")]


def test_waiting_renames_have_a_life(spark, tmp_path):
    sinks.use_rocksdb(spark)
    schema = "event_id long, ts_ms long, vault string, device string, old_path string, path string, ack boolean"
    rows = [(1, 1, "v", "d", "a", "b", False), (2, 10, "v", "d", "c", "e", False), (3, 150, "v", "d", "", "", True), (4, 900, "v", "d", "f", "g", False)]
    ends = [(-1, END_MS, "end", "d", "o", "n", False), (-2, END_MS, "end", "d", "o", "n", True)]
    both = Feed(spark, tmp_path, "moves", rows, schema, 2, ends).stream()
    got = rows_of(spark, tmp_path, "out", processors.rename_ack_stream(both.filter("NOT ack"), both.filter("ack"), "1 second", 145))
    assert {(r.event_id, r.acked_at) for r in got if r.vault != "end"} == {(1, None), (2, 150), (4, None)}


def test_replayed_batches_change_nothing(spark, tmp_path):
    events = random_events(random.Random(27), 80, 3)
    feed = Feed(spark, tmp_path, "ev", events, EVENTS, 3)
    out = str(tmp_path / "state")
    sinks.write_state_changes(feed.stream(), out, out + "-check").awaitTermination()
    base = spark.createDataFrame([], "vault string, device string, path string, hash string, mtime long, size long")
    first = sorted(map(tuple, feeds.state_after(base, sinks.read_state_changes(spark, out)).collect()))
    # a second run from the start writes the same batches again
    sinks.write_state_changes(feed.stream(), out, out + "-check2").awaitTermination()
    assert sorted(map(tuple, feeds.state_after(base, sinks.read_state_changes(spark, out)).collect())) == first and first
    for upto in (0, 1):  # folded batches go, later ones stay
        sinks.fold_state_changes(spark, out, upto)
        folded = sinks.read_state_changes(spark, out)
        assert sorted(map(tuple, feeds.state_after(base, folded).collect())) == first
        assert sorted(p.name for p in (tmp_path / "state").glob("batch=*")) == [f"batch={i}" for i in range(upto + 1, 3)]
        assert [p.name for p in (tmp_path / "state-folds").iterdir()] == [f"upto={upto}"]


def test_readers_keep_their_version_of_the_state(spark, tmp_path):
    """With a grace, a reader from before a fold reads on after it; a repeated fold writes nothing."""
    feed = Feed(spark, tmp_path, "ev", random_events(random.Random(5), 60, 3), EVENTS, 3)
    out = str(tmp_path / "state")
    sinks.write_state_changes(feed.stream(), out, out + "-check").awaitTermination()
    before = sinks.read_state_changes(spark, out)
    sinks.fold_state_changes(spark, out, 1, grace_ms=3_600_000)
    fold = tmp_path / "state-folds" / "upto=1"
    written = sorted((p.name, p.stat().st_mtime_ns) for p in fold.iterdir())
    first = sorted(map(str, before.collect()))
    assert first and sorted(map(str, sinks.read_state_changes(spark, out).collect())) == first
    sinks.fold_state_changes(spark, out, 1, grace_ms=3_600_000)
    assert sorted((p.name, p.stat().st_mtime_ns) for p in fold.iterdir()) == written and len(list((tmp_path / "state").glob("batch=*"))) == 3
    sinks.drop_folded(spark, out)
    assert [p.name for p in (tmp_path / "state").glob("batch=*")] == ["batch=2"]
    assert sorted(map(str, sinks.read_state_changes(spark, out).collect())) == first


def test_log_ids_have_a_life(spark, tmp_path):
    """Entries come out once and are forgotten: the state holds few ids of a long feed; a row after that begins anew."""
    schema = "seq long, id string, at timestamp, ts long, type string, action string, path string, status string, progress int, message string, vault string"
    rows = []
    for i in range(400):
        for k, status in enumerate(("pending", "success")):
            t = i * 60_000 + k * 1000
            rows.append((2 * i + k, f"s{i}", t, "send", status))
    rows.append((900, "s0", 400 * 60_000, "receive", "pending"))
    rows.append((999, "end", 10**9, "send", "pending"))
    table = spark.createDataFrame([(q, i, t, k, s) for q, i, t, k, s in rows], "seq long, id string, ts long, type string, status string")
    full = table.select(
        "seq", "id", F.timestamp_millis("ts").alias("at"), "ts", "type", F.lit("NoteModify").alias("action"), F.lit(None).cast("string").alias("path"), "status",
        F.lit(None).cast("int").alias("progress"), F.lit(None).cast("string").alias("message"), F.lit("v").alias("vault"),
    )
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    full.orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 50).parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    query = sinks.write_append(feeds.final_log(stream, 30_000, "10 seconds"), out, out + "-check")
    query.awaitTermination()
    got = sorted((r.id, r.status, r.first_seq) for r in spark.read.parquet(out).collect())
    want = sorted([(f"s{i}", "success", 2 * i) for i in range(400)] + [("s0", "pending", 900)])
    assert got == want
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) < 120
    batch = feeds.final_log(full, 30_000).filter("id <> 'end'").collect()
    assert sorted((r.id, r.status, r.first_seq) for r in batch) == want


@pytest.mark.parametrize("batches", [1, 3])
def test_state_stream_finds_hashes_that_events_lack(spark, tmp_path, batches):
    """A rename and a change of time without a hash, in any batch, as ``apply_events`` has them."""
    from driftline.operators.state import apply_events

    state_schema = "vault string, device string, path string, hash string, mtime long, size long"
    base = spark.createDataFrame([("v", "d", "a.md", "H1", 1, 1), ("v", "d", "b.md", "H2", 1, 1), ("v", "d", "c.md", "H3", 1, 1)], state_schema)
    names = [c.split()[0] for c in EVENTS.split(", ")]

    def event(i, op, path, old=None, hash_=None):
        row = {"event_id": i, "ts_ms": i * 10, "vault": "v", "device": "d", "op": op, "path": path, "old_path": old, "content_hash": hash_, "mtime": 100 + i, "size": 5}
        return tuple(row[n] for n in names)

    events = [
        event(1, "rename", "a2.md", "a.md"), event(2, "mtime", "b.md"), event(3, "modify", "c.md", hash_="H9"),
        event(4, "mtime", "c.md"), event(5, "mtime", "new.md"), event(6, "mtime", "a2.md"),
    ]
    out = str(tmp_path / "state")
    sinks.write_state_changes(Feed(spark, tmp_path, "ev", events, EVENTS, batches).stream(), out, out + "-check").awaitTermination()
    got = sorted(map(tuple, feeds.state_after(base, sinks.read_state_changes(spark, out)).collect()))
    assert got == sorted(map(tuple, apply_events(base, spark.createDataFrame(events, EVENTS)).collect()))
    assert {r[2]: r[3] for r in got} == {"a2.md": "H1", "b.md": "H2", "c.md": "H9"}


def test_live_change_stream(spark, tmp_path):
    events = random_events(random.Random(29), 100, 4)
    ends = [(-k, END_MS, "end", "d", op, f"end{k}", None, None, 0, 0) for k, op in ((1, "delete"), (2, "modify"))]
    feed = Feed(spark, tmp_path, "ev", events, EVENTS, 2, ends)
    remote_schema = "vault string, device string, path string, ts_ms long, op string"
    remote = [("v", "d", f"p{i % 4}.md", 40 * i, "delete") for i in range(5)]
    r = Feed(spark, tmp_path, "re", remote, remote_schema, 1, ("end", "d", "z", END_MS, "delete"))
    rows_of(spark, tmp_path, "unechoed", feeds.echo_stream(feed.stream(), r.stream(), "1 second"))
    quiet = read_changes(spark, str(tmp_path / "unechoed"), schema=EVENTS + ", ts timestamp")
    got = rows_of(spark, tmp_path, "out", live_change.settle(quiet, RuleBook(), 20, "1 day"))
    from driftline.operators.acks import echo_window
    from driftline.operators.state import classify_renames

    df = spark.createDataFrame(events, EVENTS)
    kept = windows.debounce(echo_window(df, spark.createDataFrame(remote, remote_schema)), 20)
    want = classify_renames(kept, RuleBook()).collect()
    assert sorted((x.event_id, x.op, x.path) for x in got if x.vault != "end") == sorted((x.event_id, x.op, x.path) for x in want)
    assert live_change.run(df, spark.createDataFrame(remote, remote_schema), RuleBook(), 20).count() > 0
