"""Operators against brute force on small tables, invariants, empty inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import acks, aggregates, compare, history, ordering, reconcile, sets, state, timeline, windows
from driftline.operators.rules import RuleBook
from driftline.plans import sync_round

BASE = "vault string, device string, path string, hash string, mtime long, size long"
LISTING = "vault string, device string, kind string, path string, path_hash string, content_hash string, mtime long, ctime long, size long"
SERVER = "vault string, device string, kind string, path string, content_hash string, mtime long, is_deleted boolean"
EVENTS = "event_id long, ts_ms long, vault string, device string, op string, path string, old_path string, content_hash string, mtime long, size long"


def listing_row(path, h, mtime, kind="note", size=1):
    return ("v", "d", kind, path, None, h, mtime, mtime, size)


def test_running_with_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", t, rng.choice([None, 1, -2, 5])) for t in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, x long")
    for inclusive in (True, False):
        got = timeline.running(
            df, ["k"], timeline.time_bucket(F.col("t"), 20), ["t"],
            {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x")), "la": ("last", F.col("x")), "n": ("total", F.lit(1))},
            inclusive,
        ).collect()
        assert len(got) == len(rows)
        for r in got:
            seen = [x for k, t, x in rows if k == r.k and (t <= r.t if inclusive else t < r.t) and x is not None]
            assert (r.s, r.lo, r.hi, r.la) == (sum(seen), min(seen, default=None), max(seen, default=None), seen[-1] if seen else None)
            assert r.n == sum(k == r.k for k, _, _ in rows)


def test_global_rank_and_deep_pages(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), (F.col("id") % 3).alias("y")).repartition(7)
    ranked = timeline.global_rank(df, [F.col("y").desc(), F.col("x").asc()], "r").collect()
    want = sorted(((r.y, r.x) for r in ranked), key=lambda p: (-p[0], p[1]))
    assert [want[r.r - 1] for r in ranked] == [(r.y, r.x) for r in ranked] and sorted(r.r for r in ranked) == list(range(1, 1001))
    for page in (1, 30):
        got = windows.paginate(df, [F.col("x").asc()], page, 30).collect()
        assert sorted(r.x for r in got) == list(range(1000))[30 * (page - 1) : 30 * page]


def test_pages_by_counting(spark, monkeypatch):
    monkeypatch.setattr(timeline, "SKIP", 5)
    rng = random.Random(8)
    names = ["", "a", "a\0", "ab", "abcdefg", "abcdefgh", "abcdefghijklmnopq", "é", "zz", None, "abcdefghijklmnopr"]
    rows = [(rng.choice(names), rng.choice([None, True, False]), rng.choice([0, 1, -(1 << 63), (1 << 63) - 1, None, *range(50)]), rng.choice([0.5, 1.5]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "s string, b boolean, n long, x double, i long").repartition(2)
    By = timeline.By
    orders = [
        [By(F.col("s")), By(F.col("n"), True), By(F.col("i"))], [By(F.col("b"), True), By(F.col("s"), True), By(F.col("i"), True)],
        [By(F.col("n")), By(F.col("x")), By(F.col("i"))], [By(F.col("x")), By(F.col("i"))],
    ]
    for keys in orders:
        want = [r.i for r in df.orderBy(*[k.sort for k in keys]).collect()]
        for page, size in ((1, 7), (40, 10), (91, 10)):
            got = [r.i for r in windows.paginate(df, keys, page, size).collect()]
            assert got == want[size * (page - 1) : size * page]
    one = df.withColumn("s", F.lit("same")).withColumn("n", F.lit(1))
    assert len(windows.paginate(one, [By(F.col("s")), By(F.col("n"))], 50, 10).collect()) == 10
    assert windows.paginate(df.limit(0), [By(F.col("s"))], 1, 10).collect() == []


def test_top_n_of_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("g"), ((F.col("id") * 7907) % 2000).alias("x"))
    got = timeline.top_n_per_group(df, ["g"], [F.col("x").asc()], 25, ["x"]).collect()
    for g in ("hot", "cold"):
        allx = sorted(r.x for r in df.filter(F.col("g") == g).collect())
        assert sorted(r.x for r in got if r.g == g) == allx[:25]


CASES = [  # client (hash, mtime), base, server (hash, mtime, deleted), reported, strategy, outcome, conflict
    (None, None, ("s", 1, True), False, "", "None", False),
    (("a", 1), "a", ("s", 1, True), False, "", "Delete", False),
    (("b", 1), "a", ("s", 1, True), False, "", "NeedPush", False),
    (("b", 1), None, ("b", 1, True), False, "", "NeedPush", False),
    (("a", 1), None, None, False, "", "NeedPush", False),
    (None, "a", ("a", 1, False), True, "", "ServerDelete", False),
    (None, "a", ("a", 1, False), False, "", "Modify", False),
    (("a", 1), None, ("a", 1, False), False, "", "None", False),
    (("a", 1), "z", ("a", 2, False), False, "", "Mtime", False),
    (("a", 9), "a", ("b", 1, False), False, "", "Modify", False),
    (("a", 1), "b", ("b", 9, False), False, "", "NeedPush", False),
    (("a", 9), "z", ("b", 1, False), False, "", "NeedPush", True),
    (("a", 1), "z", ("b", 1, False), False, "", "Modify", True),
    (("a", 1), None, ("b", 9, False), False, "", "Modify", True),
    (("a", 9), None, ("b", 1, False), False, "newTimeMerge", "Merge", True),
    (("a", 1), None, ("b", 9, False), False, "newTimeMerge", "Modify", True),
    (("a", 1), None, ("b", 9, False), False, "ignoreTimeMerge", "Merge", True),
]


@pytest.mark.parametrize("strategy", reconcile.STRATEGIES)
def test_reconcile_rules(spark, strategy):
    cases = [c for c in CASES if c[4] == strategy]
    client = [listing_row(f"p{i}", *c[0]) for i, c in enumerate(cases) if c[0]]
    base = [("v", "d", f"p{i}", c[1], 0, 0) for i, c in enumerate(cases) if c[1]]
    server = [("v", "d", "note", f"p{i}", *c[2]) for i, c in enumerate(cases) if c[2]]
    gone = [("v", "d", f"p{i}") for i, c in enumerate(cases) if c[3]]
    out = reconcile.reconcile(
        spark.createDataFrame(client, LISTING), spark.createDataFrame(base, BASE), spark.createDataFrame(server, SERVER),
        strategy, spark.createDataFrame(gone, "vault string, device string, path string"),
    )
    got = {r.path: (r.outcome, r.is_conflict) for r in out.collect()}
    assert got == {f"p{i}": (c[5], c[6]) for i, c in enumerate(cases)}


def test_cover_lets_the_server_win_for_config(spark):
    client = spark.createDataFrame([listing_row("c", "a", 9, "config"), listing_row("n", "a", 9), listing_row("x", "q", 1, "config")], LISTING)
    server = spark.createDataFrame([("v", "d", "config", "c", "b", 1, False), ("v", "d", "note", "n", "b", 1, False)], SERVER)
    got = {r.path: r.outcome for r in reconcile.reconcile(client, spark.createDataFrame([], BASE), server, cover=True).collect()}
    assert got == {"c": "Modify", "n": "NeedPush", "x": "NeedPush"}
    with pytest.raises(ValueError):
        reconcile.reconcile(client, spark.createDataFrame([], BASE), server, "other")


def test_per_device_gives_each_device_all_rows(spark):
    server = spark.createDataFrame([("v", f"p{i}") for i in range(50)] + [("w", "q")], "vault string, path string")
    devices = spark.createDataFrame([("v", "a"), ("v", "b"), ("w", "c"), ("v", "a")], "vault string, device string")
    got = reconcile.per_device(server, devices)
    assert {(r.device, r.n) for r in got.groupBy("device").agg(F.count("*").alias("n")).collect()} == {("a", 50), ("b", 50), ("c", 1)}


def test_equal_listings_need_nothing(spark):
    rows = [listing_row(f"p{i}", f"h{i}", i) for i in range(40)]
    client = spark.createDataFrame(rows, LISTING)
    server = client.select("vault", "device", "kind", "path", "content_hash", "mtime", F.lit(False).alias("is_deleted"))
    out = reconcile.reconcile(client, spark.createDataFrame([], BASE), server)
    assert {r.outcome for r in out.collect()} == {"None"}


def random_events(rng, n=400, paths=6):
    out = []
    for i in range(n):
        op = rng.choice(["modify", "modify", "create", "delete", "rename"])
        p, q = rng.sample(range(paths), 2)
        out.append((i, rng.randrange(0, 4000), "v", "d", op, f"p{p}.md", f"p{q}.md" if op == "rename" else None, None if op == "delete" else f"h{i}", i, i))
    return out


def test_apply_events_like_a_map(spark):
    rng = random.Random(3)
    events = random_events(rng)
    start = {f"p{i}.md": ("s", 1, 1) for i in range(3)}
    model = dict(start)
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        if e[4] == "rename":
            model.pop(e[6], None)
        if e[4] == "delete":
            model.pop(e[5], None)
        else:
            model[e[5]] = (e[7], e[8], e[9])
    df, st = spark.createDataFrame(events, EVENTS), spark.createDataFrame([("v", "d", p, *x) for p, x in start.items()], BASE)
    after = state.apply_events(st, df)
    assert {r.path: (r.hash, r.mtime, r.size) for r in after.collect()} == model
    # what the events left is what is there: nothing is deleted
    listing = after.select("vault", "device", "path")
    assert compare.detect_deleted(after, listing, RuleBook()).count() == 0
    # applying them again changes nothing
    assert sorted(map(tuple, state.apply_events(after, df).collect())) == sorted(map(tuple, after.collect()))


def test_apply_events_without_hashes(spark):
    st = spark.createDataFrame([("v", "d", "a", "ha", 1, 1), ("v", "d", "m", "hm", 1, 4)], BASE)
    ev = spark.createDataFrame(
        [(1, 10, "v", "d", "rename", "b", "a", None, 10, 1), (2, 11, "v", "d", "mtime", "m", None, None, 99, None), (3, 12, "v", "d", "mtime", "none", None, None, 9, None)],
        EVENTS,
    )
    got = {r.path: (r.hash, r.mtime, r.size) for r in state.apply_events(st, ev).collect()}
    assert got == {"b": ("ha", 10, 1), "m": ("hm", 99, 4)}


def test_debounce_like_timers(spark):
    rng = random.Random(5)
    events = random_events(rng, 300, 4)
    df = spark.createDataFrame(events, EVENTS)
    assert windows.debounce(df, 0).count() == len(events)
    for delay in (1, 7, 60):
        points = sorted((t, i, 1, p) for i, t, _, _, op, p, q, *_ in events)
        points += [(t, i, 0, q) for i, t, _, _, op, p, q, *_ in events if op == "rename"]
        points.sort()
        want = set()
        for n, (t, i, real, key) in enumerate(points):
            later = next((x for x in points[n + 1 :] if x[3] == key), None)
            if real and (later is None or later[0] - t > delay):
                want.add(i)
        assert {r.event_id for r in windows.debounce(df, delay).collect()} == want


def test_raw_events_wait_longer(spark):
    rows = [(1, 0, "v", "d", "modify", ".c/x", None, "h", 0, 0), (2, 1200, "v", "d", "modify", ".c/x", None, "h", 0, 0), (3, 0, "v", "d", "modify", "n.md", None, "h", 0, 0), (4, 1200, "v", "d", "modify", "n.md", None, "h", 0, 0)]
    df = spark.createDataFrame(rows, EVENTS)
    got = windows.debounce(df, 1000, F.col("path").startswith(".c/")).collect()
    assert {r.event_id for r in got} == {2, 3, 4}


def test_acks_like_a_pending_map(spark):
    rng = random.Random(7)
    moves = [(i, rng.randrange(0, 20_000), rng.choice(["send", "ack"]), rng.choice(["modify", "delete"]), f"p{rng.randrange(4)}") for i in range(500)]
    order = sorted(moves, key=lambda m: (m[1], m[2] == "ack", m[0]))
    puts, drops, want = {}, set(), {}
    for i, _, who, op, p in order:
        if who == "send" and op == "modify":
            puts[p] = f"h{i}"
            drops.discard(p)
        elif who == "send":
            puts.pop(p, None)
            drops.add(p)
        elif op == "modify":
            h = puts.pop(p, None)
            want[i] = ("put", h) if h else ("none", None)
        else:
            want[i] = ("remove" if p in drops else "none", None)
            drops.discard(p)
    cols = "event_id long, ts_ms long, vault string, device string, path string, op string"
    sent = spark.createDataFrame([(i, t, "v", "d", p, op, f"h{i}") for i, t, w, op, p in moves if w == "send"], cols + ", hash string")
    got = spark.createDataFrame([(i, t, "v", "d", p, op, t) for i, t, w, op, p in moves if w == "ack"], cols + ", last_time long")
    out = acks.match_acks(sent, got, bucket_ms=700)
    assert {r.event_id: (r.effect, r.hash) for r in out.collect()} == want


def test_rename_queue(spark):
    rng = random.Random(9)
    moves = [(i, rng.randrange(0, 5000), rng.random() < 0.55, f"d{rng.randrange(2)}") for i in range(400)]
    want, queues = {i: None for i, _, is_ack, _ in moves if not is_ack}, {"d0": [], "d1": []}
    for i, t, is_ack, d in sorted(moves, key=lambda m: (m[1], m[2], m[0])):
        if not is_ack:
            queues[d].append(i)
        elif queues[d]:
            want[queues[d].pop(0)] = t
    r = spark.createDataFrame([(i, t, "v", d, "o", "n") for i, t, a, d in moves if not a], "event_id long, ts_ms long, vault string, device string, old_path string, path string")
    a = spark.createDataFrame([(i, t, "v", d) for i, t, a, d in moves if a], "event_id long, ts_ms long, vault string, device string")
    assert {x.event_id: x.acked_at for x in acks.match_rename_acks(r, a, bucket_ms=300).collect()} == want


def test_echo_window_like_a_scan(spark):
    rng = random.Random(11)
    ops = ["delete", "rename", "modify"]
    local = [(i, rng.randrange(0, 30_000), "v", "d", f"p{rng.randrange(3)}", rng.choice(ops)) for i in range(300)]
    remote = [("v", "d", f"p{rng.randrange(3)}", rng.randrange(0, 30_000), rng.choice(ops)) for _ in range(60)]
    want = {i for i, t, _, _, p, op in local if op == "modify" or not any(rp == p and rop == op and t - 500 <= rt <= t for _, _, rp, rt, rop in remote)}
    l = spark.createDataFrame(local, "event_id long, ts_ms long, vault string, device string, path string, op string")
    r = spark.createDataFrame(remote, "vault string, device string, path string, ts_ms long, op string")
    assert {x.event_id for x in acks.echo_window(l, r).collect()} == want


def test_shadowed_writes_like_a_scan(spark):
    events = random_events(random.Random(12), 250, 4)
    renames = [(e[1], e[5]) for e in events if e[4] == "rename"]
    for delay in (0, 5, 80):
        want = {e[0] for e in events if delay == 0 or e[4] not in ("modify", "create") or not any(p == e[5] and e[1] - delay <= t <= e[1] for t, p in renames)}
        got = acks.drop_shadowed(spark.createDataFrame(events, EVENTS), delay)
        assert {r.event_id for r in got.collect()} == want


def test_a_rename_survives_the_write_it_causes(spark):
    from driftline.plans import live_change

    rows = [(1, 1000, "v", "d", "rename", "b.md", "a.md", "h", 1, 1), (2, 1001, "v", "d", "modify", "b.md", None, "h", 1, 1)]
    none = spark.createDataFrame([], "vault string, device string, path string, ts_ms long, op string")
    out = live_change.run(spark.createDataFrame(rows, EVENTS), none, RuleBook(), 500).collect()
    assert [(r.event_id, r.op, r.path, r.old_path) for r in out] == [(1, "rename", "b.md", "a.md")]


def test_log_order_equals_comparator(spark):
    rng = random.Random(13)
    rows = [(i, rng.randrange(0, 9000), rng.choice(["summary", "note", "file"])) for i in range(200)]

    def cmp(a, b):
        if abs(a[1] - b[1]) <= 2000 and (a[2] == "summary") != (b[2] == "summary"):
            return -1 if a[2] == "summary" else 1
        return b[1] - a[1]

    got = ordering.order_log(spark.createDataFrame(rows, "first_seq long, timestamp long, category string")).collect()
    assert len(got) == 200
    for a, b in itertools.pairwise([(r.first_seq, r.timestamp, r.category) for r in got]):
        assert cmp(a, b) <= 0


def test_merge_log_status(spark):
    rows = [
        (1, "a", 10, "send", "FileUpload", "p", "pending", 5, "m", None), (2, "a", 20, "send", "FileUpload", None, "success", 3, None, "v"),
        (3, "a", 30, "send", "FileUpload", None, "pending", 9, "n", None), (4, "b", 1, "info", "X", None, None, None, None, None),
        (5, "b", 2, "info", "X", None, "pending", None, None, None), (6, "c", 1, "info", "X", None, "pending", None, None, None),
        (7, "c", 2, "info", "SyncSummary", None, None, None, None, None), (8, "a", 40, "send", "FileUpload", None, "error", None, None, None),
    ]
    df = spark.createDataFrame(rows, "seq long, id string, ts long, type string, action string, path string, status string, progress int, message string, vault string")
    got = {r.id: r for r in aggregates.merge_log(df).collect()}
    assert (got["a"].status, got["a"].timestamp, got["a"].progress, got["a"].path, got["a"].message, got["a"].vault) == ("error", 10, 9, "p", "n", "v")
    assert got["b"].status == "success" and got["c"].status == "pending" and got["c"].category == "summary"


def test_diff_golden(spark):
    df = spark.createDataFrame([(1, 1, [(0, "222222233333"), (1, " 测试一下")]), (1, 2, [(0, "a\nb\n"), (-1, "old"), (1, "\nnew\n"), (0, "")])], "note_id long, version long, diffs array<struct<type int, text string>>")
    texts = {r.version: (r.text_before, r.text_after) for r in history.rebuild_versions(df).collect()}
    assert texts == {1: ("222222233333", "222222233333 测试一下"), 2: ("a\nb\nold", "a\nb\n\nnew\n")}
    seg = history.diff_to_lines(df)
    two = [(r.line_no, r.segment_no, r.type, r.text) for r in seg.filter("version = 2").orderBy("line_no", "segment_no").collect()]
    assert two == [(0, 0, 0, "a"), (1, 0, 0, "b"), (2, 0, -1, "old"), (3, 0, 1, "new"), (4, 0, 0, "")]
    lines = {r.line_no: (r.has_change, r.line_number) for r in history.number_diff_lines(seg).filter("version = 2").collect()}
    assert lines == {0: (False, 1), 1: (False, 2), 2: (True, None), 3: (True, 3), 4: (False, 4)}
    changed = history.changed_lines(history.number_diff_lines(seg)).filter("version = 2").collect()
    assert {(r.line_no, r.is_pure_delete) for r in changed} == {(2, True), (3, False)}


def test_order_versions(spark):
    df = spark.createDataFrame([(v,) for v in ["1.2", "v1.10.0", "1.9.9", "2.0", "1.2.0.1", "x", "V2.0.1"]], "version string")
    assert [r.version for r in ordering.order_versions(df, "v2.0.1").collect()] == ["2.0", "v1.10.0", "1.9.9", "1.2.0.1", "1.2", "x"]


def test_progress(spark):
    rounds = "vault string, device string, sync_enabled boolean, config_enabled boolean, preview boolean, total_chunks long, done_chunks long, open_sessions long"
    modules = "vault string, device string, kind string, total long, completed long, ended boolean"
    r = spark.createDataFrame([("v", "a", True, True, False, 10, 5, 0), ("v", "b", True, False, True, 0, 0, 0), ("v", "c", False, False, False, 0, 0, 0)], rounds)
    rows = [("v", "a", "note", 4, 2, True), ("v", "a", "file", 10, 5, True), ("v", "a", "config", 0, 0, True), ("v", "a", "folder", 2, 2, False)]
    rows += [("v", "b", "note", 100, 95, True), ("v", "b", "folder", 0, 0, True), ("v", "b", "file", 9, 0, False), ("v", "c", "note", 1, 1, True)]
    got = {x.device: x.percent for x in aggregates.progress(spark.createDataFrame(rows, modules), r).collect()}
    assert got == {"a": 50, "b": 100, "c": 0}


def test_cascade_does_not_take_siblings(spark):
    rows = [("v", "d", p, "h", 0, 0) for p in ("a", "a/b", "a/b/c", "ab", "ab/c", "z/a/b")]
    removed = spark.createDataFrame([("v", "d", "a/b"), ("v", "d", "ab"), ("w", "d", "z")], "vault string, device string, path string")
    left = compare.cascade_delete(spark.createDataFrame(rows, BASE), removed)
    assert {r.path for r in left.collect()} == {"a", "z/a/b"}


def test_empty_inputs(spark):
    base, listing = spark.createDataFrame([], BASE), spark.createDataFrame([], LISTING)
    server, events = spark.createDataFrame([], SERVER), spark.createDataFrame([], EVENTS)
    keys = "vault string, device string, path string"
    none = spark.createDataFrame([], keys)
    outs = [
        compare.reuse_hashes(listing, base), compare.detect_deleted(base, listing, RuleBook()), reconcile.reconcile(listing, base, server),
        state.apply_events(base, events), state.commit_round(base, base, base, none), windows.debounce(events, 5), windows.latest_per_path(events),
        compare.cascade_delete(base, none), compare.commit_scanned(base, base), sets.set_delta(none, none), windows.cap_per_kind(listing, 5),
        timeline.global_rank(none, [F.col("path")]),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)
    assert aggregates.page_totals(none, 10).collect()[0].total_pages == 1


def test_whole_round(spark):
    """Scan, compare, decide, commit: the plan of a round on one small device."""
    listing = spark.createDataFrame([listing_row("n.md", None, 5, size=3), listing_row("old.md", None, 1, size=2), listing_row("skip/x.md", None, 1)], LISTING)
    content = spark.createDataFrame([("v", "d", "n.md", "new"), ("v", "d", "old.md", "??")], "vault string, device string, path string, text string")
    base = spark.createDataFrame([("v", "d", "old.md", "kept", 1, 2), ("v", "d", "gone.md", "g", 1, 1), ("v", "d", "skip/y.md", "y", 1, 1)], BASE)
    server = spark.createDataFrame([("v", "note", "old.md", "kept", 1, 1, 2, False, 1), ("v", "note", "gone.md", "g", 1, 1, 1, False, 1)],
                                   "vault string, kind string, path string, content_hash string, mtime long, ctime long, size long, is_deleted boolean, last_time long")
    from driftline.operators.rules import Rule

    done = sync_round.run(listing, content, base, server, RuleBook(folders=(Rule("skip"),)), offline_delete=True)
    assert {r.path: r.outcome for r in done.decisions.collect()} == {"n.md": "NeedPush", "old.md": "None", "gone.md": "ServerDelete"}
    assert {r.path: r.hash for r in done.state.collect()} == {"n.md": str(ord("n") * 961 + ord("e") * 31 + ord("w")), "old.md": "kept", "skip/y.md": "y"}
    assert done.counts.collect()[0].need_upload == 1


def test_round_sees_what_is_new_and_what_is_there(spark):
    """Two devices: rows after the watermark, rows of present paths, nothing under an exclude rule."""
    from driftline.operators.rules import Rule

    def of(path, last, kind="note"):
        return ("v", kind, path, "h", 1, 1, 2, False, last)

    server = spark.createDataFrame([of("new.md", 50), of("old.md", 5), of("mine.md", 5), of("skip/x.md", 60), of("f.png", 1, "file")],
                                   "vault string, kind string, path string, content_hash string, mtime long, ctime long, size long, is_deleted boolean, last_time long")
    devices = spark.createDataFrame([("v", "d"), ("v", "e")], "vault string, device string")
    marks = spark.createDataFrame([("v", "d", "note", 10), ("v", "d", "file", 10), ("v", "e", "note", 55)], "vault string, device string, kind string, last_time long")
    present = spark.createDataFrame([("v", "d", "mine.md"), ("v", "d", "new.md")], "vault string, device string, path string")
    got = sorted((r.device, r.path) for r in reconcile.per_device(server, devices, marks, present).collect())
    assert got == [("d", "mine.md"), ("d", "new.md"), ("d", "skip/x.md"), ("e", "f.png"), ("e", "skip/x.md")]
    listing = spark.createDataFrame([listing_row("mine.md", "h", 1, size=2)], LISTING)
    content = spark.createDataFrame([("v", "d", "mine.md", "x")], "vault string, device string, path string, text string")
    base = spark.createDataFrame([("v", "d", "mine.md", "h", 1, 2)], BASE)
    done = sync_round.run(listing, content, base, server, RuleBook(folders=(Rule("skip"),)), watermarks=marks)
    assert {r.path: r.outcome for r in done.decisions.collect()} == {"new.md": "Modify", "mine.md": "None"}


def test_incremental_round_with_config_and_folders(spark):
    """Config files go by their own rules; what is gone is reported as missing; only what changed since the watermark is sent."""
    from driftline.operators.rules import Rule

    rows = [
        listing_row("old.md", None, 5), listing_row("new.md", None, 50), listing_row("skip/a.md", None, 60),
        listing_row(".conf/app.json", None, 50, "config"), listing_row(".conf/notes.txt", None, 50, "config"),
        listing_row(".conf/plugins/p/main.js", None, 50, "config"), listing_row(".conf/plugins/q/main.js", None, 50, "config"), listing_row("sub", None, 0, "folder"),
    ]
    listing = spark.createDataFrame(rows, LISTING)
    content = listing.select("vault", "device", "path", F.lit("x").alias("text"))
    base = spark.createDataFrame([("v", "d", p, "h", 5, 1) for p in ("old.md", "gone.md", "skip/gone.md", ".conf/gone.json", ".conf/plugins/q/gone.js")], BASE)
    server = spark.createDataFrame([], "vault string, kind string, path string, content_hash string, mtime long, ctime long, size long, is_deleted boolean, last_time long")
    marks = spark.createDataFrame([("v", "d", "note", 10)], "vault string, device string, kind string, last_time long")
    known = spark.createDataFrame([("v", "d", p) for p in ("sub", "lost", "skip/lost")], "vault string, device string, path string")
    scope = sync_round.ConfigScope(".conf", book=RuleBook(folders=(Rule(".conf/plugins/q"),)))
    book = RuleBook(folders=(Rule("skip"),))
    done = sync_round.run(listing, content, base, server, book, watermarks=marks, incremental=True, folder_state=known, config=scope)
    assert {r.path for r in done.manifest.collect()} == {"new.md", ".conf/app.json", ".conf/plugins/p/main.js"}
    assert {(r.kind, r.path) for r in done.missing.collect()} == {("note", "gone.md"), ("config", ".conf/gone.json")}
    assert {(r.path, r.change) for r in done.folders.collect()} == {("lost", "missing")} and done.deleted.collect() == []
    assert {r.path: r.outcome for r in done.decisions.collect()} == dict.fromkeys(["new.md", ".conf/app.json", ".conf/plugins/p/main.js"], "NeedPush")
    full = sync_round.run(listing, content, base, server, book, offline_delete=True, config=scope)
    assert {r.path for r in full.deleted.collect()} == {"gone.md", ".conf/gone.json"} and full.folders is None and full.missing.collect() == []
