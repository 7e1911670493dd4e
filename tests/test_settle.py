"""Acknowledgements and pushes against a plain state machine."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import acks, timeline

SENT = "event_id long, ts_ms long, vault string, device string, path string, op string, hash string, mtime long, size long"
PUSHED = SENT + ", last_time long"
ACKED = "event_id long, ts_ms long, vault string, device string, path string, op string, last_time long"
STATE = "vault string, device string, path string, hash string, mtime long, size long"
STEPS = {"send": 0, "push": 1, "ack": 2}


def machine(events, start):
    """Events as (source, event_id, ts, path, op, hash, mtime, size) in any order; effects, state and what waits."""
    state, puts, drops, effects = dict(start), {}, set(), {}
    for source, event, ts, path, op, h, mtime, size in sorted(events, key=lambda e: (e[2], STEPS[e[0]], e[1])):
        effect = ("none", None, None, None)
        if source == "send" and op == "delete":
            puts.pop(path, None)
            drops.add(path)
        elif source == "send":
            drops.discard(path)
            puts[path] = (h, mtime, size)
        elif source == "ack" and op == "delete":
            if path in drops:
                effect = ("remove", None, None, None)
            drops.discard(path)
        elif source == "ack":
            if path in puts:
                effect = ("put", *puts.pop(path))
        elif op == "modify":
            effect = ("put", h, mtime, size)
            puts.pop(path, None)
            drops.discard(path)
        elif op == "mtime":
            if path in puts:
                old = puts.pop(path)
                effect = ("put", old[0], mtime, old[2])
        elif op == "delete":
            effect = ("remove", None, None, None)
            puts.pop(path, None)
        elif op == "update":
            drops.discard(path)
        if effect[0] == "put":
            state[path] = (effect[1], effect[2] or 0, effect[3] or 0)
        elif effect[0] == "remove":
            state.pop(path, None)
        if source != "send":
            effects[source, event] = effect
    waits = {p: ("modify", *v) for p, v in puts.items()} | {p: ("delete", None, None, None) for p in drops if p not in puts}
    return effects, state, waits


@pytest.mark.parametrize("seed,width,most", [(1, 700, 100_000), (2, 10_000, 7), (3, 50, 3)])
def test_settle_is_the_machine(spark, seed, width, most):
    rng = random.Random(seed)
    events = []
    for i in range(600):
        source = rng.choice(["send", "send", "push", "ack", "ack"])
        path = "hot" if rng.random() < 0.6 else f"p{rng.randrange(5)}"
        ops = {"send": ["modify", "create", "delete"], "ack": ["modify", "delete"], "push": ["modify", "mtime", "delete", "update"]}[source]
        events.append((source, i, rng.randrange(4000), path, rng.choice(ops), f"h{i}", rng.choice([None, i]), rng.choice([None, 2 * i])))

    def table(source, schema):
        rows = []
        for s, i, ts, path, op, h, mtime, size in events:
            if s == source:
                rows.append((i, ts, "v", "d", path, op, 9) if source == "ack" else (i, ts, "v", "d", path, op, h, mtime, size, *([9] if source == "push" else [])))
        return spark.createDataFrame(rows, schema).repartition(3)

    sent, pushes, got = table("send", SENT), table("push", PUSHED), table("ack", ACKED)
    start = {"hot": ("s", 1, 1), "p1": ("s", 1, 1), "still": ("s", 1, 1)}
    effects, state, waits = machine(events, start)
    out = acks.settle(sent, got, pushes, width, most)
    assert {(r.source, r.event_id): (r.effect, r.hash, r.mtime, r.size) for r in out.collect()} == effects
    base = spark.createDataFrame([("v", "d", p, *v) for p, v in start.items()], STATE)
    assert {r.path: (r.hash, r.mtime, r.size) for r in acks.apply_effects(base, out).collect()} == state
    left = acks.still_waiting(sent, got, pushes).collect()
    assert {r.path: (r.op, r.hash, r.mtime, r.size) for r in left} == waits
    none = acks.settle(sent.limit(0), got.limit(0), pushes.limit(0))
    assert none.collect() == [] and acks.apply_effects(base, none).count() == 3


def test_a_busy_key_is_cut_in_time(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 5 > 0, "hot").otherwise("cold").alias("k"), (F.col("id") % 1000).alias("ts_ms"))
    rows = timeline.fitted_bucket(df, ["k"], 1000, most=200).groupBy("k", "_fit").count().collect()
    assert sum(r.k == "hot" for r in rows) == 8 and max(r["count"] for r in rows) <= 250
    one = timeline.fitted_bucket(df, ["k"], 1000).select("k", "_fit").distinct().count()
    assert one == 2


def test_acked_renames_move_the_state(spark):
    renames = spark.createDataFrame([(1, 10, "v", "d", "a", "b"), (2, 20, "v", "d", "b", "c"), (3, 30, "v", "d", "x", "y")],
                                    "event_id long, ts_ms long, vault string, device string, old_path string, path string")
    got = spark.createDataFrame([(7, 15, "v", "d"), (8, 25, "v", "d")], "event_id long, ts_ms long, vault string, device string")
    hashes = renames.select("event_id", F.concat(F.lit("h"), "event_id").alias("hash"), F.lit(5).cast("long").alias("mtime"), F.lit(6).cast("long").alias("size"))
    effects = acks.rename_effects(acks.match_rename_acks(renames, got), hashes)
    base = spark.createDataFrame([("v", "d", p, "s", 1, 1) for p in ("a", "x")], STATE)
    assert {r.path: r.hash for r in acks.apply_effects(base, effects).collect()} == {"c": "h2", "x": "s"}
