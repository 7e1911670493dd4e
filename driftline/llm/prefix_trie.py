"""Trie of shared conversation prefixes (operator 11).

A conversation is the sequence of its turns' digests. Sequences are range-partitioned and sorted, so that those with a
common prefix are neighbours, and an edge between neighbours weighs as many turns as they share. Taking a partition's
edges in descending weight, union-find grows components of the sequences that share so many turns; every merge makes a
branching node, and the nodes between two merges of a component have the same members.

What the first and the last sequence of a partition share with others is not known inside it. Nodes that may go on
beyond a boundary are not finished: they and what hangs below them are contracted to one item each, with sums of all
that is finished. The items of neighbouring partitions, again a sorted sequence with edges, are merged in the same way, until one
group is left. An unfinished path has at most one item for each depth, so few rows meet in the end.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import parts_of, stored

#: bytes of a turn's digest
TURN = 16
#: bytes of sequences in a partition, about
PART = 16 << 20
#: partitions whose contracted items are merged in one task
FAN = 256
#: ids in a piece of a node's list of ends
PIECE = 100_000
NODE, ITEM, REF, ENDS = range(4)
SCHEMA = (
    "kind int, part long, seq long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, end_key string, edge long, lens array<long>, key binary, ids binary"
)
TYPES = {
    **dict.fromkeys(["part", "seq", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "edge"], pa.int64()),
    "kind": pa.int32(), "ends_sha256": pa.string(), "end_key": pa.string(), "lens": pa.list_(pa.int64()), "key": pa.binary(), "ids": pa.binary(),
}
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``key`` (16 bytes for each turn, in order) and ``lens`` (code points of each turn's text).

    Turns go by ``turn``, null first, then by the digest of role and text; null roles and texts are empty. Rows without
    a ``conv_id`` belong to no conversation. A conversation is one row of 24 bytes a turn; its texts are not gathered.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.struct("turn", digest.alias("d"), F.length(text).cast("long").alias("n")).alias("t")
    )
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.expr("unhex(array_join(transform(t, x -> x.d), ''))").alias("key"), F.expr("transform(t, x -> x.n)").alias("lens"))


def grafted(seqs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first turns replaced by those of the first conversation of its block of ``every`` ids.

    So many turns as CRC-32 of the id modulo ``most`` says: all if there are fewer, none if there is no such conversation.
    """
    bases = seqs.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.substring("key", 1, TURN * (most - 1)).alias("base_key"), F.slice("lens", 1, most - 1).alias("base_lens")
    )
    rows = seqs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(bases, "base", "left")
    key = f"concat(coalesce(substring(base_key, 1, {TURN} * h), X''), substring(key, {TURN} * h + 1))"
    lens = "concat(coalesce(slice(base_lens, 1, h), array()), slice(lens, h + 1, greatest(size(lens) - h, 0)))"
    return rows.select("conv_id", F.expr(key).alias("key"), F.expr(lens).alias("lens"))


@dataclass(slots=True, eq=False)
class Item:
    """Conversations that share their first ``depth`` turns, with sums over what is finished below that depth."""

    depth: int
    n: int
    first: int
    lens: np.ndarray  # code points of the last text at each depth, from the root
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    end: str | None = None  # digest of the ids that end at ``depth``
    end_key: str | None = None  # or the key by which their pieces are found
    key: bytes | None = None
    open: bool = False
    waiting: list[int] = field(default_factory=list)  # runs (from 0) and entries (from -1 down) whose parent node this is


@dataclass(slots=True, eq=False)
class Run:
    """Nodes with the same members, of depths ``top`` to ``depth``."""

    item_first: int
    top: int
    depth: int
    n: int
    kids: int
    leaves: int
    saved: int
    end: str | None
    end_key: str | None
    lens: np.ndarray
    parent: int | None = None
    seq: int | None = None


def contract(items: list[Item], edges: list[int], open_ends: bool) -> tuple[list[Run], list[Item], list[int], list[tuple[int | None, int | None]]]:
    """Finished runs of nodes, the items that are left, the edges between them, and where each given item's node ended up.

    ``edges[i]`` is the number of turns that items i and i+1 share. With ``open_ends`` the first and last item may go on beyond what
    is given. The last list has (first conversation, null) of the node at an item's depth, or (null, number of the item that is left).
    """
    runs: list[Run] = []
    found: list[tuple[int | None, int | None]] = [(None, None)] * len(items)
    parent = list(range(len(items)))
    for i, item in enumerate(items):
        item.waiting = [~i]
    if open_ends:
        items[0].open = items[-1].open = True

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def lift(c: Item, depth: int) -> None:
        """Finish the nodes of ``c`` below ``depth``; what is left of it is their share in the node there."""
        if c.depth <= depth:
            return
        c.leaves = c.leaves if c.kids else 1
        runs.append(Run(c.first, depth + 1, c.depth, c.n, c.kids, c.leaves, c.saved, c.end, c.end_key, c.lens))
        for w in c.waiting:
            if w < 0:
                found[~w] = (c.first, None)
            else:
                runs[w].parent = c.first
        c.saved += (c.n - 1) * int(c.lens[depth + 1 : c.depth + 1].sum())
        c.kids, c.end, c.end_key, c.depth, c.waiting = 1, None, None, depth, [len(runs) - 1]

    def merge(i: int, j: int) -> None:
        a, b = items[i], items[j]
        a.waiting, less = (a.waiting, b.waiting) if len(a.waiting) > len(b.waiting) else (b.waiting, a.waiting)
        a.waiting += less
        a.n, a.kids, a.leaves, a.saved = a.n + b.n, a.kids + b.kids, a.leaves + b.leaves, a.saved + b.saved
        a.first, a.open = min(a.first, b.first), a.open or b.open
        a.end, a.end_key, a.key = a.end or b.end, a.end_key or b.end_key, a.key or b.key
        parent[j] = i

    kept = []
    for e in np.argsort(-np.asarray(edges, dtype=np.int64), kind="stable"):
        depth, i, j = edges[e], root(e), root(e + 1)
        a, b = items[i], items[j]
        for c in (a, b):
            if not c.open:
                lift(c, depth)
        if a.depth == b.depth == depth:
            merge(i, j)
        else:
            a.open = b.open = True
            kept.append(int(e))
    kept.sort()
    if not open_ends:
        lift(items[root(0)], -1)
        return runs, [], [], found
    left = [items[root(0)], *(items[root(e + 1)] for e in kept)]
    for seq, c in enumerate(left):
        for w in c.waiting:
            if w < 0:
                found[~w] = (None, seq)
            else:
                runs[w].seq = seq
    return runs, left, [edges[e] for e in kept], found


def _table(rows: dict[str, list | np.ndarray], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c], TYPES[c]) if c in rows else pa.nulls(n, TYPES[c]) for c in NAMES], NAMES)


def _node_rows(runs: list[Run], part: int, at_once: int = 1 << 16):
    """One row for each node of the runs; a node whose parent is not finished names the item that is it."""
    at = 0
    while at < len(runs):
        some, n = [], 0
        while at < len(runs) and (not some or n < at_once):
            some.append(runs[at])
            n += runs[at].depth - runs[at].top + 1
            at += 1
        size = np.array([r.depth - r.top + 1 for r in some])

        def each(values):
            return np.repeat(np.array(values, dtype=np.int64), size)

        flat = np.concatenate([r.lens[r.top : r.depth + 1] for r in some])
        upto, ends = np.cumsum(flat), np.cumsum(size)
        below = np.repeat(upto[ends - 1], size) - upto + flat  # code points from a node down to the end of its run
        depth = np.arange(n) - np.repeat(ends - size, size) + each([r.top for r in some])
        first, count = each([r.item_first for r in some]), each([r.n for r in some])
        children, parent, sha = np.ones(n, dtype=np.int64), first.astype(object), [NO_ENDS] * n
        seq, key = [None] * n, [None] * n
        for r, end, length in zip(some, ends.tolist(), size.tolist()):
            children[end - 1] = r.kids
            parent[end - length], seq[end - length] = r.parent, r.seq
            if r.end:
                sha[end - 1] = r.end
            key[end - 1] = r.end_key
        rows = {
            "kind": [NODE] * n, "part": [part] * n, "seq": seq, "conv_id": first, "depth": depth, "parent_conv_id": parent.tolist(), "n_convs": count,
            "n_children": children, "n_leaves": each([r.leaves for r in some]), "saved_tokens": each([r.saved for r in some]) + (count - 1) * below,
            "ends_sha256": sha, "end_key": key,
        }
        yield _table(rows, n)


def _item_rows(left: list[Item], edges: list[int], part: int) -> pa.RecordBatch:
    n = len(left)
    rows = {
        "kind": [ITEM] * n, "part": [part] * n, "seq": list(range(n)), "conv_id": [c.first for c in left], "depth": [c.depth for c in left],
        "n_convs": [c.n for c in left], "n_children": [c.kids for c in left], "n_leaves": [c.leaves for c in left],
        "saved_tokens": [c.saved for c in left], "ends_sha256": [c.end for c in left], "end_key": [c.end_key for c in left],
        "edge": [*edges, None], "lens": [c.lens[: c.depth + 1] for c in left], "key": [c.key for c in left],
    }
    return _table(rows, n)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[TURN * low : TURN * mid] == b[TURN * low : TURN * mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _id_rows(ids: list[int], key: str, part: int):
    for at in range(0, len(ids), PIECE):
        yield _table({"kind": [ENDS], "part": [part], "seq": [at], "end_key": [key], "ids": [",".join(map(str, ids[at : at + PIECE])).encode()]}, 1)


def _first_level(batches):
    """Items of a sorted partition are its different sequences; those at its ends stay open."""
    part = TaskContext.get().partitionId()
    items: list[Item] = []
    edges: list[int] = []
    before, ids = None, []

    def finish():
        if len(items) > 1:  # not the first: all its ids are here, unless it is the last
            items[-1].end = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

    def pieces():
        items[-1].end = None
        items[-1].end_key = hashlib.sha256(before).hexdigest()
        items[-1].key = before
        return list(_id_rows(ids, items[-1].end_key, part))

    for batch in batches:
        for conv, key, lens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if key == before:
                items[-1].n += 1
                items[-1].first = min(items[-1].first, conv)
            else:
                if before is not None:
                    finish()
                    edges.append(shared_turns(before, key))
                    if len(items) == 1:
                        yield from pieces()
                sizes = np.concatenate([[0], lens.values.to_numpy(zero_copy_only=False)]).astype(np.int64)
                items.append(Item(len(key) // TURN, 1, conv, sizes))
                before, ids = key, []
            ids.append(conv)
    if items:
        yield from pieces()
        runs, left, edges, _ = contract(items, edges, open_ends=True)
        yield from _node_rows(runs, part)
        yield _item_rows(left, edges, part)


def _next_level(fan: int, last: bool):
    """Items of neighbouring partitions, merged into those of a group of partitions, or finished at the last level."""

    def merged(group: int, rows: list[dict]):
        items = [
            Item(
                r["depth"], r["n_convs"], r["conv_id"], np.array(r["lens"], dtype=np.int64), r["n_children"], r["n_leaves"],
                r["saved_tokens"], r["ends_sha256"], r["end_key"], r["key"],
            )
            for r in rows
        ]
        edges = [
            r["edge"] if r["part"] == s["part"] else shared_turns(r["key"], s["key"]) for r, s in zip(rows, rows[1:])
        ]
        runs, left, edges, found = contract(items, edges, open_ends=not last)
        yield from _node_rows(runs, group)
        if left:
            yield _item_rows(left, edges, group)
        n = len(rows)
        yield _table(
            {
                "kind": [REF] * n, "part": [r["part"] for r in rows], "seq": [r["seq"] for r in rows], "conv_id": [f for f, _ in found],
                "depth": [group] * n, "edge": [s for _, s in found],
            },
            n,
        )

    def work(batches):
        group, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] // fan != group:
                    if rows:
                        yield from merged(group, rows)
                    group, rows = r["part"] // fan, []
                rows.append(r)
        if rows:
            yield from merged(group, rows)

    return work


def _hashed(batches):
    """Digest of the joined pieces of each key, which come in order; a hash can't be split, so it is fed piece by piece."""
    key, state = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["end_key"] == key:
                state.update(b",")
            else:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["end_key", "ends"])
                key, state = r["end_key"], hashlib.sha256()
            state.update(r["ids"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["end_key", "ends"])


def trie(seqs: DataFrame, fan: int = FAN) -> DataFrame:
    """A row per node of the trie of ``seqs`` (``conv_id``, ``key``, ``lens``; see ``sequences``).

    ``conv_id``: smallest member; ``depth``: turns from the root; ``parent_conv_id``: smallest member of the parent (root: null);
    ``n_convs``: members; ``n_children``; ``n_leaves``: childless nodes in the subtree, the node included; ``saved_tokens``: over the
    subtree, (members - 1) times the code points of the node's last text; ``ends_sha256``: digest of the comma-joined
    ids of the members that end here, ascending. Conversations without turns end at the root; equal ones end at one node.
    An empty table has no nodes, not even a root.
    """
    spark = seqs.sparkSession
    rows = stored(seqs, "sequences")
    size = rows.agg(F.sum(F.length("key") + 8 * F.size("lens") + 64)).first()[0]
    if size is None:
        return spark.createDataFrame([], SCHEMA).select(*OUT)
    parts = max(parts_of(spark), size // PART + 1)
    ordered = rows.select("conv_id", "key", "lens").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    levels = [stored(ordered.mapInArrow(_first_level, SCHEMA), "forest")]
    parts = levels[0].agg(F.max("part")).first()[0] + 1  # as Spark dealt them
    while len(levels) == 1 or parts > 1:
        parts = -(-parts // fan)
        items = levels[-1].where(F.col("kind") == ITEM)
        group = F.floor(F.col("part") / fan)
        met = items.repartition(parts, group).sortWithinPartitions("part", "seq")
        levels.append(stored(met.mapInArrow(_next_level(fan, parts == 1), SCHEMA), "forest"))

    ends = levels[0].where(F.col("kind") == ENDS).select("end_key", "part", "seq", "ids")
    ends = ends.repartition("end_key").sortWithinPartitions("end_key", "part", "seq").mapInArrow(_hashed, "end_key string, ends string")
    ends = stored(ends, "ends")
    known, out = None, None
    for level in reversed(levels):
        nodes = level.where(F.col("kind") == NODE)
        waits = F.col("seq").isNotNull() | F.col("end_key").isNotNull()
        some = nodes.where(waits).join(ends, "end_key", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256"))
        if known is not None:
            some = some.join(known, ["part", "seq"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
        here = nodes.where(~waits).select(*OUT).unionByName(some.select(*OUT))
        out = here if out is None else out.unionByName(here)
        refs = level.where(F.col("kind") == REF).select("part", "seq", "conv_id", F.col("depth").alias("up"), F.col("edge").alias("up_seq"))
        if known is not None:
            above = known.select(F.col("part").alias("up"), F.col("seq").alias("up_seq"), "found")
            refs = refs.join(above, ["up", "up_seq"], "left").withColumn("conv_id", F.coalesce("conv_id", "found"))
        known = refs.select("part", "seq", F.col("conv_id").alias("found"))
    return out


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` as they are; other columns do not matter. See ``sequences`` and ``trie`` for odd rows."""
    return trie(sequences(conversations))


def node_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of ``shared_prefixes`` with ``role`` and ``text`` of their last turn, null at the root."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), digest.alias("d"), role.alias("role"), text.alias("text")).distinct()
    keys = sequences(conversations).select("conv_id", "key")
    named = nodes.join(keys, "conv_id").withColumn("d", F.expr(f"lower(hex(substring(key, {TURN} * (depth - 1) + 1, {TURN})))"))
    return named.drop("key").join(turns, ["conv_id", "d"], "left").drop("d")
