"""Documents whose word n-gram sets are similar, by prefixes of their rarest features (operator 12).

Two sets of Jaccard similarity of ``percent`` or more share that part of the larger one's features. So if the features of all sets are
put in one order, the first ones of two similar sets, one more than either can do without, have a feature in common. These
are a set's signatures. Any order will do for that; the one taken puts features last that many sets have, so that common
passages sign nothing. How many sets have a feature is estimated from a bounded sample of the texts; the order
alone hangs on it, and every set is signed.

Equal sets are one node throughout. Rows of signatures are sorted, and each bucket's first few nodes are paired with all of it.
What is left of larger buckets matters only where it belongs to different components so far. Crowded ones are broken up: their
sets are signed again, twice at most, in an order that has the features of crowded buckets last. The others are compared in blocks by
parity sketches: a bit for each feature's place, flipped by each feature, so that two sets differ in at least as many features as their
sketches in bits. Of the pairs that this bound lets pass only so many leave the task as chain their nodes, less than a block's rows.
Then the nodes of each chain meet with their features, each once, and are compared on these. Links that connect them leave the task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import short_batches, slices, stored, text_bytes
from driftline.llm.components import components
from driftline.operators.skew import join_facts

#: bytes of a text split in words at a time
PIECE = 1 << 22
#: different texts, about, in which features are counted; and texts that make a feature frequent
SAMPLE, FREQUENT = 10_000, 3
#: features known as frequent at most, 16 bytes each, sent to all executors
KNOWN = 200_000
#: times that sets are signed
LEVELS = 3
#: first nodes of a bucket that are paired with all of it
PIVOTS = 4
#: nodes that are left in a bucket before its sets are signed again; and nodes of a bucket that are compared at a time
CROWD, BLOCK = 2048, 2048
#: nodes of a chain that are compared with all others of it; and features of a block, about, 8 bytes each
CHAIN, HELD = 8192, 1_000_000
#: rows of buckets looked at together
ROWS = 1 << 16
#: text hashes sent to all executors at most, 8 bytes each; beyond it a shuffle joins them
SENT = 1_000_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: odd multiplier that spreads bits
GOLD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(GOLD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(GOLD ^ (GOLD >> 7) | 1)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of ``words`` words; fewer words are one run; A-Z are lower-cased."""
    parts, at = [], 0
    while at < len(text):
        stop = SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = stop.start() if stop else len(text)
        found = text[at:end].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found)))
        at = end
    each = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    if not len(each):
        return each
    run = min(words, len(each))
    total = np.full(len(each) - run + 1, run, dtype=np.uint64)
    for i in range(run):
        total += each[i : len(each) - run + 1 + i] * np.uint64(pow(GOLD, i + 1, 1 << 64))
    return np.unique(_mixed(total))


#: features, sorted, and how many sets have them, about
Late = tuple[np.ndarray, np.ndarray]
NONE_LATE: Late = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)


def signatures(features: np.ndarray, percent: int = 80, level: int = 0, late: Late = NONE_LATE) -> np.ndarray:
    """The first of a set's features, one more than a similar set may lack, with those that are ``late`` behind all others.

    The others come in an order of their own on each ``level``.
    """
    if level:
        features = features[np.argsort(_mixed(features + np.uint64(level)))]
    if len(late[0]):
        at = np.minimum(np.searchsorted(late[0], features), len(late[0]) - 1)
        features = features[np.argsort(np.where(late[0][at] == features, late[1][at], 0), kind="stable")]
    return features[: (100 - percent) * len(features) // 100 + 1]


def _later(late: Late, more: DataFrame) -> Late:
    """``late`` and the most frequent ``KNOWN`` features of ``more`` (``feature``, ``sets``)."""
    found = more.orderBy(F.desc("sets"), "feature").limit(KNOWN).toArrow()
    features = np.concatenate([late[0], found.column("feature").to_numpy().view(np.uint64)])
    sets = np.concatenate([late[1], found.column("sets").to_numpy()])
    order = np.lexsort((-sets, features))
    features, sets = features[order], sets[order]
    first = np.ones(len(features), dtype=bool)
    first[1:] = features[1:] != features[:-1]
    return features[first], sets[first]


def _frequent(docs: DataFrame, texts: int, words: int) -> Late:
    """Features that several of about ``SAMPLE`` texts have, with an estimate for all ``texts`` different ones.

    Texts are drawn by their hash. A task counts copies once.
    """
    one_in = max(1, texts // SAMPLE)

    def work(batches):
        seen = set()
        for batch in slices(batches, 64):
            sets = [np.zeros(0, dtype=np.uint64)]
            for th, text in zip(*(c.to_pylist() for c in batch.columns)):
                if th not in seen:
                    seen.add(th)
                    sets.append(shingles(text, words))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["feature"])

    drawn = docs.select(F.xxhash64("text").alias("th"), text_bytes()).where(F.pmod("th", F.lit(one_in)) == 0)
    counted = drawn.mapInArrow(work, "feature long").groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    return _later(NONE_LATE, counted.select("feature", (F.col("n") * one_in).alias("sets")))


def _node(features: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(features.tobytes())


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "big", signed=True)


def parity(features: np.ndarray) -> np.ndarray:
    """Sketch of a set, about a bit for each feature: bits at the features' places, each flipped once by each."""
    bits = max(64, 1 << (len(features) - 1).bit_length())
    odd = np.bincount((features & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, a hash of the text, size of the set, its ``node`` (128 bits; null without words), the first 64 bits of it and its sketch.

    Of equal sets of a task only one has a sketch.
    """

    def work(batches):
        seen = set()
        for batch in slices(batches, 64):
            sets = [shingles(t, words) for t in batch.column(2).to_pylist()]
            nodes = [_node(s) if len(s) else None for s in sets]
            sketches = [None if n is None or n in seen else (seen.add(n), parity(s))[1] for n, s in zip(nodes, sets)]
            columns = [
                pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.binary()), pa.array([n and _short(n) for n in nodes], pa.int64()),
                pa.array(sketches, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "th", "n", "node", "short", "sketch"])

    short_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), text_bytes())
    return texts.mapInArrow(work, "doc_id long, th long, n long, node binary, short long, sketch array<long>")


def _of_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts whose hash is in ``wanted`` (``th``). It is sent to all executors only up to a checked count."""
    wanted = stored(wanted.select("th").distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    return docs.select(F.xxhash64("text").alias("th"), text_bytes()).join(few, "th", "left_semi")


def _signed(texts: DataFrame, words: int, percent: int, level: int, late: Late) -> DataFrame:
    """``sig`` and ``short`` of all texts; equal sets of a task are signed once."""

    def work(batches):
        seen = set()
        for batch in slices(batches, 64):
            sigs, shorts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for text in batch.column(0).to_pylist():
                features = shingles(text, words)
                short = _short(_node(features)) if len(features) else None
                if short is not None and short not in seen:
                    seen.add(short)
                    sigs.append(signatures(features, percent, level, late))
                    shorts.append(np.full(len(sigs[-1]), short))
            columns = [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(shorts))]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "short"])

    return texts.select("text").mapInArrow(work, "sig long, short long")


def _joined(batches):
    """Columns of about ``ROWS`` rows at a time as arrays."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
        if n >= ROWS:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def _met(rows: DataFrame) -> DataFrame:
    """Pairs (``sig`` null) of each bucket's first nodes with all later ones, and the rows behind those first nodes.

    Rows come sorted, so a bucket of any size passes through in batches; only its first nodes are kept.
    """

    def work(batches):
        carry, passed = [np.zeros(0, dtype=np.int64)] * 2, 0  # first rows of the last bucket, and how many it had
        last = None
        for batch in _joined(batches):
            kept = len(carry[0])
            sig, short = (np.concatenate([c, batch[i]]) for i, c in enumerate(carry))
            new = np.ones(len(sig), dtype=bool)
            new[1:] = (sig[1:] != sig[:-1]) | (short[1:] != short[:-1])
            if kept and passed > kept:  # the last row seen is not among those kept
                new[kept] = not (sig[kept] == last[0] and short[kept] == last[1])
            last = (sig[-1], short[-1])
            sig, short = sig[new], short[new]
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            start = np.repeat(starts, np.diff(np.append(starts, len(sig))))
            place = np.arange(len(sig)) - start
            if kept:
                more = start == 0
                more[:kept] = False
                place[more] += passed - kept
            fresh = np.arange(len(sig)) >= kept
            later = [np.flatnonzero(fresh & (place > t)) for t in range(PIVOTS)]
            rest = np.flatnonzero(fresh & (place >= PIVOTS))
            a = np.concatenate([*(short[start[x] + t] for t, x in enumerate(later)), short[rest]])
            b = np.concatenate([*(short[x] for x in later), np.zeros(len(rest), dtype=np.int64)])
            pairs = len(a) - len(rest)
            in_bucket = pa.array(np.concatenate([np.zeros(pairs, dtype=np.int64), sig[rest]]), mask=np.arange(len(a)) < pairs)
            yield pa.RecordBatch.from_arrays([in_bucket, pa.array(a), pa.array(b)], ["sig", "a", "b"])
            passed = int(place[-1]) + 1
            begin = starts[-1]
            carry = [c[begin : begin + PIVOTS].copy() for c in (sig, short)]

    dealt = rows.repartition("sig").sortWithinPartitions("sig", "short")
    return stored(dealt.mapInArrow(work, "sig long, a long, b long"), "met")


def _near(columns: list, split: int, percent: int, label: np.ndarray | None = None, links=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group of rows (first half, size, root, sketch) that may be similar: of the first ``split`` rows with
    all behind them, or of all rows if ``split`` is their number. Two sketches are compared at the shorter one's length.

    With a ``label`` for each row, only pairs of rows whose labels differ are looked at, and a pair makes two labels one. So there are
    fewer pairs than rows, and they connect what all pairs connect. ``links`` tells which of several rows are similar to a row.
    """
    short, size, root = (np.array(c, dtype=np.int64) for c in columns[:3])
    length = np.array([len(s) for s in columns[3]])
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for words in np.unique(length):
        at = np.flatnonzero((length >= words) & (length <= words << (100 // percent).bit_length()))  # longer ones are of sets too large
        sketch = np.array([_folded(np.array(columns[3][k], dtype=np.int64), words) for k in at]).view(np.uint64)  # bits of signed numbers are counted without sign
        behind = np.searchsorted(at, split)
        for i, k in enumerate(at if split == len(short) else at[:behind]):
            others = slice(i + 1 if split == len(short) else behind, None)
            m = at[others]
            fits = (100 * np.minimum(size[m], size[k]) >= percent * np.maximum(size[m], size[k])) & (root[m] != root[k])
            if length[k] != words:
                fits &= length[m] == words
            if label is not None:
                fits &= label[m] != label[k]
            apart = np.bitwise_count(sketch[others][fits] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            found = m[fits]
            found = found[(100 + percent) * apart <= (100 - percent) * (size[found] + size[k])]
            if links is not None:
                found = found[links(k, found)]
            if label is not None and len(found):
                found = found[np.unique(label[found], return_index=True)[1]]
                label[np.isin(label, label[found])] = label[k]
            a.append(np.full(len(found), short[k]))
            b.append(short[found])
    return np.concatenate(a), np.concatenate(b)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch that the set has with fewer places."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _links(sets: list[np.ndarray], percent: int):
    """A function that tells which of the rows ``m`` of a group are similar to its row ``k``, by their features."""
    size = np.array([len(s) for s in sets])
    places = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    has = np.zeros(int(size.sum()), dtype=bool)

    def similar(k: int, m: np.ndarray) -> np.ndarray:
        has[places[k]] = True
        shared = np.array([np.count_nonzero(has[places[x]]) for x in m], dtype=np.int64)
        has[places[k]] = False
        return 100 * shared >= percent * (size[k] + size[m] - shared)

    return similar


def _in_blocks(placed: DataFrame, also: list[str]) -> DataFrame:
    """Rows of ``placed`` (``sig, short, root, blocks, n, sketch`` and ``also``) by ``sig, i, j``, for each two blocks of a bucket.

    A bucket is cut in blocks, and every two blocks meet in one group, so a task holds two blocks at a time.
    """
    own = F.pmod(F.xxhash64("short"), F.col("blocks"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = placed.withColumn("own", own).withColumn("_g", F.explode(every)).select("sig", "_g.i", "_g.j", "own", "short", "n", "root", "sketch", *also)
    return dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "own", "short")


def _groups(batches):
    """Of each group of ``_in_blocks`` how many rows its first block has, or all have if it is of one block, and its columns behind ``own``."""

    def plain(column):
        if pa.types.is_nested(column.type):
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            return [values[x:y] for x, y in zip(ends[:-1], ends[1:])]
        return column.to_numpy() if pa.types.is_integer(column.type) else column.to_pylist()

    def whole(held, group):
        columns = [sum(c, []) if isinstance(c[0], list) else np.concatenate(c) for c in zip(*held)]
        return len(columns[0]) if group[1] == group[2] else int((columns[0] == group[1]).sum()), columns[1:]

    group, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [plain(c) for c in batch.columns]
        keys = np.stack(columns[:3], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        for x, y in zip(starts, [*starts[1:], len(keys)]):
            if group != tuple(keys[x].tolist()):
                if held:
                    yield whole(held, group)
                group, held = tuple(keys[x].tolist()), []
            held.append([c[x:y] for c in columns[3:]])
    if held:
        yield whole(held, group)


def _chained(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (``u``, ``v``) of first halves that connect all nodes of different components that share a bucket and may be similar.

    ``placed`` has ``sig, short, root`` and ``rows`` of the bucket. A group makes fewer pairs than it has rows.
    """

    def work(batches):
        for split, columns in _groups(batches):
            if len(columns[0]) > 1:
                u, v = _near(columns, split, percent, np.arange(len(columns[0])))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    blocks = F.ceil(F.col("rows") / BLOCK).cast("long")
    rows = placed.join(nodes.select("short", "n", "sketch"), "short").withColumn("blocks", blocks)
    return stored(_in_blocks(rows, []).mapInArrow(work, "u long, v long").distinct(), "chains")


def _compared(docs: DataFrame, placed: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Edges (``u``, ``v``) that connect the similar nodes of different components that share a bucket; None if no two may be similar.

    Nodes that may be similar, by sketches, are chained, and those of a chain compared in one group by their features, so that neither
    the pairs that pass nor those that prove not similar leave a task. Of chains beyond ``CHAIN`` nodes each bucket is a group.
    """
    chains = _chained(placed, nodes, percent)
    if chains.isEmpty():
        return None
    known = stored(components(chains).select(F.col("node").alias("short"), F.col("component").alias("chain")), "chained")
    known = join_facts(known, known.groupBy("chain").agg((F.count("*") > CHAIN).alias("large")), ["chain"], ["short"], "inner")
    rows = placed.select("sig", "short", "root").join(known, "short")
    rows = rows.select(F.when(F.col("large"), F.col("sig")).otherwise(F.col("chain")).alias("sig"), "large", "short", "root").distinct()
    rows = stored(rows.join(nodes.select("short", "n", "sketch", "node", "th"), "short"), "compared")
    held = rows.groupBy("sig", "large").agg(F.count("*").alias("rows"), F.sum("n").alias("features"))
    held = held.select("sig", "large", F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("features") / HELD)).cast("long").alias("blocks"))
    rows = join_facts(rows, held, ["sig", "large"], ["short"], "inner").join(_arrays(docs, rows, words), "node")

    def work(batches):
        for split, (short, n, root, sketch, node, sets) in _groups(batches):
            if len(short) > 1:
                at = np.arange(len(short))
                u, v = _near([at, n, root, sketch], split, percent, root.copy(), _links(sets, percent))
                yield pa.RecordBatch.from_arrays([pa.array([node[x] for x in u], pa.binary()), pa.array([node[x] for x in v], pa.binary())], ["u", "v"])

    return stored(_in_blocks(rows, ["node", "set"]).mapInArrow(work, "u binary, v binary").distinct(), "links")


def _arrays(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node`` and its features as an array, for the nodes of ``wanted`` (``node``, ``th``)."""

    def work(batches):
        seen = set()
        for batch in slices(batches, 64):
            nodes, sets = [], []
            for text in batch.column(0).to_pylist():
                features = shingles(text, words)
                node = _node(features)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(features.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    rows = _of_texts(docs, wanted).select("text").mapInArrow(work, "node binary, set array<long>")
    return stored(rows.dropDuplicates(["node"]), "sets")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, roots: DataFrame | None, words: int, percent: int) -> DataFrame | None:
    """Edges (``u``, ``v``) between the nodes of ``pairs`` (``a``, ``b``: first halves) that are similar enough; None if there is no pair to look at.

    Sizes and sketches are looked at before features. Pairs inside one component of ``roots`` say nothing new and are left out.
    """
    sides = [nodes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("short", "node", "n", "th", "sketch"))) for s in "ab"]
    sized = pairs.select(F.col("a").alias("short_a"), F.col("b").alias("short_b")).distinct().join(sides[0], "short_a").join(sides[1], "short_b")
    sized = sized.where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    folds = {  # sizes are close, so one sketch is as long as the other or twice as long
        s: f"CASE WHEN size(sketch_{s}) > size(sketch_{t}) THEN zip_with(slice(sketch_{s}, 1, size(sketch_{t})), slice(sketch_{s}, 1 + size(sketch_{t}), size(sketch_{t})),"
        f" (x, y) -> x ^ y) ELSE sketch_{s} END"
        for s, t in ("ab", "ba")
    }
    apart = F.expr(f"aggregate(zip_with({folds['a']}, {folds['b']}, (x, y) -> bit_count(x ^ y)), 0L, (s, x) -> s + x)")
    sized = sized.where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    sized = sized.select("node_a", "node_b", "th_a", "th_b")
    if roots is not None:
        sized = _rooted(_rooted(sized, roots, "node_a", "root_a"), roots, "node_b", "root_b").where("root_a <> root_b").drop("root_a", "root_b")
    sized = stored(sized, "candidates")
    if sized.isEmpty():
        return None
    wanted = sized.select(F.col("th_a").alias("th")).unionByName(sized.select(F.col("th_b").alias("th")))
    sets = _arrays(docs, wanted, words)
    both = sized.select("node_a", "node_b").join(sets.select(F.col("node").alias("node_a"), F.col("set").alias("set_a")), "node_a")
    both = both.join(sets.select(F.col("node").alias("node_b"), F.col("set").alias("set_b")), "node_b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    alike = both.select("node_a", "node_b", shared.alias("i"), (F.size("set_a") + F.size("set_b")).alias("n"))
    alike = alike.where(F.expr(f"100 * i >= {percent} * (n - i)"))
    return stored(alike.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")), "links")


def _unsettled(met: DataFrame, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``sig``, ``short``, ``root`` and ``rows`` of the bucket, of what is left in buckets that hold nodes of several components."""
    own = _rooted(nodes.select("short", "node"), roots).select("short", F.xxhash64("root").alias("root"))
    rest = met.where("sig IS NOT NULL").select("sig", F.col("a").alias("short")).join(own, "short")
    several = rest.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("rows")).where("x <> y")
    return stored(join_facts(rest, several.select("sig", "rows"), ["sig"], ["short"], "inner"), "unsettled")


def _rooted(df: DataFrame, roots: DataFrame | None, node: str = "node", root: str = "root") -> DataFrame:
    """``df`` with the component of ``node``; a node that has met none is its own."""
    if roots is None:
        return df.withColumn(root, F.col(node))
    known = roots.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    return df.join(known, df[node] == known["__n"], "left").withColumn(root, F.coalesce("__c", node)).drop("__n", "__c")


def _connected(roots: DataFrame | None, edges: DataFrame | None) -> DataFrame | None:
    """Components after more edges: only components that these connect are merged. None stands for none."""
    if edges is None or roots is None:
        return roots if edges is None else stored(components(edges), "roots")
    ends = _rooted(_rooted(edges, roots, "u", "a"), roots, "v", "b")
    merged = components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = roots.join(merged, roots.component == merged.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    first = merged.join(roots, merged.old == roots.node, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return stored(moved.unionByName(first), "roots")


def connected_sets(docs: DataFrame, nodes: DataFrame, words: int = 5, percent: int = 80) -> DataFrame | None:
    """``node`` and ``component``, its least node, for the sets that are linked to others by ``percent`` similarity or more; None if no sets may be.

    ``nodes`` has a row per different set: ``node``, ``short``, ``n``, its ``sketch``, and ``th``, the hash of a text that has it.
    """
    short_batches(docs.sparkSession)
    roots, texts = None, docs.select(text_bytes())
    late = _frequent(docs, nodes.count(), words)
    for level in range(LEVELS):
        met = _met(_signed(texts, words, percent, level, late))
        roots = _connected(roots, _verified(docs, met.where("sig IS NULL"), nodes, roots, words, percent))
        left = _unsettled(met, nodes, roots)
        crowded = left.where(F.col("rows") > CROWD) if level < LEVELS - 1 else left.where("false")
        here = left.where(F.col("rows") <= CROWD) if level < LEVELS - 1 else left
        roots = _connected(roots, _compared(docs, here, nodes, words, percent))
        if crowded.isEmpty():
            break
        late = _later(late, crowded.groupBy(F.col("sig").alias("feature")).agg(F.max("rows").alias("sets")))
        texts = _of_texts(docs, crowded.select("short").distinct().join(nodes, "short").select("th"))
    return roots


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Documents are linked if their sets of runs of ``words`` words share ``percent`` of a hundred or more of their union.
    ``component_id`` is the smallest ``doc_id`` that is reached over links, the document's own included; null ids do not count for
    it, so a component of such rows alone has a null one. Null and empty texts, and those of white space, have no set and stand
    alone. Repeated rows come out as often as they go in. An empty table gives no rows.
    """
    sets = stored(shingle_sets(docs, words), "sets")
    nodes = sets.where("n > 0").groupBy("node").agg(
        F.first("short").alias("short"), F.first("n").alias("n"), F.min("th").alias("th"), F.min("doc_id").alias("first"), F.count("*").alias("rows"),
        F.first("sketch", ignorenulls=True).alias("sketch"),
    )
    nodes = stored(nodes, "nodes")
    roots = connected_sets(docs, nodes, words, percent)
    known = nodes.withColumn("component", F.lit(None).cast("binary")) if roots is None else nodes.join(roots, "node", "left")
    linked = known.where("component IS NOT NULL OR rows > 1")
    linked = stored(linked.select("node", "first", F.coalesce("component", "node").alias("root")), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = linked.join(least, "root").select("node", "component_id", F.lit(True).alias("labelled"))
    rows = join_facts(sets, labels, ["node"], ["doc_id", "th"])
    own = F.when(F.col("labelled"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
