"""Mixing sources to target weights (operator 9).

Sources may overlap: a document can belong to several. Documents with the same set of sources are
one *pattern*; a pattern's words are routed to its sources by a min-cost flow. Each further repetition of a
pattern costs more than the one before, so repetition is spread as evenly as the quotas allow. Words that a
pattern gives are whole repetitions of all its documents plus, for the rest, a prefix of them in
seeded order. Its end is found by sums of 256 ranges of the order, then of 256 parts of the range where it ends, and
so on, and one exact running sum in the last one, so no task orders a whole source.

The driver holds one row per source and per pattern.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import NOT_SPACES, stored, unpacked, whole_row

#: weights of the sources in code point order, null last, over and over
WEIGHTS = (5, 2, 1)
#: words of the mix as a share of all words
SHARE = 1.5
#: how often a document may be taken
REPEATS = 2
#: hexadecimal digits of the seeded order by which a range is split, and how often that is done
DIGITS = 2
LEVELS = 3


def n_words(col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(col), F.lit("")), F.lit(f"{NOT_SPACES}+")).cast("long")


def targets(
    sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, total: int | None = None
) -> dict:
    """Words per source: ``share`` of all words by weight; none above ``repeats`` times its size, the excess goes to the others by weight.

    ``total``: all words, where sources overlap and their sizes count some of them twice.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    rows = [(name, size, weights[i % len(weights)], i) for i, (name, size) in enumerate(order)]
    total = sum(size for _, size in sizes) if total is None else total
    room, left = share * total, sum(w for _, _, w, _ in rows)
    out: dict = {}
    rows.sort(key=lambda r: (repeats * r[1] / r[2], r[3]))  # the first to reach its limit comes first
    for n, (name, size, w, _) in enumerate(rows):
        if room * w / left <= repeats * size:
            out |= {m: room * v / left for m, _, v, _ in rows[n:]}
            break
        out[name] = float(repeats * size)
        room, left = room - repeats * size, left - w
    return out


def route(patterns: dict[str, tuple[list, int]], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words from each pattern to each of its sources: as many as the quotas ask for, with the least repetition.

    ``patterns``: the sources and the size of each. Successive shortest paths with potentials; an arc per repetition
    makes the cost convex.
    """
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: dict[int, list[int]] = {}
    ids: dict = {}

    def node(x) -> int:
        return ids.setdefault(x, len(ids))

    def arc(a: int, b: int, words: int, price: int) -> None:
        for x, y, r, c in ((a, b, words, price), (b, a, 0, -price)):
            out.setdefault(x, []).append(len(head))
            head.append(y)
            room.append(r)
            cost.append(c)

    start, end = node("start"), node("end")
    uses = {}
    for p, (sources, size) in sorted(patterns.items()):
        for k in range(repeats):
            arc(start, node(("p", p)), size, k * k)
        for s in sources:
            uses[p, s] = len(head)
            arc(node(("p", p)), node(("s", s)), repeats * size, 0)
    for s, quota in quotas.items():
        arc(node(("s", s)), end, quota, 0)
    height = [0] * len(ids)
    while True:
        far, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out.get(x, []):
                if room[e] > 0 and (new := d + cost[e] + height[x] - height[head[e]]) < far.get(head[e], new + 1):
                    far[head[e]], via[head[e]] = new, e
                    heapq.heappush(heap, (new, head[e]))
        if end not in far:
            break
        for x, d in far.items():
            height[x] += min(d, far[end])
        for x in range(len(height)):
            if x not in far:
                height[x] += far[end]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = head[via[x] ^ 1]
        words = min(room[e] for e in path)
        for e in path:
            room[e] -= words
            room[e ^ 1] += words
    return {k: room[e ^ 1] for k, e in uses.items()}


def sized(docs: DataFrame, sources: Column, seed: int = 0) -> DataFrame:
    """``docs`` with ``__size`` in words, ``__sources``, ``__pattern`` and ``__order``, a seeded place."""
    members = F.array_sort(F.array_distinct(sources))
    named = F.transform(members, lambda s: F.coalesce(F.concat(F.lit("="), F.hex(s)), F.lit("-")))
    place = F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.withColumns(
        {"__size": n_words(), "__sources": members, "__pattern": F.array_join(named, ","), "__order": place}
    )


@dataclass
class Plan:
    """What each source is to get, and how often the documents of each pattern are taken."""

    targets: dict
    sizes: dict
    #: pattern, whole repetitions, and the order and size of the last document that is taken once more
    rows: list[tuple]

    def applied(self, docs: DataFrame) -> DataFrame:
        """``docs`` (as ``sized`` gives them) with ``__times``. The plan has a row per pattern, as many as the driver held."""
        table = docs.sparkSession.createDataFrame(self.rows, "p string, whole int, last_order string, last_size long")
        within = F.struct("__order", "__size") <= F.struct("last_order", "last_size")
        once_more = F.coalesce(F.col("last_order").isNotNull() & within, F.lit(False)).cast("int")
        joined = docs.join(F.broadcast(table), docs["__pattern"] == table.p)
        return joined.withColumn("__times", F.col("whole") + once_more).drop("p", "whole", "last_order", "last_size")


def plan(
    rows: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, max_patterns: int = 1_000_000
) -> Plan:
    """The plan for ``rows`` (as ``sized`` gives them). More patterns than ``max_patterns`` are an error."""
    found = rows.groupBy("__pattern").agg(F.sum("__size").alias("n"), F.first("__sources").alias("s")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} different sets of sources")
    patterns = {r["__pattern"]: (list(r["s"]), r["n"]) for r in found}
    sizes: dict = {}
    for sources, n in patterns.values():
        for s in sources:
            sizes[s] = sizes.get(s, 0) + n
    total = sum(n for _, n in patterns.values())
    goal = targets(list(sizes.items()), weights, share, repeats, total)
    flow = route(patterns, {s: int(t) for s, t in goal.items()}, repeats)
    taken = {p: sum(flow.get((p, s), 0) for s in sources) for p, (sources, _) in patterns.items()}
    whole = {p: (taken[p] // n if n else 0) for p, (_, n) in patterns.items()}
    rest = [(p, taken[p] - whole[p] * n) for p, (_, n) in patterns.items()]
    last = _ends(rows, rest)
    return Plan(goal, sizes, [(p, whole[p], *(last.get(p) or (None, None))) for p in patterns])


def _ends(rows: DataFrame, rest: list[tuple[str, int]]) -> dict[str, tuple]:
    """Per pattern, the last document of the seeded order that the rest still takes: its middle is within the rest.

    Level by level, the range of the order in which the rest ends is split into 256; its documents are read out at last.
    """
    spark = rows.sparkSession
    cuts, tops = [(p, "", 0, n) for p, n in rest if n > 0], {}
    for level in range(LEVELS + 1):
        if not cuts:
            break
        table = spark.createDataFrame(cuts, "p string, prefix string, start long, rest long")
        within = F.substring("__order", 1, DIGITS * level) == F.col("prefix") if level else F.lit(True)
        inside = rows.join(F.broadcast(table), (rows["__pattern"] == table.p) & within)  # a row per pattern
        top = F.struct("__order", "__size").alias("top")
        if level == LEVELS:
            order = Window.partitionBy("p").orderBy("__order", "__size").rowsBetween(Window.unboundedPreceding, -1)
            before = F.col("start") + F.coalesce(F.sum("__size").over(order), F.lit(0))
            taken_ = inside.withColumn("before", before).where("2 * before + __size <= 2 * rest").select("p", top)
            found, cuts = taken_.groupBy("p").agg(F.max("top").alias("top")).collect(), []
        else:
            part = F.substring("__order", 1, DIGITS * (level + 1)).alias("part")
            sums = inside.groupBy("p", part, "start", "rest").agg(F.sum("__size").alias("n"), F.max(top).alias("top"))
            order = Window.partitionBy("p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            ranged = sums.withColumn("begin", F.col("start") + F.coalesce(F.sum("n").over(order), F.lit(0)))
            whole = F.max(F.when(F.col("begin") + F.col("n") <= F.col("rest"), F.col("top"))).alias("top")
            ends = (F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("n") > F.col("rest"))
            cut = F.max(F.when(ends, F.struct("part", "begin"))).alias("cut")
            found = ranged.groupBy("p", "rest").agg(whole, cut).collect()
            cuts = [(r["p"], r["cut"]["part"], r["cut"]["begin"], r["rest"]) for r in found if r["cut"]]
        tops |= {r["p"]: max(tuple(r["top"]), tops.get(r["p"], ("", 0))) for r in found if r["top"]}
    return tops


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source``, one row per row of ``docs``, for one source per document.

    Null is a source of its own, the last. A null or empty text has size 0 and is taken with 0 words. Rows with
    equal ids are rows of their own. An empty table gives no rows.
    """
    rows = sized(docs.select("doc_id", "text", "source"), F.array("source"), seed).drop("text", "__sources")
    rows = stored(rows.withColumn("__sources", F.array("source")), "sizes")
    made = plan(rows)
    facts = [(s, made.sizes[s], made.targets[s]) for s in made.sizes]
    table = docs.sparkSession.createDataFrame(facts, "s string, source_size long, target double")
    out = made.applied(rows).join(F.broadcast(table), F.col("source").eqNullSafe(table.s))  # a row per source
    return out.select(
        F.col("doc_id").cast("long"), F.col("__size").alias("size"), "source_size", "target",
        (F.col("__size") * F.col("__times")).cast("long").alias("taken"), "source",
    )


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan takes it. Texts stay where they are read."""
    rows = whole_row(docs, "doc_id", "text", "source")
    rows = sized(rows, F.array(F.col("source").cast("string")), seed)
    made = plan(stored(rows.select("__size", "__sources", "__pattern", "__order"), "sizes"))
    again = made.applied(rows).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return unpacked(again, docs.columns)
