"""SimHash fingerprints and near-duplicate groups (operator 7).

Fingerprints of 64 bits are cut into ``blocks`` blocks. Two that differ in at most ``distance`` bits
agree on at least ``blocks - distance`` whole blocks, so they meet in the bucket of one such choice of
blocks, where the Hamming distance is verified. Equal fingerprints are one node
throughout, however many documents carry them.

A bucket with many different fingerprints is not paired off. Two fingerprints are within
``distance`` bits exactly if some third one is within half of that of both; fingerprints of crowded
buckets are grouped by these midpoints. Such a group has a fixed size limit, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import numbered, row_place, short_batches, slices, stored, text_bytes, unpacked
from driftline.llm.components import components

SEED = 42
#: words of a text hashed at a time
WORDS = 1 << 16
#: different fingerprints of a bucket that are compared directly
CROWD = 32


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles, repeats included.

    Words are parted by ASCII white space, A-Z are lower-cased. A text with fewer words is one shingle; without words it is 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, WORDS):
        part = words[at : min(at + WORDS, n) + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), dtype="<u8")
        bits += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, a signed 64-bit number, for every row; a null text has no words."""

    def work(batches):
        for batch in slices(batches):
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(work, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of the blocks that must agree."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(c)) for c in combinations(each, blocks - distance)]


def _near(x: str, y: str, distance: int) -> str:
    return f"bit_count({x} ^ {y}) <= {distance}"


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) between different fingerprints; their components are those of all pairs within ``distance``.

    ``fps`` has one row per fingerprint (column ``fp``).
    """
    if not 1 <= distance < blocks:
        raise ValueError("distance must be at least 1 and less than blocks")
    keys = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(m).alias("key")) for i, m in enumerate(block_masks(blocks, distance))]
    placed = fps.select("fp", F.inline(F.array(*keys)))
    shared = placed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(placed.join(shared, ["choice", "key"]), "buckets")

    paired = (
        met.where(F.col("n") <= crowd)
        .groupBy("choice", "key")
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.explode("fps").alias("u"), "fps")
        .select("u", F.explode(F.expr(f"filter(fps, x -> x > u AND {_near('x', 'u', distance)})")).alias("v"))
    )
    half = (distance + 1) // 2
    flips = [_signed(sum(1 << b for b in c)) for k in range(half + 1) for c in combinations(range(64), k)]
    around = (
        met.where(F.col("n") > crowd)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip"))
        .groupBy(F.expr("fp ^ flip").alias("middle"))
        .agg(F.collect_list("fp").alias("fps"))  # at most as many as there are flips
        .where("size(fps) > 1")
    )
    if 2 * half <= distance:  # all of a group are within the distance: a star holds it together
        crowded = around.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u < v")
        crowded = crowded.where(_near("u", "v", distance))
    else:
        crowded = around.select(F.explode("fps").alias("u"), "fps").select(
            "u", F.explode(F.expr(f"filter(fps, x -> x > u AND {_near('x', 'u', distance)})")).alias("v")
        )
    return paired.unionByName(crowded).distinct()


def near_duplicates(
    docs: DataFrame, distance: int = 2, shingle: int = 3, blocks: int = 4, crowd: int = CROWD
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, the document's own included. Null ids
    do not count for it: a component of such rows alone has a null one. Null and empty texts have fingerprint 0 and
    are linked like any other. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp"), distance, blocks, crowd))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", "n", F.coalesce("component", "fp").alias("root"), F.col("node").isNotNull().alias("met")
    )
    linked = stored(linked.where("met OR n > 1"), "nodes")  # the others stand alone
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = linked.join(least, "root").select("fp", "component_id", F.lit(True).alias("labelled"))
    return fps.join(labels, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("labelled"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, distance: int = 2, shingle: int = 3, blocks: int = 4) -> DataFrame:
    """All columns of ``docs`` for the first row of each near-duplicate component, by id (null last), then text.

    Every row is a document of its own, also where ids are null or shared: of equal rows one stays.
    """
    rows = numbered(docs)
    texts = rows.select(F.col("at").alias("doc_id"), F.col("__row.text").alias("text"))
    fps = stored(fingerprints(texts, shingle).withColumnRenamed("doc_id", "at"), "fingerprints")
    roots = components(links(fps.select("fp").distinct(), distance, blocks))
    placed = fps.join(rows.select("at", "th", F.col("__row.doc_id").cast("long").alias("doc_id")), "at")
    placed = placed.join(roots, placed.fp == roots.node, "left")
    heads = placed.groupBy(F.coalesce("component", "fp").alias("root")).agg(F.min(row_place()).alias("head"))
    return unpacked(rows.join(heads.select("head.at"), "at", "left_semi"), docs.columns)
