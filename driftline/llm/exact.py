"""Exact duplicates of texts, batch by batch (operator 6).

Documents come in batches. A batch that is done is an immutable snapshot: its digests lie in buckets, each with
a static binary fuse filter. Digests of a new batch are first grouped among themselves, so that a text
that comes a million times is one row; the filters of the earlier snapshots then screen them, and only
the positives are looked up in the exact buckets. Texts move only where digests are equal: there the
bytes decide.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm import fuse
from driftline.llm.common import SPACES, stored

#: digests in a bucket and its filter, about
BUCKET = 1 << 17
#: digests that are sent to every executor, about 100 bytes each; more of them are joined by a shuffle
SENT = 200_000
#: tasks that rows of one digest go to in that shuffle
SALTS = 64


def normalised(col: str = "text") -> Column:
    """The text with each run of ASCII white space as one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), f"{SPACES}+", " ")


def bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return digests.withColumns({"key": key, "bucket": F.pmod(key, F.lit(buckets))})


def filters_of(snapshot: DataFrame) -> DataFrame:
    """One row per bucket: its filter. ``snapshot`` has ``bucket`` and ``key``, each key once."""

    def build(key, rows):
        keys = rows["key"].to_numpy(dtype=np.int64).view(np.uint64)
        return pd.DataFrame({"bucket": [key[0]], "filter": [fuse.build(keys)]})

    return snapshot.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket long, filter binary")


def screened(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests of ``incoming`` that may be in the snapshot: all that are, and about one in 256 of the others."""

    def screen(rows, filter_):
        if not len(filter_):
            return rows[["digest"]].iloc[:0]
        keys = rows["key"].to_numpy(dtype=np.int64).view(np.uint64)
        return rows.loc[fuse.contains(filter_["filter"].iloc[0], keys), ["digest"]]

    left = incoming.select("bucket", "key", "digest").groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(screen, "digest string")


def suspects(rows: DataFrame, batches: int) -> DataFrame:
    """Digests that more than one row has. ``rows``: ``doc_id``, ``digest``, ``copies``."""
    cuts = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]) if batches > 1 else F.lit(None)).first()[0]
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + F.coalesce(F.col("doc_id") > cut, F.lit(True)).cast("int")
    grouped = stored(
        rows.groupBy(batch.alias("batch"), "digest").agg(F.sum("copies").alias("n"), F.count("*").alias("ids")), "digests"
    )
    sizes = {r["batch"]: r["n"] for r in grouped.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    buckets = max([1, *(-(-n // BUCKET) for n in sizes.values())])
    found = grouped.where("n > 1").select("digest")
    done: list[tuple[DataFrame, DataFrame]] = []
    for i in range(batches):
        new = bucketed(grouped.where(F.col("batch") == i), buckets)
        for old, filters in done:
            positive = screened(new, filters)
            found = found.unionByName(old.join(positive, "digest", "left_semi").select("digest"))
        if i + 1 < batches:
            done.append((new, stored(filters_of(new), "filters")))
    return found.distinct()


def exact_groups(
    docs: DataFrame, batches: int = 2, digest: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Batches follow ``doc_id``; null ids come last. ``keep_id`` is the smallest id of the rows with the same
    normalised text; where all of them are null it is null. Of rows that repeat both id and text one is
    kept. An empty table gives no rows; other columns are not read. ``digest`` makes the digest
    from the SHA-256 of the text; it may be weak, as bytes decide (tests use one that collides).
    """
    digest = digest or (lambda sha: sha)
    sha = F.sha2(normalised(), 256)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("text_sha256"))
        .groupBy("doc_id", "text_sha256")
        .agg(F.count("*").alias("copies"))
        .withColumn("digest", digest(F.col("text_sha256")))
    )
    rows = stored(rows, "sha")
    found = stored(suspects(rows, batches), "suspects")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("bytes"))
    texts = texts.withColumn("digest", digest(F.sha2("bytes", 256)))
    if found.limit(SENT + 1).count() <= SENT:
        suspect = texts.join(F.broadcast(found), "digest", "left_semi")
    else:  # copies of one text go to many tasks
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        suspect = texts.withColumn("salt", salt).join(salted.hint("shuffle_hash"), ["digest", "salt"], "left_semi")
    same = (
        suspect
        .groupBy("digest", "bytes")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    same = stored(same.select("digest", "keep_id", "group_size", F.sha2("bytes", 256).alias("text_sha256")), "same")
    # equal digests of different bytes are told apart by the SHA-256 of the bytes in each group
    clash = same.groupBy("digest", "text_sha256").agg(F.count("*").alias("n")).where("n > 1")
    if not clash.isEmpty():
        raise ValueError("two texts with one SHA-256: choose another digest")
    groups = rows.join(same.drop("digest"), "text_sha256", "left")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return groups.select(
        "doc_id", F.coalesce("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id"))).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256", copy,
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )
