"""Set operations on listings and on sets of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.schema import STATE_KEY


def union_manifest(configs: DataFrame, virtual: DataFrame, *others: DataFrame) -> DataFrame:
    """Config files, virtual entries and any other listings as one manifest."""
    out = configs.unionByName(virtual)
    for other in others:
        out = out.unionByName(other)
    return out


def set_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Members that were ``added`` or ``removed``; no rows for equal sets. One join for both."""
    keys = old.columns
    a = old.distinct().withColumn("_a", F.lit(True))
    b = new.select(*keys).distinct().withColumn("_b", F.lit(True))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def replace_set(
    old: DataFrame, new: DataFrame | None = None, add: DataFrame | None = None, remove: DataFrame | None = None
) -> DataFrame:
    """A set after full replacement, or after members were added or removed."""
    keys = old.columns
    out = (new.select(*keys) if new is not None else old).distinct()
    if add is not None:
        out = out.unionByName(add.select(*keys)).distinct()
    if remove is not None:
        out = out.join(remove.select(*keys), keys, "left_anti")
    return out


def intersect_tracked(state: DataFrame, listing: DataFrame) -> DataFrame:
    """State rows whose path is still there."""
    return state.join(listing.select(*STATE_KEY), STATE_KEY, "left_semi")
