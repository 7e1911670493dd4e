"""The state map as JSON and as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.skew import join_facts

#: entries put in one JSON map on export
ENTRIES_PER_MAP = 50_000


def load_state(maps: DataFrame, column: str = "json") -> DataFrame:
    """State rows of JSON maps ``{path: {hash, mtime, size}}``; other columns of ``maps`` stay.

    An old value is the hash text alone. It gets mtime and size 0, so it is hashed again.
    """
    rest = [c for c in maps.columns if c != column]
    entries = maps.select(*rest, F.explode(F.from_json(column, "map<string,string>")).alias("path", "_v"))
    parsed = F.from_json("_v", "hash string, mtime long, size long")
    return entries.withColumn("_p", parsed).select(
        *rest,
        "path",
        F.coalesce("_p.hash", "_v").alias("hash"),
        F.coalesce("_p.mtime", F.lit(0)).cast("long").alias("mtime"),
        F.coalesce("_p.size", F.lit(0)).cast("long").alias("size"),
    )


def load_folder_state(maps: DataFrame, column: str = "json") -> DataFrame:
    """Folder rows of JSON maps ``{path: mtime}``."""
    rest = [c for c in maps.columns if c != column]
    return maps.select(*rest, F.explode(F.from_json(column, "map<string,long>")).alias("path", "mtime"))


def state_maps(state: DataFrame, per_map: int = ENTRIES_PER_MAP) -> DataFrame:
    """State as JSON maps. A large device is cut in as many maps as its row count asks for, so no
    map grows without bound; :func:`load_state` reads any number of them."""
    key = ["vault", "device"]
    shards = state.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(per_map)).cast("long").alias("_n"))
    cut = join_facts(state, shards, key, ["path"], "inner").withColumn("shard", F.pmod(F.xxhash64("path"), F.col("_n")))
    entry = F.struct(F.col("path").alias("key"), F.struct("hash", "mtime", "size").alias("value"))
    return cut.groupBy(*key, "shard").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))


def store_state(state: DataFrame, path: str) -> None:
    """State as Parquet by vault. Each file holds one range of devices and paths, so that path ranges prune files and row groups."""
    key = ["vault", "device", "path"]
    state.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").partitionBy("vault").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("device string, path string, hash string, mtime long, size long, vault string").parquet(path)
