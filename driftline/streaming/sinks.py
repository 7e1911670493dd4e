"""Sinks that can be replayed: a batch that runs twice writes the same files twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, off the heap. The stateful processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Final rows as Parquet files."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()


def write_upserts(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Changed rows of each batch, in a folder named by the batch.

    Only what changed is written, nothing is read back; :func:`read_upserts` picks the last row per key.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("update").start()


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(*keys, *[f"_l.{c}" for c in rest])


def _folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Folders ``name=number`` below a path of any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return {}
    found = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith(f"{name}=")]
    return {int(p.getName().split("=")[1]): p.toString() for p in found}


def _status(spark: SparkSession, path: str, name: str = ""):
    """File system, path and status of a file, status null if it is not there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}" if name else path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, where, fs.getFileStatus(where) if fs.exists(where) else None


def _whole_folds(spark: SparkSession, path: str) -> dict[int, tuple[str, int]]:
    """Folds that are written to their end, with the time of that."""
    found = {n: (p, _status(spark, p, "_SUCCESS")[2]) for n, p in _folders(spark, f"{path}-folds", "upto").items()}
    return {n: (p, mark.getModificationTime()) for n, (p, mark) in found.items() if mark is not None}


def fold_state_changes(spark: SparkSession, path: str, upto: int, grace_ms: int = 0) -> None:
    """Fold the changes of all batches up to ``upto`` (and an earlier fold) to the last per path, then drop what no reader holds.

    Batches after ``upto`` may be written meanwhile. Until the fold is whole, readers take the batches; then
    they take the fold, whether or not the folded batches are gone already. A fold that is there is not written again, so
    its readers are safe from a repeated call. With a grace, files that a fold replaced stay for readers that began before it.
    """
    if upto not in _whole_folds(spark, path):
        read_state_changes(spark, path, upto).write.mode("overwrite").parquet(f"{path}-folds/upto={upto}")
    drop_folded(spark, path, grace_ms)


def drop_folded(spark: SparkSession, path: str, grace_ms: int = 0) -> None:
    """Drop batches and folds that a later fold holds, if that fold has been whole for ``grace_ms``."""
    now = spark.sparkContext._jvm.java.lang.System.currentTimeMillis()
    settled = [n for n, (_, at) in _whole_folds(spark, path).items() if at <= now - grace_ms]
    last = max(settled, default=-1)
    old = [p for n, p in _folders(spark, f"{path}-folds", "upto").items() if n < last]
    for p in [*old, *(p for n, p in _folders(spark, path, "batch").items() if n <= last)]:
        fs, where, _ = _status(spark, p)
        fs.delete(where, True)


def read_state_changes(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The last whole fold and the batches after it, up to ``upto`` or all.

    The table is the version of this call: which files it reads is settled here, so later batches and folds do not change it.
    """
    from driftline.operators.state import fold_again

    folds = {n: p for n, (p, _) in _whole_folds(spark, path).items() if upto is None or n <= upto}
    last = max(folds, default=-1)
    paths = [p for n, p in _folders(spark, path, "batch").items() if n > last and (upto is None or n <= upto)]
    return fold_again(spark.read.parquet(*([folds[last]] if folds else []), *paths))


def write_state_changes(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Puts and removes of each batch, folded to the last per path (see ``streaming.feeds.state_stream``)."""
    from driftline.streaming.feeds import latest_changes

    def save(batch: DataFrame, batch_id: int) -> None:
        latest_changes(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
