"""Reading of tables, scratch tables on the shared folder, and small helpers of the operators here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import scratch_path

#: white space that parts words: blank, tab, line feed, vertical tab, form feed, carriage return
SPACES = r"[\x20\x09-\x0D]"
NOT_SPACES = r"[^\x20\x09-\x0D]"
#: rows taken from an Arrow batch at a time, so that few texts are Python objects at once
SLICE = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new folder on the shared file system and read it back.

    The lineage is cut, later readers find the files whichever executor is lost, and a
    value that was computed from a text is not computed again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(docs: DataFrame, *also: str):
    """The whole row under one name, beside the columns that an operator works with, so that no column's name can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *also)


def numbered(docs: DataFrame) -> DataFrame:
    """The whole row, a number of its own (``at``) and a hash of its text (``th``), written once, so that every reader sees the same numbers.

    Ids can be null or shared by different texts; rows are told apart by ``at``, and come by ``row_place``.
    """
    rows = whole_row(docs, F.xxhash64("text").alias("th")).withColumn("at", F.monotonically_increasing_id())
    return stored(rows, "rows")


def row_place() -> Column:
    """Order of rows: by id, null last, then by text, then as they came."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "at")


def unpacked(df: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns of ``whole_row`` again, some of them replaced."""
    return df.select(*((new[c] if c in new else F.col(f"__row.`{c}`")).alias(c) for c in columns))


#: ways to drop what operators keep in a Python worker, by the operator's module
KEPT: dict[str, Callable[[], None]] = {}
#: rows of texts in an Arrow batch
BATCH = 1000


def short_batches(spark: SparkSession) -> None:
    """Texts are long, so fewer rows than usual go to Python at once; both sides hold a batch in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, holds: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of batches. A worker is used again for other operators, so what those left in it is dropped; ``holds`` names the own."""
    for name, drop in KEPT.items():
        if name != holds:
            drop()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(col: str = "text"):
    """The text as bytes; a null text counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary").alias(col)


def parts_of(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
