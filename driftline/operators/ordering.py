"""Orders of logs, paths, versions, records and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.paths import depth_of
from driftline.functions.reports import numeric_parts
from driftline.operators.timeline import By, global_rank, page_of

# Fixed value: how far a summary is moved up.
SUMMARY_LEAD_MS = 2000


def log_keys() -> list[By]:
    """Newest first; a summary goes before rows up to two seconds newer."""
    summary = F.col("category") == "summary"
    key = F.col("timestamp") + F.when(summary, SUMMARY_LEAD_MS).otherwise(0)
    return [By(key, True), By(F.when(summary, 1).otherwise(0), True), By(F.col("first_seq"), True)]


def log_order() -> list[Column]:
    return [k.sort for k in log_keys()]


def order_log(log: DataFrame) -> DataFrame:
    return log.orderBy(*log_order())


def log_page(log: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page of the log, newest first."""
    return page_of(log, log_keys(), page, page_size)


def top_paths(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` shortest matches."""
    return found.orderBy(F.length("shown"), "shown", "vault").limit(k)


def version_key(version: Column) -> Column:
    """Numeric parts of a version, comparable as an array; zeros at the end do not count."""
    parts = numeric_parts(F.trim(F.regexp_replace(version, r"(?i)\Av", "")))
    used = F.array_max(F.transform(parts, lambda p, i: F.when(p != 0, i + 1).otherwise(0)))
    return F.slice(parts, F.lit(1), used)


def order_versions(versions: DataFrame, latest: str, version: str = "version") -> DataFrame:
    """Versions other than the latest with their ``position``, newest first."""
    clean = F.trim(F.regexp_replace(F.col(version), r"(?i)\Av", ""))
    target = latest[1:] if latest[:1] in ("v", "V") else latest
    others = versions.filter(clean != target.strip()).withColumn("_key", version_key(F.col(version)))
    return global_rank(others, [F.col("_key").desc(), F.col(version).asc()], "position").drop("_key").orderBy("position")


def top_records(
    amounts: DataFrame, as_of: Column, sort_by: str = "amount_3m", page: int = 1, page_size: int = 10
) -> DataFrame:
    """Page of payers by amount of all time or of the last three months before ``as_of``, highest first.

    ``amounts`` has ``name``, ``paid_at`` and ``cents``.
    """
    if sort_by not in ("amount", "amount_3m"):
        raise ValueError("sort_by is amount or amount_3m")
    recent = (F.col("paid_at") > F.add_months(as_of, -3)) & (F.col("paid_at") <= as_of)
    sums = amounts.groupBy("name").agg(
        F.sum("cents").alias("amount"),
        F.coalesce(F.sum(F.when(recent, F.col("cents"))), F.lit(0)).cast("long").alias("amount_3m"),
    )
    return page_of(sums, [By(F.col(sort_by), True), By(F.col("name"))], page, page_size)


def apply_order(decisions: DataFrame) -> DataFrame:
    """Add ``phase`` and ``step`` in which decisions can be applied, and sort by them.

    Folders come first, then notes, files and config. Folders are made from the top; folders to delete
    come last, from the deepest, as only an empty folder is deleted.
    """
    deleting = (F.col("kind") == "folder") & (F.col("outcome") == "Delete")
    phase = (
        F.when(deleting, 4)
        .when(F.col("kind") == "folder", 0)
        .when(F.col("kind") == "note", 1)
        .when(F.col("kind") == "file", 2)
        .otherwise(3)
    )
    depth = depth_of(F.col("path"))
    step = F.when(deleting, -depth).when(F.col("kind") == "folder", depth).otherwise(0)
    return decisions.withColumn("phase", phase).withColumn("step", step).orderBy("vault", "phase", "step", "path")
