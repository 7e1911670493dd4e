"""Counts, summaries, progress, watermarks and merged logs.

All are aggregations with partial results before the shuffle, so a hot key costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.messages import log_category
from driftline.operators.skew import join_facts

KINDS = ["note", "file", "config", "folder"]
# Outcome of a decision -> counter of the round.
COUNTERS = {"need_upload": ["NeedPush", "Merge"], "need_modify": ["Modify"], "need_mtime": ["Mtime"], "need_delete": ["Delete"]}


def task_counts(decisions: DataFrame, totals: bool = False) -> DataFrame:
    """Upload, modify, mtime and delete counts per vault and kind; with ``totals``, also per vault
    (kind null) and over all (both null)."""
    counts = [F.count_if(F.col("outcome").isin(names)).alias(c) for c, names in COUNTERS.items()]
    grouped = decisions.rollup("vault", "kind") if totals else decisions.groupBy("vault", "kind")
    return grouped.agg(*counts)


def round_summary(counts: DataFrame, sync_type: str) -> DataFrame:
    """Summary message per vault: upload, modify (with mtime) and delete of notes, files and config."""

    def total(kind: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("long")

    parts = {
        kind: F.struct(
            total(kind, F.col("need_upload")).alias("upload"),
            total(kind, F.col("need_modify") + F.col("need_mtime")).alias("modify"),
            total(kind, F.col("need_delete")).alias("delete"),
        )
        for kind in KINDS[:3]
    }
    grouped = counts.groupBy("vault").agg(*[p.alias(k) for k, p in parts.items()])
    changed = F.lit(False)
    for k in parts:
        changed = changed | (F.col(f"{k}.upload") > 0) | (F.col(f"{k}.modify") > 0) | (F.col(f"{k}.delete") > 0)
    message = F.to_json(
        F.struct(F.lit(sync_type).alias("syncType"), changed.alias("hasChanges"), *[F.col(k) for k in parts])
    )
    return grouped.select("vault", changed.alias("has_changes"), message.alias("message"))


def progress(modules: DataFrame, rounds: DataFrame) -> DataFrame:
    """Percent done per (vault, device).

    ``modules`` has total, completed and ended per kind; ``rounds`` the switches ``sync_enabled``,
    ``config_enabled``, ``preview`` and the chunk counters ``total_chunks``, ``done_chunks``,
    ``open_sessions``. A module counts 0 until its end came. Chunks are work units of files.
    """
    rows = modules.join(rounds, ["vault", "device"])
    is_file = F.col("kind") == "file"
    active = (
        F.when(F.col("kind") == "config", F.col("config_enabled"))
        .when(is_file, F.col("sync_enabled") & ~F.col("preview"))
        .otherwise(F.col("sync_enabled"))
    )
    total = F.col("total") + F.when(is_file, F.col("total_chunks")).otherwise(0)
    done = F.col("completed") + F.when(is_file, F.col("done_chunks")).otherwise(0)
    share = F.when(F.col("ended"), F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(1.0)).otherwise(0.0)
    grouped = (
        rows.filter(active)
        .groupBy("vault", "device")
        .agg(
            F.sum(share).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.bool_and("ended").alias("_ended"),
            F.bool_and((F.col("total_chunks") == 0) | (F.col("done_chunks") >= F.col("total_chunks"))).alias("_chunks"),
            F.bool_and(F.col("open_sessions") == 0).alias("_idle"),
        )
    )
    overall = F.round(F.col("_sum") / F.col("_n") * 100, 9)
    nearly = F.col("_ended") & F.col("_chunks") & F.col("_idle") & (overall > 90)
    percent = F.when(nearly, 100).otherwise(F.least(F.lit(100), F.floor(overall))).cast("long")
    idle = rounds.select("vault", "device")
    return idle.join(grouped.select("vault", "device", percent.alias("percent")), ["vault", "device"], "left").fillna(
        0, ["percent"]
    )


def task_totals(modules: DataFrame) -> DataFrame:
    return modules.groupBy("vault", "device").agg(
        F.sum("total").alias("total"), F.sum("completed").alias("completed")
    )


def scan_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("vault", "device").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in KINDS]
    )


def chunk_progress(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct chunks received per session, percent and status; sessions without chunks are at 0."""
    got = chunks.groupBy("session_id").agg(F.countDistinct("chunk_index").alias("received"))
    total = F.col("total_chunks")
    joined = sessions.join(got, "session_id", "left").withColumn("received", F.coalesce("received", F.lit(0)).cast("long"))
    return joined.select(
        *sessions.columns, "received",
        F.when(total == 0, 100).otherwise(F.floor(F.col("received") / total * 100)).cast("long").alias("percent"),
        F.when(F.col("received") == total, "success").otherwise("pending").alias("status"),
    )


def advance_watermarks(events: DataFrame, ends: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Watermark per (vault, device, kind) after messages.

    Each message lifts it when its time is later. The end of a round sets it, also downwards; for
    config only when the round had work. So the last end counts, and messages after it.
    """
    key = ["vault", "device", "kind"]
    counted = ends.filter((F.col("kind") != "config") | (F.col("n_tasks") > 0))
    last = counted.groupBy(*key).agg(
        F.max_by("last_time", F.struct("ts_ms", "seq")).alias("_end"), F.max(F.struct("ts_ms", "seq")).alias("_at")
    )
    later = join_facts(events, last.select(*key, "_at"), key, ["ts_ms", "seq"]).filter(
        F.col("_at").isNull() | (F.struct("ts_ms", "seq") > F.col("_at"))
    )
    seen = later.groupBy(*key).agg(F.max("last_time").alias("_seen"))
    kept = watermarks.select(*key, F.col("last_time").alias("_kept"))
    start = F.coalesce(F.col("_end"), F.col("_kept"), F.lit(0))
    return (
        kept.join(last, key, "full_outer")
        .join(seen, key, "full_outer")
        .select(*key, F.greatest(start, F.col("_seen")).alias("last_time"))
    )


def chunk_plan(manifest: DataFrame, chunk_size: int) -> DataFrame:
    """Number of chunks of each file; an empty file has one."""
    return manifest.withColumn(
        "n_chunks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / F.lit(chunk_size)).cast("long"))
    )


def chunk_totals(manifest: DataFrame, chunk_size: int) -> DataFrame:
    return (
        chunk_plan(manifest, chunk_size)
        .groupBy("vault", "device")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chunks").alias("n_chunks"))
    )


FINAL = ["success", "error"]


def merge_log_columns() -> dict[str, Column]:
    """Aggregates that fold the rows of one log id; shared by the batch and the streaming form."""
    seq = F.col("seq")

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), seq))

    final = F.max_by("status", F.when(F.col("status").isin(FINAL), seq))
    opened_done = F.min_by(F.col("status").isNull(), seq)
    return {
        "timestamp": F.min_by("ts", seq),
        "type": last("type"),
        "action": last("action"),
        "path": last("path"),
        "status": F.coalesce(final, F.when(opened_done, "success"), F.lit("pending")),
        "progress": F.max("progress"),
        "message": last("message"),
        "vault": last("vault"),
        "first_seq": F.min("seq"),
    }


def merge_log(log_events: DataFrame) -> DataFrame:
    """One row per log id: the first time, the last given fields, the highest progress, and a status
    that never goes back to pending. The first row without a status counts as a success."""
    merged = log_events.groupBy("id").agg(*[c.alias(n) for n, c in merge_log_columns().items()])
    return merged.withColumn("category", log_category(F.col("action")))


def page_totals(df: DataFrame, page_size: int) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total_rows"), F.greatest(F.lit(1), F.ceil(n / F.lit(page_size))).cast("long").alias("total_pages")
    )


def client_counts(clients: DataFrame) -> DataFrame:
    """Connected clients by type and platform, and over all (both null)."""
    return clients.groupingSets([["client_type", "platform"], []], "client_type", "platform").agg(
        F.count(F.lit(1)).alias("n_clients")
    )
