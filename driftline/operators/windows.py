"""Latest rows, debouncing, caps, pages and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.timeline import By, global_rank, grouped_rank, page_of, time_bucket
from driftline.schema import STATE_KEY

# Fixed value: how much longer raw config events wait.
RAW_EXTRA_MS = 300


def latest_per_path(events: DataFrame) -> DataFrame:
    """The last event of each path, as a map-side aggregation."""
    rest = [c for c in events.columns if c not in STATE_KEY]
    last = events.groupBy(*STATE_KEY).agg(F.max_by(F.struct(*rest), F.struct("ts_ms", "event_id")).alias("_l"))
    return last.select(*STATE_KEY, *[f"_l.{c}" for c in rest]).select(*events.columns)


def debounce_points() -> Column:
    """The paths whose timer an event starts: its own (``real`` 1) and, for a rename, the old one (0)."""
    own = F.struct(F.col("path").alias("key"), F.lit(1).alias("real"))
    old = F.struct(F.col("old_path").alias("key"), F.lit(0).alias("real"))
    return F.when(F.col("op") == "rename", F.array(own, old)).otherwise(F.array(own))


def debounce(events: DataFrame, delay_ms: int, is_raw: Column | None = None) -> DataFrame:
    """Events that are acted on: none follows on the same path before the delay runs out.

    A rename also cancels what waits on its old path. Raw config events wait 300 ms more. Time is cut
    in buckets no narrower than the delay, so the next event lies in the same bucket or is the first
    of the next one, and a busy path is spread over its buckets.
    """
    gap = F.lit(delay_ms) if is_raw is None else F.when(is_raw, delay_ms + RAW_EXTRA_MS).otherwise(delay_ms)
    width = max(delay_ms + (RAW_EXTRA_MS if is_raw is not None else 0), 1)
    if delay_ms <= 0 and is_raw is None:
        return events
    points = (
        events.withColumn("_p", F.explode(debounce_points()))
        .withColumns({"_key": F.col("_p.key"), "_real": F.col("_p.real"), "_gap": gap.cast("long")})
        .withColumn("_b", time_bucket(F.col("ts_ms"), width))
        .drop("_p")
    )

    key = ["vault", "device", "_key", "_b"]
    order = Window.partitionBy(*key).orderBy("ts_ms", "event_id", "_real")
    firsts = points.groupBy(*key).agg(F.min("ts_ms").alias("_first"))
    following = firsts.select("vault", "device", "_key", (F.col("_b") - 1).alias("_b"), F.col("_first").alias("_after"))
    seen = points.withColumn("_next", F.lead("ts_ms").over(order)).join(following, key, "left")
    wait = F.coalesce("_next", "_after") - F.col("ts_ms")
    kept = (F.col("_real") == 1) & ~F.coalesce((F.col("_gap") > 0) & (wait <= F.col("_gap")), F.lit(False))
    return seen.filter(kept).select(*events.columns)


def _numbered(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    ranked = grouped_rank(df, keys, [F.col("path").asc()], "_rank", ["path"])
    return ranked.withColumn(name, F.floor((F.col("_rank") - 1) / n).cast("long")).drop("_rank")


def cap_per_kind(df: DataFrame, n: int) -> DataFrame:
    """All rows, with the ``request`` that each belongs to: ``n`` notes, files and folders per device go in one, by path.

    Other kinds are not capped and go in the first, number 0.
    """
    capped = F.coalesce(F.col("kind").isin("note", "file", "folder"), F.lit(False))
    first = _numbered(df.filter(capped), ["vault", "device", "kind"], n, "request")
    return first.unionByName(df.filter(~capped).withColumn("request", F.lit(0).cast("long")))


def hash_budget(df: DataFrame, n: int) -> DataFrame:
    """All rows, with the ``round`` in which each is hashed when ``n`` per device are hashed in one, by path.

    Rows that need no hash are in the first, number 0.
    """
    first = _numbered(df.filter("needs_hash"), ["vault", "device"], n, "round")
    return first.unionByName(df.filter("NOT needs_hash").withColumn("round", F.lit(0).cast("long")))


def paginate(df: DataFrame, order: list[By | Column], page: int, page_size: int) -> DataFrame:
    """One page of rows; see ``timeline.page_of`` for the two kinds of keys."""
    return page_of(df, order, page, page_size)


def batches(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Number of the consecutive batch of ``n`` rows for each row."""
    ranked = global_rank(df, order, "_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / n).cast("long")).drop("_rank")


def log_ring(log: DataFrame, n: int) -> DataFrame:
    """All log rows, with the ``ring`` that each is in: the newest ``n`` by insertion are ring 0, the ``n`` before them ring 1."""
    ranked = global_rank(log, [F.col("first_seq").desc()], "_rank")
    return ranked.withColumn("ring", F.floor((F.col("_rank") - 1) / n).cast("long")).drop("_rank")
