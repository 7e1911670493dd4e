"""Streams built from Spark's own windows, joins and aggregations.

Event time is the timestamp column ``ts``; ``late`` is how far behind it rows may come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.messages import log_category
from driftline.operators.acks import ECHO_MS
from driftline.operators.aggregates import merge_log_columns
from driftline.operators.state import apply_folded, fold_again, fold_changes, state_changes
from driftline.operators.windows import RAW_EXTRA_MS, debounce_points
from driftline.schema import STATE_KEY


def debounce_stream(events: DataFrame, delay_ms: int, late: str, is_raw: Column | None = None) -> DataFrame:
    """The batch ``debounce`` on a live feed.

    Events of a path whose distance is within the delay form one session; the event that is acted on
    is its last. So a session window with the delay as gap is the timer. A rename closes the session of
    its old path with a row that shows nothing.
    """
    if delay_ms <= 0 and is_raw is None:
        return events
    plain = f"{delay_ms} milliseconds"
    gap = F.lit(plain) if is_raw is None else F.when(is_raw, f"{delay_ms + RAW_EXTRA_MS} milliseconds").otherwise(plain)
    flat = events.withWatermark("ts", late).withColumn("_gap", gap).withColumn("_p", F.explode(debounce_points()))
    rest = [c for c in events.columns if c not in ("vault", "device")]
    sessions = flat.groupBy("vault", "device", F.col("_p.key").alias("_key"), F.session_window("ts", F.col("_gap"))).agg(
        F.max_by(F.struct(*rest, F.col("_p.real").alias("_real")), F.struct("ts", "event_id", F.col("_p.real").alias("r"))).alias("_l")
    )
    return sessions.filter("_l._real = 1").select("vault", "device", *[f"_l.{c}" for c in rest]).select(*events.columns)


def drop_following_stream(
    events: DataFrame, marks: DataFrame, late: str, window_ms: int, ops: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """The batch ``drop_following`` on feeds.

    Events of ``ops`` wait in an outer interval join until no mark can come any more; other events pass
    at once.
    """
    window = F.expr(f"INTERVAL {window_ms} MILLISECONDS")
    watched = F.col("op").isin(list(ops))
    mine = events.filter(watched).withWatermark("ts", late)
    near = marks.withWatermark("ts", late).select(*[F.col(c).alias(f"r_{c}") for c in (*keys, "ts")])
    same = F.col("r_ts").between(F.col("ts") - window, F.col("ts"))
    for c in keys:
        same = same & (F.col(c) == F.col(f"r_{c}"))
    kept = mine.join(near, same, "left_outer").filter(F.col("r_ts").isNull()).select(*events.columns)
    return kept.unionByName(events.filter(~watched))


def echo_stream(local: DataFrame, remote: DataFrame, late: str, window_ms: int = ECHO_MS) -> DataFrame:
    """Local events that are no echo of a remote apply just before."""
    ops = ["delete", "rename"]
    applied = remote.filter(F.col("op").isin(ops))
    return drop_following_stream(local, applied, late, window_ms, ops, [*STATE_KEY, "op"])


def shadow_stream(events: DataFrame, late: str, delay_ms: int) -> DataFrame:
    """Events without the writes that come while a rename to their path still waits."""
    renames = events.filter(F.col("op") == "rename")
    return drop_following_stream(events, renames, late, delay_ms, ["modify", "create"], STATE_KEY)


def log_stream(log_events: DataFrame) -> DataFrame:
    """Merged log rows, kept up to date per id (update mode). Every id stays in the state; see :func:`final_log` for feeds without end."""
    merged = log_events.groupBy("id").agg(*[c.alias(n) for n, c in merge_log_columns().items()])
    return merged.withColumn("category", log_category(F.col("action")))


def final_log(log_events: DataFrame, life_ms: int, late: str | None = None, at: str = "at") -> DataFrame:
    """Merged log rows that come out once, when no row of their id has come for ``life_ms`` (append mode).

    The state then forgets the id, so it holds the ids of the last ``life_ms`` and ``late`` only, however long the feed. A row that
    comes for a forgotten id opens a new entry of that id; one before the watermark is dropped. ``at`` is a
    timestamp; without ``late`` the same is computed for a table.
    """
    rows = log_events if late is None else log_events.withWatermark(at, late)
    life = F.session_window(at, f"{life_ms} milliseconds")
    merged = rows.groupBy("id", life).agg(*[c.alias(n) for n, c in merge_log_columns().items()]).drop("session_window")
    return merged.withColumn("category", log_category(F.col("action")))


def watermark_stream(messages: DataFrame) -> DataFrame:
    """Highest acknowledged time per (vault, device, kind) (update mode)."""
    return messages.groupBy("vault", "device", "kind").agg(F.max("last_time").alias("last_time"))


def latest_changes(events: DataFrame) -> DataFrame:
    """What events change, folded to one row per path. Doubled events change nothing."""
    return fold_changes(state_changes(events))


def state_after(base: DataFrame, changes: DataFrame) -> DataFrame:
    """State from a base and the folded changes of all batches: what ``apply_events`` gives for all their events.

    The latest change of a path counts, whatever batch it came in, so rows that came late lose; a
    rename or ``mtime`` event without a hash finds it as there.
    """
    return apply_folded(base, fold_again(changes))
