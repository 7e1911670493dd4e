"""Changes of the acknowledged state: events, round ends, clearing, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.paths import ancestors
from driftline.operators.rules import RuleBook, is_excluded
from driftline.schema import STATE_KEY

# Fixed value: how long an upload can be resumed.
CHECKPOINT_MS = 20 * 60 * 1000
FIELDS = ["hash", "mtime", "size"]


def state_changes(events: DataFrame) -> DataFrame:
    """Events as puts and removes of single paths; a rename is a remove and a put."""
    parts = F.when(
        F.col("op") == "rename",
        F.array(
            F.struct(F.col("old_path").alias("p"), F.lit(False).alias("put"), F.lit(0).alias("part")),
            F.struct(F.col("path").alias("p"), F.lit(True).alias("put"), F.lit(1).alias("part")),
        ),
    ).otherwise(
        F.array(F.struct(F.col("path").alias("p"), (F.col("op") != "delete").alias("put"), F.lit(0).alias("part")))
    )
    flat = events.withColumn("_c", F.explode(parts))
    return flat.select(
        "vault",
        "device",
        F.col("_c.p").alias("path"),
        F.col("_c.put").alias("is_put"),
        F.when(F.col("_c.put"), F.col("content_hash")).alias("hash"),
        F.when(F.col("_c.put") & (F.col("op") == "rename"), F.col("old_path")).alias("moved_from"),
        F.col("mtime"),
        F.col("size"),
        F.struct("ts_ms", "event_id", F.col("_c.part").alias("part")).alias("order_key"),
    )


def fold_changes(changes: DataFrame) -> DataFrame:
    """One row per path: its last change (``last``) and the last one that says what its hash is (``defining``), each with its place in time.

    A map-side aggregation. Folded rows fold again (:func:`fold_again`), so changes of many batches can be folded batch by batch.
    """
    defining = ~F.col("is_put") | F.col("hash").isNotNull() | F.col("moved_from").isNotNull()
    return fold_again(
        changes.select(
            *STATE_KEY, F.struct("is_put", "mtime", "size").alias("last"), F.col("order_key").alias("last_key"),
            F.struct("is_put", "hash", "moved_from").alias("defining"), F.when(defining, F.col("order_key")).alias("defining_key"),
        )
    )


def fold_again(folded: DataFrame) -> DataFrame:
    return folded.groupBy(*STATE_KEY).agg(
        F.max_by("last", "last_key").alias("last"), F.max("last_key").alias("last_key"),
        F.max_by("defining", "defining_key").alias("defining"), F.max("defining_key").alias("defining_key"),
    )


def apply_folded(state: DataFrame, folded: DataFrame) -> DataFrame:
    """The state after changes that are folded to one row per path (see :func:`apply_events`)."""
    last = folded.select(*STATE_KEY, F.col("last").alias("_l"), F.when(F.col("defining_key").isNotNull(), F.col("defining")).alias("_d"))
    # Only renames without a hash look at their old path. The other rows get a key of their own that
    # meets nothing: one null key would bring all of them to one task.
    asks = F.col("_d.hash").isNull() & F.col("_d.moved_from").isNotNull()
    last = last.withColumn("_from", F.when(asks, F.col("_d.moved_from")).otherwise(F.concat(F.char(F.lit(0)), F.col("path"))))
    old = state.select("vault", "device", F.col("path").alias("_from"), F.col("hash").alias("_moved"))
    last = last.join(old, ["vault", "device", "_from"], "left").drop("_from")

    current = state.select(*STATE_KEY, F.struct(*FIELDS).alias("_s"))
    put_hash = F.coalesce(F.col("_d.hash"), F.col("_moved"))
    own_hash = F.when(F.col("_d").isNull(), F.col("_s.hash")).when(F.col("_d.is_put"), put_hash)
    changed = F.col("_l").isNotNull()
    return (
        current.join(last, STATE_KEY, "full_outer")
        .filter(~changed | F.col("_l.is_put"))
        .select(
            *STATE_KEY,
            F.when(changed, own_hash).otherwise(F.col("_s.hash")).alias("hash"),
            F.when(changed, F.col("_l.mtime")).otherwise(F.col("_s.mtime")).alias("mtime"),
            F.when(changed, F.coalesce("_l.size", "_s.size")).otherwise(F.col("_s.size")).alias("size"),
        )
        .filter(F.col("hash").isNotNull())
    )


def apply_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state after events. The last event of a path decides.

    A rename without a hash takes the one its old path had in ``state``; an ``mtime`` event without a
    hash keeps the last one of the path. The last event per path is found by a map-side aggregation.
    """
    return apply_folded(state, fold_changes(state_changes(events)))


def _type_suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^.]+)\z", 1)


def classify_renames(events: DataFrame, book: RuleBook) -> DataFrame:
    """Renames as the messages they lead to; other events pass.

    Into an excluded place: delete of the old path. Out of one: create. Between two: nothing. With
    another extension: delete and create. Else the rename itself.
    """
    new_out, old_out = is_excluded(F.col("path"), book), is_excluded(F.col("old_path"), book)

    def item(op: str, path: str, old: bool = False) -> Column:
        return F.struct(
            F.lit(op).alias("op"),
            F.col(path).alias("path"),
            (F.col("old_path") if old else F.lit(None).cast("string")).alias("old_path"),
        )

    none = F.filter(F.array(item("rename", "path", True)), lambda _: F.lit(False))
    retyped = _type_suffix(F.col("path")) != _type_suffix(F.col("old_path"))
    renamed = (
        F.when(new_out & old_out, none)
        .when(new_out, F.array(item("delete", "old_path")))
        .when(old_out, F.array(item("create", "path")))
        .when(retyped, F.array(item("delete", "old_path"), item("create", "path")))
        .otherwise(F.array(item("rename", "path", True)))
    )
    other = F.array(F.struct(F.col("op"), F.col("path"), F.col("old_path")))
    messages = F.when(F.col("op") == "rename", renamed).otherwise(other)
    kept = [c for c in events.columns if c not in ("op", "path", "old_path")]
    return events.select(*kept, F.explode(messages).alias("_m")).select(*kept, "_m.op", "_m.path", "_m.old_path")


def commit_round(state: DataFrame, pending: DataFrame, scanned: DataFrame, deletes: DataFrame) -> DataFrame:
    """The state after the end of a round: confirmed deletes go, pending rows are put, then scanned rows
    where they are not older. All four tables meet in one aggregation, at most a few rows per key."""

    def tagged(df: DataFrame, tag: str) -> DataFrame:
        blank = [F.lit(None).cast(t).alias(f) for f, t in zip(FIELDS, ("string", "long", "long"))]
        return df.select(*STATE_KEY, *(blank if tag == "del" else FIELDS), F.lit(tag).alias("_tag"))

    rows = tagged(state, "state").unionByName(tagged(pending, "pend")).unionByName(tagged(scanned, "scan"))
    rows = rows.unionByName(tagged(deletes, "del"))
    row = F.struct("mtime", "hash", "size")

    def of(tag: str) -> Column:
        return F.max(F.when(F.col("_tag") == tag, row))

    grouped = rows.groupBy(*STATE_KEY).agg(
        of("state").alias("_state"), of("pend").alias("_pend"), of("scan").alias("_scan"),
        F.bool_or(F.col("_tag") == "del").alias("_del"),
    )
    kept = F.coalesce(F.col("_pend"), F.when(~F.col("_del"), F.col("_state")))
    use_scan = F.col("_scan").isNotNull() & (F.col("_kept").isNull() | (F.col("_kept.mtime") <= F.col("_scan.mtime")))
    return (
        grouped.withColumn("_kept", kept)
        .withColumn("_row", F.when(use_scan, F.col("_scan")).otherwise(F.col("_kept")))
        .filter(F.col("_row").isNotNull())
        .select(*STATE_KEY, *[f"_row.{f}" for f in FIELDS])
    )


def clear_state(state: DataFrame, scope: str, vault: str | None = None) -> DataFrame:
    """State rows left after clearing: ``all`` rows, or the ``config`` rows, of one vault or of all."""
    if scope not in ("all", "config"):
        raise ValueError("scope is all or config")
    hit = F.lit(True) if scope == "all" else F.col("kind") == "config"
    if vault is not None:
        hit = hit & (F.col("vault") == vault)
    return state.filter(~hit)


def reset_watermarks(watermarks: DataFrame, scope: str = "all", vault: str | None = None) -> DataFrame:
    """Watermarks set back to 0 for all kinds, or for ``config`` only."""
    hit = F.lit(True) if scope == "all" else F.col("kind") == "config"
    if vault is not None:
        hit = hit & (F.col("vault") == vault)
    return watermarks.withColumn("last_time", F.when(hit, F.lit(0).cast("long")).otherwise(F.col("last_time")))


def empty_folders(folders: DataFrame, files: DataFrame, config_dir: str) -> DataFrame:
    """Plugin and theme folders that hold neither files nor folders."""
    under = F.col("path").rlike(r"\A" + config_dir.replace(".", r"\.") + r"/(?:plugins|themes)/[^/]+\z")
    holds = files.select("vault", "device", "path").unionByName(folders.select("vault", "device", "path"))
    full = holds.select("vault", "device", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return folders.filter(under).join(full, STATE_KEY, "left_anti")


def expire_checkpoints(checkpoints: DataFrame, uploads: DataFrame, now: int) -> DataFrame:
    """Uploads with the chunk to start from.

    A checkpoint without time or older than 20 minutes is dropped. It counts when session and content
    hash are the upload's and its chunk is not the last; the upload then goes on with the next chunk.
    """
    stamp = F.col("timestamp")
    alive = checkpoints.filter((stamp != 0) & (F.lit(now) - stamp <= CHECKPOINT_MS)).select(
        "vault", "device", "path_hash",
        F.col("session_id").alias("_session"), F.col("content_hash").alias("_hash"), F.col("last_chunk").alias("_last"),
    )
    fits = (
        (F.col("_session") == F.col("session_id"))
        & (F.col("_hash") == F.col("content_hash"))
        & (F.col("_last") >= 0)
        & (F.col("_last") < F.col("total_chunks") - 1)
    )
    return uploads.join(alive, ["vault", "device", "path_hash"], "left").select(
        *uploads.columns, F.when(fits, F.col("_last") + 1).otherwise(F.lit(0)).cast("long").alias("start_chunk")
    )
