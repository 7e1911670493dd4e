"""Messages as typed rows: each body is parsed once to a VARIANT, and fields are read from it by action.

``FIELDS`` names the fields of all payloads, ``ACTIONS`` what the server's answers and pushes are about. A payload stands at the top
of a body or under ``data``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.messages import categorize_log, message_status
from driftline.operators.filters import loggable

# Fields of payloads on the wire, and their types.
FIELDS = {
    "path": ("path", "string"),
    "path_hash": ("pathHash", "string"),
    "hash": ("contentHash", "string"),
    "ctime": ("ctime", "long"),
    "mtime": ("mtime", "long"),
    "size": ("size", "long"),
    "last_time": ("lastTime", "long"),
    "session_id": ("sessionId", "string"),
    "chunk_size": ("chunkSize", "long"),
    "old_path": ("oldPath", "string"),
    "old_path_hash": ("oldPathHash", "string"),
}
# Actions of answers and pushes, with what they are about and what they say.
ACTIONS = {
    "NoteModifyAck": ("ack", "note", "modify"),
    "NoteDeleteAck": ("ack", "note", "delete"),
    "NoteRenameAck": ("ack", "note", "rename"),
    "FileUploadAck": ("ack", "file", "modify"),
    "FileDeleteAck": ("ack", "file", "delete"),
    "FileRenameAck": ("ack", "file", "rename"),
    "SettingModifyAck": ("ack", "config", "modify"),
    "SettingDeleteAck": ("ack", "config", "delete"),
    "NoteSyncModify": ("push", "note", "modify"),
    "NoteSyncMtime": ("push", "note", "mtime"),
    "NoteSyncDelete": ("push", "note", "delete"),
    "NoteSyncRename": ("push", "note", "rename"),
    "FileSyncUpdate": ("push", "file", "update"),
    "FileSyncMtime": ("push", "file", "mtime"),
    "FileSyncDelete": ("push", "file", "delete"),
    "FileSyncRename": ("push", "file", "rename"),
    "SettingSyncModify": ("push", "config", "modify"),
    "SettingSyncMtime": ("push", "config", "mtime"),
    "SettingSyncDelete": ("push", "config", "delete"),
    "FolderSyncModify": ("push", "folder", "modify"),
    "FolderSyncDelete": ("push", "folder", "delete"),
    "FolderSyncRename": ("push", "folder", "rename"),
}


def parsed_messages(raw: DataFrame) -> DataFrame:
    """``raw`` with ``action`` (before the first ``|``) and ``v``, the body as a VARIANT; rows whose body is no JSON are left out."""
    parts = F.split("raw", r"\|", 2)
    named = raw.withColumn("_p", F.when(F.size(parts) > 1, parts).otherwise(F.array(F.lit(""), F.col("raw"))))
    read = named.withColumn("action", F.col("_p")[0]).withColumn("v", F.try_parse_json(F.col("_p")[1])).drop("_p")
    return read.filter(F.col("v").isNotNull())


def _at(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def _first(*paths: str) -> Column:
    """The first of the fields that is there and not empty."""
    return F.coalesce(*[F.nullif(_at(p), F.lit("")) for p in paths])


def log_events(raw: DataFrame, sync_type: str = "incremental") -> DataFrame:
    """Rows of the sync log (``LOG_EVENTS``) that messages make; ``raw`` has ``seq``, ``ts``, ``direction`` and ``raw``.

    Messages of a transfer share its session as ``id``, others get one of their own from ``seq``. Actions that are not
    logged and bodies that are no JSON make no row. A received message without text shows its code.
    """
    got = F.col("direction") == "receive"
    rows = parsed_messages(raw).select(
        "seq", "ts", "direction", "action",
        F.when(got, _first("data.Path", "Path", "path", "data.path")).otherwise(_first("Path", "path", "data.Path", "data.path")).alias("path"),
        _first("Vault", "vault", "data.Vault", "data.vault").alias("vault"),
        F.when(got, _first("sessionId", "data.sessionId", "data.SessionID"))
        .otherwise(_first("sessionId", "SessionID", "data.sessionId", "data.SessionID")).alias("session_id"),
        _at("code", "long").alias("code"),
        F.when(got, F.coalesce(_first("message"), F.concat(F.lit("Code: "), _at("code")))).alias("message"),
    )
    rows = message_status(categorize_log(loggable(rows), sync_type))
    return rows.select(
        "seq", F.coalesce("session_id", F.concat(F.lit("m"), F.col("seq").cast("string"))).alias("id"), "ts", F.col("direction").alias("type"),
        F.col("log_action").alias("action"), "path", "status", F.lit(None).cast("int").alias("progress"), "message", "vault",
    )


def answers(raw: DataFrame) -> DataFrame:
    """Acknowledgements and pushes among received messages: ``seq``, ``ts``, ``source`` (ack or push), ``kind``, ``op``, ``vault`` and the payload's fields.

    ``raw`` may have a ``device``, which is kept.
    """
    known = parsed_messages(raw.filter(F.col("direction") == "receive")).filter(F.col("action").isin(list(ACTIONS)))
    about = F.create_map(*[F.lit(x) for a, what in ACTIONS.items() for x in (a, "|".join(what))])
    payload = "struct<vault string, " + ", ".join(f"{wire} {t}" for wire, t in FIELDS.values()) + ">"
    kept = [c for c in ("seq", "ts", "device") if c in raw.columns]
    read = known.select(
        *kept, F.split(about[F.col("action")], r"\|").alias("about"),
        F.try_variant_get("v", "$.data", payload).alias("inner"), F.try_variant_get("v", "$", payload).alias("top"),
    )
    facts = [F.coalesce(f"inner.{wire}", f"top.{wire}").alias(name) for name, (wire, _) in FIELDS.items()]
    return read.select(
        *kept, *[F.col("about")[i].alias(name) for i, name in enumerate(("source", "kind", "op"))],
        F.coalesce("top.vault", "inner.vault").alias("vault"), *facts,
    )


def settle_feeds(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Acks and pushes by path as ``operators.acks.settle`` takes them."""
    rows = answers(raw).filter(F.col("path").isNotNull() & (F.col("op") != "rename"))
    rows = rows.select("vault", "device", "path", F.col("seq").alias("event_id"), F.col("ts").alias("ts_ms"), "source", "op", "hash", "mtime", "size", "last_time")
    acks = rows.filter(F.col("source") == "ack").select("vault", "device", "path", "event_id", "ts_ms", "op", "last_time")
    return acks, rows.filter(F.col("source") == "push").drop("source")
