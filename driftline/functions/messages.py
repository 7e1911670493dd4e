"""Fields, categories and states of protocol messages and log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Action names of the protocol.
ROUND_REQUESTS = ["NoteSync", "FileSync", "SettingSync", "FolderSync"]
ROUND_ENDS = ["NoteSyncEnd", "FileSyncEnd", "SettingSyncEnd", "FolderSyncEnd", "SyncEnd"]
CHUNKED_ACTIONS = ["FileUpload", "FileDownload", "ConfigUpload"]
SILENT_RECEIVED = [
    "Pong", "Authorization", "ClientInfo", "FileUploadCheck", "FileChunkDownload",
    "NoteSyncNeedPush", "FileSyncUpdate", "FileSyncChunkDownload",
]
SILENT_SENT = ["Ping", "Authorization", "ClientInfo", "FileUploadCheck", "FileChunkDownload", "NoteSyncNeedPush"]
# Labels of the three counts in the text of a scan message.
SCAN_LABELS = {"notes": "笔记", "files": "附件", "configs": "配置"}


def log_category(action: Column) -> Column:
    return (
        F.when(action == "SyncSummary", "summary")
        .when(action.startswith("Note"), "note")
        .when(action.startswith("File"), "attachment")
        .when(action.startswith("Setting") | action.startswith("Config"), "config")
        .when(action.startswith("Folder"), "folder")
        .otherwise("other")
    )


def categorize_log(df: DataFrame, sync_type: str = "incremental") -> DataFrame:
    """Add ``category`` and ``log_action``; requests and ends of a round carry the sync type.

    ``direction`` is ``send`` or ``receive``; ends are marked only when received.
    """
    action = F.col("action")
    suffixed = action.isin(ROUND_REQUESTS) | ((F.col("direction") == "receive") & action.isin(ROUND_ENDS))
    return df.withColumns(
        {
            "category": log_category(action),
            "log_action": F.when(suffixed, F.concat(action, F.lit(f"_{sync_type}"))).otherwise(action),
        }
    )


def message_status(df: DataFrame, out: str = "status") -> DataFrame:
    """State of the log row a message makes, from ``direction``, ``action``, ``code``, ``session_id``."""
    code, action = F.col("code"), F.col("action")
    failed = F.coalesce((code == 0) | (code > 200), F.lit(False))
    chunked = action.isin(CHUNKED_ACTIONS)
    received = (
        F.when(failed, "error")
        .when(F.col("session_id").isNull(), "success")
        .when(code.isNull() | chunked, "pending")
        .otherwise("success")
    )
    sent = F.when(chunked, "pending").otherwise("success")
    return df.withColumn(out, F.when(F.col("direction") == "receive", received).otherwise(sent))


def message_fields(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``path``, ``msg_vault``, ``session_id``, ``code``, ``message``, ``context`` from a JSON body.

    Names differ by sender (``Path`` or ``path``, on top or under ``data``); the first that
    is not empty counts. The order is not the same for both directions.
    """
    top = ["Path", "path", "Vault", "vault", "sessionId", "SessionID", "code", "message", "context", "data"]
    inner = ["Path", "path", "Vault", "vault", "sessionId", "SessionID"]
    t_names, d_names = [f"_t{i}" for i in range(len(top))], [f"_d{i}" for i in range(len(inner))]
    parsed = df.select("*", F.json_tuple(F.col(body), *top).alias(*t_names))
    parsed = parsed.select("*", F.json_tuple(F.col(t_names[-1]), *inner).alias(*d_names))

    def first(*cols: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols])

    t, d = dict(zip(top, t_names)), dict(zip(inner, d_names))
    got = F.col("direction") == "receive"
    path_in = first(d["Path"], t["Path"], t["path"], d["path"])
    path_out = first(t["Path"], t["path"], d["Path"], d["path"])
    session_in = first(t["sessionId"], d["sessionId"], d["SessionID"])
    session_out = first(t["sessionId"], t["SessionID"], d["sessionId"], d["SessionID"])
    return parsed.withColumns(
        {
            "path": F.when(got, path_in).otherwise(path_out),
            "msg_vault": first(t["Vault"], t["vault"], d["Vault"], d["vault"]),
            "session_id": F.when(got, session_in).otherwise(session_out),
            "code": F.col(t["code"]).try_cast("long"),
            "message": F.col(t["message"]),
            "context": first(t["context"]),
        }
    ).drop(*t_names, *d_names)


def scan_counts_from_text(df: DataFrame, message: str = "message") -> DataFrame:
    """Counts named in a scan message; 0 when a label is absent."""
    return df.withColumns(
        {
            name: F.coalesce(F.regexp_extract(F.col(message), label + r":\s*(\d+)", 1).try_cast("long"), F.lit(0))
            for name, label in SCAN_LABELS.items()
        }
    )


_COUNTS = "struct<upload:long,modify:long,delete:long>"
SUMMARY_SCHEMA = f"syncType string, hasChanges boolean, note {_COUNTS}, file {_COUNTS}, config {_COUNTS}"


def summary_from_json(df: DataFrame, message: str = "message") -> DataFrame:
    """One row per kind with changes, from the JSON of a round summary."""
    parsed = df.withColumn("_s", F.from_json(F.col(message), SUMMARY_SCHEMA))
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                *[F.coalesce(F.col(f"_s.{kind}.{n}"), F.lit(0)).cast("long").alias(n) for n in ("upload", "modify", "delete")],
            )
            for kind in ("note", "file", "config")
        ]
    )
    flat = parsed.withColumn("sync_type", F.col("_s.syncType")).withColumn("_r", F.explode(rows))
    total = F.col("_r.upload") + F.col("_r.modify") + F.col("_r.delete")
    return flat.filter(total > 0).select(
        *df.columns, "sync_type", "_r.kind", "_r.upload", "_r.modify", "_r.delete", total.alias("total")
    )
