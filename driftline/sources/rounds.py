"""Round requests and round ends as rows, one per item or task, and rows as requests again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Actions of a round and the names of their three lists (present, deleted, missing).
REQUESTS = {
    "NoteSync": ("note", "notes", "delNotes", "missingNotes"),
    "FileSync": ("file", "files", "delFiles", "missingFiles"),
    "SettingSync": ("config", "configs", "delConfigs", "missingConfigs"),
    "FolderSync": ("folder", "folders", "delFolders", "missingFolders"),
}
STATES = ("present", "deleted", "missing")
#: items in a message
MESSAGE_ITEMS = 10_000
ITEM = "struct<path string, pathHash string, contentHash string, mtime long, ctime long, size long>"
TASK = (
    "struct<path string, pathHash string, content string, contentHash string, ctime long, mtime long, size long,"
    " lastTime long, sessionId string, chunkSize long, oldPath string, oldPathHash string>"
)
END = (
    f"lastTime long, context string, messages array<struct<action string, data {TASK}>>,"
    " needUploadCount long, needModifyCount long, needSyncMtimeCount long, needDeleteCount long"
)


def _kind(action):
    kind = F.lit(None).cast("string")
    for name, (k, *_) in REQUESTS.items():
        kind = F.when(action.isin(name, f"{name}End"), k).otherwise(kind)
    return kind


def request_items(messages: DataFrame) -> DataFrame:
    """Items of the round requests among decoded messages (``seq``, ``action``, ``body``).

    ``seq, kind, vault, last_time, context, state, path, path_hash, content_hash, mtime, ctime, size``; ``state`` says which
    list an item stood in. A request without items gives no rows.
    """
    lists = [name for _, *names in REQUESTS.values() for name in names]
    schema = ", ".join(["vault string, lastTime long, context string", *(f"{name} array<{ITEM}>" for name in lists)])
    asked = messages.filter(F.col("action").isin(list(REQUESTS))).withColumn("_r", F.from_json("body", schema))

    def stated(name: str, state: str):
        found = F.coalesce(f"_r.{name}", F.array().cast(f"array<{ITEM}>"))
        return F.transform(found, lambda i: F.struct(F.lit(state).alias("state"), i.alias("i")))

    parts = [stated(name, state) for _, *names in REQUESTS.values() for state, name in zip(STATES, names)]
    facts = ["seq", "kind", "vault", "last_time", "context"]
    # the facts stand beside the list before it is taken apart, so that no item carries its whole message
    found = asked.select(
        "seq", _kind(F.col("action")).alias("kind"), F.col("_r.vault").alias("vault"), F.col("_r.lastTime").alias("last_time"),
        F.col("_r.context").alias("context"), F.concat(*parts).alias("_l"),
    )
    return found.select(*facts, F.explode("_l").alias("_i")).select(
        *facts, "_i.state", F.col("_i.i.path").alias("path"), F.col("_i.i.pathHash").alias("path_hash"),
        F.col("_i.i.contentHash").alias("content_hash"), F.col("_i.i.mtime").alias("mtime"), F.col("_i.i.ctime").alias("ctime"), F.col("_i.i.size").alias("size"),
    )


def _parted(items: DataFrame, key: list[str], most: int) -> DataFrame:
    """Items with a ``part`` of their request; parts hold about ``most`` items, copies of an item share one."""
    counts = items.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in key], "_n")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    part = F.pmod(F.xxhash64(*[c for c in items.columns if c not in key]), F.ceil(F.col("_n") / most).cast("long"))
    return items.join(counts, same).select(*items.columns, part.alias("part"))


def encode_requests(items: DataFrame, most: int = MESSAGE_ITEMS) -> DataFrame:
    """Requests (``action``, ``body``, ``raw``) of items (columns as :func:`request_items` gives them, but ``seq`` names the request).

    A request holds the items of one ``seq``, so number them first (``windows.cap_per_kind``). One of more than ``most`` items
    goes out in several messages of that ``seq`` with about so many items each, so no message grows with the table.
    """
    key = ["seq", "kind", "vault", "last_time", "context"]
    item = F.struct(
        "path", F.col("path_hash").alias("pathHash"), F.col("content_hash").alias("contentHash"), "mtime", "ctime", "size"
    )
    grouped = _parted(items, key, most).groupBy(*key, "part").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("state") == s, item))).alias(s) for s in STATES]
    )
    body, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (kind, *names) in REQUESTS.items():
        fields = [F.col(s).alias(n) for s, n in zip(STATES, names)]
        own = F.to_json(F.struct("vault", F.col("last_time").alias("lastTime"), "context", *fields))
        body = F.when(F.col("kind") == kind, own).otherwise(body)
        action = F.when(F.col("kind") == kind, name).otherwise(action)
    made = grouped.select("seq", action.alias("action"), body.alias("body"))
    return made.withColumn("raw", F.concat("action", F.lit("|"), "body"))


def _ends(messages: DataFrame) -> DataFrame:
    inner = F.coalesce(F.get_json_object("body", "$.data"), F.col("body"))
    ended = messages.filter(F.col("action").isin([f"{a}End" for a in REQUESTS]))
    return ended.select("seq", _kind(F.col("action")).alias("kind"), F.from_json(inner, END).alias("_e"))


def end_tasks(messages: DataFrame) -> DataFrame:
    """Tasks of the round ends among decoded messages, in their order: ``place`` from 0, ``task`` (the action) and its fields."""
    data = {
        "path": "path", "path_hash": "pathHash", "content": "content", "content_hash": "contentHash", "ctime": "ctime", "mtime": "mtime",
        "size": "size", "last_time": "lastTime", "session_id": "sessionId", "chunk_size": "chunkSize", "old_path": "oldPath", "old_path_hash": "oldPathHash",
    }
    rows = _ends(messages).select("seq", "kind", F.posexplode("_e.messages").alias("place", "_m"))
    return rows.select("seq", "kind", F.col("place").cast("long"), F.col("_m.action").alias("task"), *[F.col(f"_m.data.{v}").alias(k) for k, v in data.items()])


def end_facts(messages: DataFrame) -> DataFrame:
    """One row per round end: ``last_time``, ``context``, the number of tasks and the stated counts (0 where absent)."""
    counts = {"need_upload": "needUploadCount", "need_modify": "needModifyCount", "need_mtime": "needSyncMtimeCount", "need_delete": "needDeleteCount"}
    return _ends(messages).select(
        "seq", "kind", F.col("_e.lastTime").alias("last_time"), F.col("_e.context").alias("context"),
        F.coalesce(F.size("_e.messages"), F.lit(0)).cast("long").alias("n_tasks"),
        *[F.coalesce(F.col(f"_e.{v}"), F.lit(0)).cast("long").alias(k) for k, v in counts.items()],
    )
