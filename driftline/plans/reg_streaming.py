"""Registered queries: each streaming operator runs over the staged feed and must give the batch result.

A feed is written to files first, then read as a stream until it is used up. A last row far in the
future moves event time on, so that all waiting rows come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.paths import parent_of
from driftline.plans.fixtures import fx
from driftline.plans.reg_functions import PATH_HASH, SIGNED
from driftline.plans.reg_joins import _BEFORE, _PATH_ACKS, _RENAME_ACKS, _RENAMES, _SENT, APPLY_SQL, ECHO_SQL
from driftline.plans.reg_views import _MARK_EVENTS, DEBOUNCE_SQL, DELAY_MS, FEED, MERGED, SHADOW_SQL, arrived
from driftline.plans.registry import RAW, query
from driftline.session import scratch_path, with_scheme
from driftline.sources.changes import read_changes
from driftline.sources.listing import vault_scan
from driftline.streaming import feeds, processors, sinks

LATE = "60 days"
#: of the streams whose state follows event time: rows come in order, file by file
SHORT = "10 minutes"
FAR_MS = 10 * 365 * 86_400_000


def staged(spark, df: DataFrame, label: str, *ends: dict, files_per_batch: int | None = None) -> DataFrame:
    """Stream over ``df``. ``ends`` name values of last rows that close the feed."""
    path = scratch_path(spark, label)
    if "ts_ms" in df.columns:
        df = df.withColumn("ts", F.timestamp_millis("ts_ms"))
    order = "ts_ms" if "ts_ms" in df.columns else df.columns[0]
    df.repartitionByRange(6, order).sortWithinPartitions(order).write.parquet(path)
    _in_order(spark, path)
    last = df.agg(F.max("ts_ms").alias("m")) if ends else None
    for end in ends:
        far = {"ts_ms": F.col("m") + FAR_MS, "ts": F.timestamp_millis(F.col("m") + FAR_MS)}
        row = [(F.lit(end[c]) if c in end else far.get(c, F.lit(None))).cast(t).alias(c) for c, t in df.dtypes]
        last.select(*row).coalesce(1).write.mode("append").parquet(path)
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return read_changes(spark, path, schema=schema, max_files=files_per_batch)


def _in_order(spark, path: str) -> None:
    """Give the files of a feed times in the order of their names, as a stream reads the oldest first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath().getName(), f) for f in fs.listStatus(where) if f.getPath().getName().startswith("part-"))
    for i, (_, f) in enumerate(files):
        fs.setTimes(f.getPath(), f.getModificationTime() - 1000 * (len(files) - i), -1)


def finished(spark, stream: DataFrame, label: str) -> DataFrame:
    """Rows of a stream that has run to its end."""
    out, check = scratch_path(spark, label), scratch_path(spark, label + "-progress")
    schema = stream.schema
    sinks.write_append(stream, out, check).awaitTermination()
    return spark.read.schema(schema).parquet(out)


def upserted(spark, stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    out, check = scratch_path(spark, label), scratch_path(spark, label + "-progress")
    sinks.write_upserts(stream, out, check).awaitTermination()
    return sinks.read_upserts(spark, out, keys)


END = {"vault": "end", "device": "end", "path": "end", "op": "modify", "event_id": -1}


@query(
    "src1_vault_scan",
    """SELECT 'file' AS kind, concat('source=', source, '/lang=', lang) AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY source, lang
UNION ALL SELECT 'folder', folder, NULL FROM (SELECT DISTINCT concat('source=', source) AS folder FROM documents UNION SELECT DISTINCT concat('source=', source, '/lang=', lang) FROM documents) f""",
)
def src1(spark, sf):
    root = with_scheme(spark, scratch_path(spark, "vault"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("source", "lang", "text")
    docs.write.partitionBy("source", "lang").text(root)
    own = F.col("path").rlike(r"(^|/)(_SUCCESS|\.[^/]*\.crc)$")  # marks of the writer, no files of the vault
    scan = vault_scan(spark, root, "v", "d").filter(~own)
    folder = F.when(F.col("kind") == "folder", F.col("path")).otherwise(parent_of(F.col("path")))
    return scan.groupBy("kind", folder.alias("folder")).agg(F.sum("size").alias("n_bytes"))


def _put_files(root: str):
    """Tasks write each text to a file of its own below the shared folder."""

    def put(batches):
        from pyarrow import fs as pafs
        from urllib.parse import unquote, urlparse

        fs, base = (pafs.LocalFileSystem(), unquote(urlparse(root).path)) if urlparse(root).scheme in ("", "file") else pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(text.encode())
            yield batch.select([0])

    return put


@query(
    "src1_vault_rows",
    f"""WITH p AS (SELECT path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM fx_paths),
f AS (SELECT CASE WHEN path LIKE '%.md' THEN 'note' ELSE 'file' END AS kind, path, size FROM p
  UNION ALL SELECT DISTINCT 'folder', array_to_string(string_split(path, '/')[:1], '/'), CAST(NULL AS BIGINT) FROM p
  UNION ALL SELECT DISTINCT 'folder', array_to_string(string_split(path, '/')[:2], '/'), NULL FROM p),
h AS (SELECT *, {PATH_HASH.format("path")} AS h FROM f)
SELECT kind, path, {SIGNED} AS path_hash, size FROM h""",
)
def src1_rows(spark, sf):
    root = with_scheme(spark, scratch_path(spark, "vault"))
    fx(spark, sf, "fx_paths").select("path", "text").mapInArrow(_put_files(root), "path string").write.format("noop").mode("overwrite").save()
    return vault_scan(spark, root, "v", "d").select("kind", "path", "path_hash", "size")


@query("src6_read_changes", "SELECT event_id, vault, path, op, old_path, content_hash, ts_ms FROM fx_events")
def src6(spark, sf):
    stream = staged(spark, fx(spark, sf, "fx_events"), "changes", files_per_batch=2)
    return finished(spark, stream, "read").select("event_id", "vault", "path", "op", "old_path", "content_hash", "ts_ms")


@query("st2_settle_stream", f"WITH {_BEFORE} SELECT vault, path, event_id, ts_ms, op, effect, hash FROM f")
def st2_settle(spark, sf):
    sinks.use_rocksdb(spark)
    feed = {
        "sent": (_SENT, {**END, "path": "s"}), "acks": (_PATH_ACKS, {**END, "path": "a"}), "pushes": ("fx_pushes", {**END, "path": "p"}),
    }
    sent, acks, pushes = (staged(spark, fx(spark, sf, sql), name, end, files_per_batch=2) for name, (sql, end) in feed.items())
    rows = finished(spark, processors.ack_stream(sent, acks, SHORT, FAR_MS // 2, pushes), "settled")
    return rows.filter("vault <> 'end' AND effect <> 'timeout'").drop("device")


@query("st1_debounce_stream", f"WITH {DEBOUNCE_SQL} SELECT * FROM settled")
def st1(spark, sf):
    events = staged(spark, fx(spark, sf, "fx_events"), "debounce", END, files_per_batch=2)
    rows = finished(spark, feeds.debounce_stream(events, DELAY_MS, LATE), "debounced")
    return rows.filter("vault <> 'end'").select("event_id", "vault", "path", "op", "ts_ms")


@query("st1_shadow_stream", SHADOW_SQL)
def st1_shadow(spark, sf):
    ends = [{**END, "op": op} for op in ("rename", "modify")]
    events = staged(spark, fx(spark, sf, FEED), "shadow", *ends, files_per_batch=2)
    rows = finished(spark, feeds.shadow_stream(events, LATE, DELAY_MS), "unshadowed")
    return rows.filter("vault <> 'end'").select("event_id", "path", "op", "ts_ms")


@query("st2_ack_stream", RAW["jn14_match_acks"].replace("SELECT vault, path, event_id, ts_ms, last_time, CASE", "SELECT vault, path, event_id, ts_ms, CASE"))
def st2(spark, sf):
    sinks.use_rocksdb(spark)
    sent = staged(spark, fx(spark, sf, _SENT), "sent", END, files_per_batch=2)
    acks = staged(spark, fx(spark, sf, _PATH_ACKS), "acks", {**END, "path": "other"}, files_per_batch=3)
    rows = finished(spark, processors.ack_stream(sent, acks, SHORT, FAR_MS // 2), "acked")
    return rows.filter("vault <> 'end' AND effect <> 'timeout'").select("vault", "path", "event_id", "ts_ms", "effect", "hash")


#: of the queries whose sends time out
TIMEOUT_MS = 6 * 3_600_000


@query(
    "st2_ack_timeout_stream",
    f"""WITH m AS (SELECT event_id, ts_ms, vault, device, path, CASE WHEN op = 'delete' THEN 'delete' ELSE 'modify' END AS op, hash, 0 AS role FROM ({_SENT}) s
  UNION ALL SELECT event_id, ts_ms, vault, device, path, CASE WHEN op = 'delete' THEN 'delete' ELSE 'modify' END, NULL, 1 FROM ({_PATH_ACKS}) a),
o AS (SELECT *, row_number() OVER (PARTITION BY vault, device, path ORDER BY ts_ms, role, event_id) AS i FROM m),
w AS (SELECT o.*, s.i AS si, s.op AS sop, s.hash AS shash, s.ts_ms AS sms FROM o LEFT JOIN o s
  ON o.role = 1 AND s.role = 0 AND s.vault = o.vault AND s.device = o.device AND s.path = o.path AND s.i < o.i
  QUALIFY row_number() OVER (PARTITION BY o.vault, o.device, o.path, o.i ORDER BY s.i DESC NULLS LAST) = 1),
x AS (SELECT *, coalesce(role = 1 AND sop = op AND ts_ms <= sms + {TIMEOUT_MS}, false) AS could FROM w),
h AS (SELECT *, could AND row_number() OVER (PARTITION BY vault, device, path, si, could ORDER BY i) = 1 AS hit FROM x),
t AS (SELECT *, lead(ts_ms) OVER p AS next_ms FROM o WHERE role = 0 WINDOW p AS (PARTITION BY vault, device, path ORDER BY i))
SELECT vault, path, event_id, ts_ms, CASE WHEN hit AND op = 'modify' THEN 'put' WHEN hit THEN 'remove' ELSE 'none' END AS effect,
  CASE WHEN hit AND op = 'modify' THEN shash END AS hash FROM h WHERE role = 1
UNION ALL SELECT t.vault, t.path, t.event_id, t.ts_ms, 'timeout', NULL FROM t
WHERE (next_ms IS NULL OR next_ms > t.ts_ms + {TIMEOUT_MS})
  AND NOT EXISTS (SELECT 1 FROM h WHERE hit AND h.vault = t.vault AND h.device = t.device AND h.path = t.path AND h.si = t.i)""",
)
def st2_timeouts(spark, sf):
    """As st2_ack_stream, with a timeout that sends reach; their rows are part of the result."""
    sinks.use_rocksdb(spark)
    sent = staged(spark, fx(spark, sf, _SENT), "sent", END, files_per_batch=2)
    acks = staged(spark, fx(spark, sf, _PATH_ACKS), "acks", {**END, "path": "other"}, files_per_batch=3)
    rows = finished(spark, processors.ack_stream(sent, acks, SHORT, TIMEOUT_MS), "acked")
    return rows.filter("vault <> 'end'").select("vault", "path", "event_id", "ts_ms", "effect", "hash")


@query("st2_rename_ack_stream", f"SELECT vault, event_id, ts_ms, old_path, path, acked_at FROM ({RAW['jn15_match_rename_acks']}) j WHERE acked_at IS NOT NULL")
def st2_renames(spark, sf):
    sinks.use_rocksdb(spark)
    renames = staged(spark, fx(spark, sf, _RENAMES), "renames", END, files_per_batch=2)
    acks = staged(spark, fx(spark, sf, _RENAME_ACKS), "rename-acks", {**END, "device": "other"}, files_per_batch=3)
    rows = finished(spark, processors.rename_ack_stream(renames, acks, SHORT), "renamed")
    return rows.filter("vault <> 'end'").select("vault", "event_id", "ts_ms", "old_path", "path", "acked_at")


@query("st3_echo_stream", ECHO_SQL)
def st3(spark, sf):
    local = staged(spark, fx(spark, sf, "fx_events"), "local", {**END, "op": "delete"}, files_per_batch=2)
    remote = staged(spark, fx(spark, sf, "fx_remote"), "remote", {**END, "op": "delete"}, files_per_batch=2)
    rows = finished(spark, feeds.echo_stream(local, remote, LATE), "echo")
    return rows.filter("vault <> 'end'").select("event_id", "path", "op", "ts_ms")


@query(
    "st4_chunk_stream",
    """WITH s AS (SELECT session_id, total_chunks, CAST(substr(session_id, 25) AS BIGINT) % 10 AS k FROM fx_sessions)
SELECT session_id, CASE k WHEN 5 THEN 0 WHEN 0 THEN total_chunks - 1 ELSE total_chunks END AS received, CASE WHEN k <> 5 THEN total_chunks END AS total_chunks,
  CASE k WHEN 5 THEN 0 WHEN 0 THEN (total_chunks - 1) * 100 // total_chunks ELSE 100 END AS percent, CASE k WHEN 5 THEN 'error' WHEN 0 THEN 'expired' ELSE 'success' END AS status FROM s""",
)
def st4(spark, sf):
    return _transfers(spark, sf).filter("status <> 'pending'")


def _transfers(spark, sf):
    sinks.use_rocksdb(spark)
    start = F.lit(1704067200000) + F.substring("session_id", -12, 12).cast("long") * 60000
    unknown = F.substring("session_id", -1, 1) == "5"
    sessions = fx(spark, sf, "SELECT session_id, total_chunks FROM fx_sessions").withColumn("ts_ms", start)
    frames = arrived(spark, sf).select("session_id", "chunk_index", (start + F.col("chunk_index")).alias("ts_ms"))
    opened = staged(spark, sessions.filter(~unknown), "opened", {"session_id": "end", "total_chunks": 2}, files_per_batch=2)
    chunks = staged(spark, frames, "frames", {"session_id": "end", "chunk_index": 0}, files_per_batch=3)
    rows = finished(spark, processors.chunk_stream(opened, chunks, SHORT), "transfers")
    return rows.filter("session_id <> 'end'")


@query(
    "st4_chunk_progress_stream",
    """WITH s AS (SELECT session_id, total_chunks, CAST(substr(session_id, 25) AS BIGINT) % 10 AS k FROM fx_sessions),
g AS (SELECT session_id, k, total_chunks, total_chunks - CASE WHEN k = 0 THEN 1 ELSE 0 END AS got FROM s)
SELECT session_id, i AS received, total_chunks, i * 100 // total_chunks AS percent, CASE WHEN i = total_chunks THEN 'success' ELSE 'pending' END AS status
FROM (SELECT *, unnest(range(0, got + 1)) AS i FROM g WHERE k <> 5) u
WHERE i = 0 OR i = total_chunks OR i * 10 // total_chunks > (i - 1) * 10 // total_chunks
UNION ALL SELECT session_id, got, total_chunks, got * 100 // total_chunks, 'expired' FROM g WHERE k = 0
UNION ALL SELECT session_id, 0, NULL, 0, 'error' FROM g WHERE k = 5""",
)
def st4_progress(spark, sf):
    """As st4_chunk_stream, with the rows of transfers that go on."""
    return _transfers(spark, sf)


_ROUND_FEED = """SELECT event_id AS seq, concat('vault', CAST(r % 3 AS STRING)) AS vault, concat('c', CAST(r AS STRING)) AS context,
  1704067200000 + r * 3600000 + i * CASE WHEN r % 4 = 0 THEN 3000 ELSE 1000 END AS ts_ms,
  CASE WHEN i = 0 THEN 'start' WHEN i <= 4 THEN 'end' ELSE 'done' END AS what,
  CASE WHEN i > 0 THEN CASE i % 4 WHEN 1 THEN 'note' WHEN 2 THEN 'file' WHEN 3 THEN 'config' ELSE 'folder' END END AS kind,
  CASE i WHEN 1 THEN r % 5 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 0 END AS n_tasks
FROM (SELECT event_id, CAST(floor(event_id / 20) AS BIGINT) AS r, event_id % 20 AS i FROM events) e"""


@query(
    "st5_round_stream",
    f"""WITH f AS ({_ROUND_FEED}), b AS (SELECT *, min(ts_ms) OVER (PARTITION BY context) AS started_ms FROM f),
k AS (SELECT *, max(n_tasks) FILTER (what = 'end') OVER p AS t, count(*) FILTER (what = 'done') OVER p AS d
  FROM b WHERE what <> 'start' AND ts_ms - started_ms <= 30000 WINDOW p AS (PARTITION BY context, kind ORDER BY ts_ms, seq)),
x AS (SELECT b.vault, b.context, b.started_ms, b.ts_ms, b.seq, g.kind, arg_max(k.t, k.seq) AS t, coalesce(arg_max(k.d, k.seq), 0) AS d
  FROM b CROSS JOIN (VALUES ('note'), ('file'), ('config'), ('folder')) g(kind)
  LEFT JOIN k ON k.context = b.context AND k.kind = g.kind AND (k.ts_ms, k.seq) <= (b.ts_ms, b.seq) WHERE b.ts_ms - b.started_ms <= 30000 GROUP BY ALL),
w AS (SELECT vault, context, started_ms, ts_ms, seq, bool_and(t IS NOT NULL AND d >= t) AS ok, sum(coalesce(t, 0)) AS total, sum(least(d, coalesce(t, d))) AS completed FROM x GROUP BY ALL),
d AS (SELECT vault, context, started_ms, min(ts_ms) FILTER (ok) AS at_ms, arg_min(total, (ts_ms, seq)) FILTER (ok) AS done_total, arg_max(total, (ts_ms, seq)) AS total, arg_max(completed, (ts_ms, seq)) AS completed FROM w GROUP BY ALL)
SELECT vault, context, CASE WHEN at_ms IS NULL THEN 'forced' ELSE 'done' END AS outcome, CAST(coalesce(done_total, total) AS BIGINT) AS total,
  CAST(coalesce(done_total, completed) AS BIGINT) AS completed, started_ms, coalesce(at_ms, started_ms + 30000) AS finished_ms FROM d""",
)
def st5(spark, sf):
    sinks.use_rocksdb(spark)
    end = {"vault": "end", "context": "end", "what": "start", "seq": -1}
    feed = staged(spark, fx(spark, sf, _ROUND_FEED), "rounds", end, files_per_batch=2)
    return finished(spark, processors.round_stream(feed, SHORT), "finished").filter("vault <> 'end'")


@query("st6_log_stream", f"WITH {MERGED} SELECT * FROM log")
def st6(spark, sf):
    log = staged(spark, fx(spark, sf, "fx_log"), "log", files_per_batch=2)
    return upserted(spark, feeds.log_stream(log), "merged", ["id"])


LIFE_MS = 600_000
_LOG_FEED = "SELECT *, ts AS ts_ms FROM fx_log"
#: a log id that rests for the life and longer begins anew
_LIVES = f"""b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY id ORDER BY ts, seq) >= {LIFE_MS} THEN 1 ELSE 0 END AS starts FROM fx_log),
lived AS (SELECT * EXCLUDE (id), concat(id, '#', sum(starts) OVER (PARTITION BY id ORDER BY ts, seq)) AS id FROM b)"""


@query(
    "st6_final_log_stream",
    f"WITH {_LIVES}, {MERGED.replace('FROM fx_log', 'FROM lived')} SELECT * REPLACE (string_split(id, '#')[1] AS id) FROM log",
)
def st6_final(spark, sf):
    end = {"id": "end", "seq": -1}
    log = staged(spark, fx(spark, sf, _LOG_FEED), "final-log", end, files_per_batch=2)
    log = log.withColumn("at", F.col("ts")).withColumn("ts", F.col("ts_ms"))
    return finished(spark, feeds.final_log(log, LIFE_MS, SHORT), "final").filter("id <> 'end'")


@query("st7_state_stream", f"WITH {APPLY_SQL} SELECT * FROM applied")
def st7(spark, sf):
    events = staged(spark, fx(spark, sf, "fx_events"), "state-events", files_per_batch=2)
    out, check = scratch_path(spark, "state"), scratch_path(spark, "state-progress")
    sinks.write_state_changes(events, out, check).awaitTermination()
    return feeds.state_after(fx(spark, sf, "fx_state"), sinks.read_state_changes(spark, out))


@query(
    "st8_watermark_stream",
    f"WITH e AS ({_MARK_EVENTS}) SELECT vault, device, kind, max(last_time) AS last_time FROM e GROUP BY vault, device, kind",
)
def st8(spark, sf):
    messages = staged(spark, fx(spark, sf, _MARK_EVENTS), "marks", files_per_batch=2)
    return upserted(spark, feeds.watermark_stream(messages), "watermarks", ["vault", "device", "kind"])


_KV_FEED = """SELECT event_id AS seq, epoch_us(ts) AS us, concat('vault', CAST(user_id % 3 AS STRING)) AS vault, 'dev0' AS device, concat('k', CAST(user_id AS STRING)) AS key,
  md5(event_type) AS hash, CASE WHEN event_id % 4 = 0 THEN 'remote' ELSE 'local' END AS origin FROM events"""
_KV_FEED = _KV_FEED.replace("epoch_us(ts) AS us", "CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms")


@query(
    "st9_kv_change_stream",
    f"""WITH f AS ({_KV_FEED}), l AS (SELECT *, lag(hash) OVER (PARTITION BY vault, key ORDER BY ts_ms, seq) AS last FROM f)
SELECT vault, device, key, hash, seq, ts_ms FROM l WHERE origin = 'local' AND hash IS DISTINCT FROM last""",
)
def st9(spark, sf):
    sinks.use_rocksdb(spark)
    feed = staged(spark, fx(spark, sf, _KV_FEED), "kv", {"vault": "end", "device": "end", "key": "end", "hash": "", "origin": "remote", "seq": -1}, files_per_batch=2)
    return finished(spark, processors.kv_change_stream(feed, SHORT), "kv-changes")
