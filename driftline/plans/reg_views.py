"""Registered queries: aggregations, windows, orders, logs, chunks and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import acks, aggregates, chunks, compare, filters, history, ordering, windows
from driftline.operators.timeline import By
from driftline.plans.fixtures import fx
from driftline.plans.reg_filters import LOG_CATEGORY, session_files
from driftline.plans.reg_joins import KEY, _reconcile_sql, decisions
from driftline.plans.reg_functions import FIELDS
from driftline.plans.registry import query
from driftline.sources import log_text, payloads, state_store, wire

_MODULES = """SELECT vault, device, kind, CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN length(path) % 10 < 9 THEN 1 ELSE 0 END) AS BIGINT) AS completed,
  kind <> 'config' OR vault = 'vault1' AS ended FROM (SELECT vault, device, kind, path FROM fx_local UNION ALL SELECT vault, device, kind, path FROM fx_config
  UNION ALL SELECT vault, device, 'folder' AS kind, path FROM fx_folders) a GROUP BY vault, device, kind"""
_ROUNDS = """SELECT vault, device, vault <> 'none' AS sync_enabled, vault <> 'vault2' AS config_enabled, vault = 'vault0' AS preview,
  CAST(count(*) AS BIGINT) AS total_chunks, CAST(sum(CASE WHEN doc_id % 20 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS done_chunks, CAST(0 AS BIGINT) AS open_sessions
FROM fx_paths GROUP BY vault, device"""


@query(
    "ag3_progress",
    f"""WITH m AS ({_MODULES}), r AS ({_ROUNDS}),
x AS (SELECT m.*, r.total_chunks AS tc, r.done_chunks AS dc, r.open_sessions AS os FROM m JOIN r ON m.vault = r.vault AND m.device = r.device
  WHERE CASE kind WHEN 'config' THEN config_enabled WHEN 'file' THEN sync_enabled AND NOT preview ELSE sync_enabled END),
s AS (SELECT vault, device, ended, tc, dc, os, CASE WHEN NOT ended THEN 0.0::DOUBLE ELSE CASE WHEN kind = 'file'
   THEN CASE WHEN total + tc > 0 THEN least(1.0::DOUBLE, (completed + dc)::DOUBLE / (total + tc)) ELSE 1 END
   ELSE CASE WHEN total > 0 THEN least(1.0::DOUBLE, completed::DOUBLE / total) ELSE 1 END END END AS share FROM x),
g AS (SELECT vault, device, round(sum(share) / count(*) * 100, 9) AS p, bool_and(ended) AND bool_and(tc = 0 OR dc >= tc) AND bool_and(os = 0) AS settled FROM s GROUP BY vault, device)
SELECT vault, device, CAST(CASE WHEN settled AND p > 90 THEN 100 ELSE least(100, floor(p)) END AS BIGINT) AS percent FROM g""",
)
def ag3(spark, sf):
    return aggregates.progress(fx(spark, sf, _MODULES), fx(spark, sf, _ROUNDS))


@query(
    "ag4_task_totals",
    f"WITH m AS ({_MODULES}) SELECT vault, device, CAST(sum(total) AS BIGINT) AS total, CAST(sum(completed) AS BIGINT) AS completed FROM m GROUP BY vault, device",
)
def ag4(spark, sf):
    return aggregates.task_totals(fx(spark, sf, _MODULES))


_ALL = """SELECT vault, device, kind, path FROM fx_local UNION ALL SELECT vault, device, kind, path FROM fx_config
UNION ALL SELECT vault, device, 'folder' AS kind, path FROM fx_folders"""


@query(
    "ag5_scan_counts",
    f"""WITH a AS ({_ALL}) SELECT vault, device, count(*) FILTER (kind = 'note') AS notes, count(*) FILTER (kind = 'file') AS files,
  count(*) FILTER (kind = 'config') AS configs, count(*) FILTER (kind = 'folder') AS folders FROM a GROUP BY vault, device""",
)
def ag5(spark, sf):
    return aggregates.scan_counts(fx(spark, sf, _ALL))


def arrived(spark, sf):
    """Chunks as they arrive: some lost, some twice."""
    cut = wire.decode_chunks(wire.encode_chunks(session_files(spark, sf).select("session_id", "content"), 256))
    n = F.substring("session_id", -12, 12).cast("long")
    lost = (n % 10 == 0) & (F.col("chunk_index") == 0)
    first = cut.filter(~lost).withColumn("seq", F.col("chunk_index") * 2)
    again = cut.filter((n % 10 == 1) & (F.col("chunk_index") == 0)).withColumn("seq", F.lit(1).cast("long"))
    return first.unionByName(again)


@query(
    "ag6_chunk_progress",
    """WITH s AS (SELECT *, CAST(substr(session_id, 25) AS BIGINT) % 10 = 0 AS lossy FROM fx_sessions)
SELECT session_id, total_chunks, total_chunks - CASE WHEN lossy THEN 1 ELSE 0 END AS received,
  CAST(floor((total_chunks - CASE WHEN lossy THEN 1 ELSE 0 END) / total_chunks * 100) AS BIGINT) AS percent, CASE WHEN lossy THEN 'pending' ELSE 'success' END AS status FROM s""",
)
def ag6(spark, sf):
    rows = aggregates.chunk_progress(arrived(spark, sf), fx(spark, sf, "fx_sessions"))
    return rows.select("session_id", "total_chunks", "received", "percent", "status")


_MARK_EVENTS = """SELECT event_id AS seq, ts_ms, vault, device, CASE event_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'file' WHEN 2 THEN 'config' ELSE 'folder' END AS kind,
  ts_ms + size * 1000 AS last_time FROM fx_events WHERE event_id % 97 <> 0"""
_MARK_ENDS = """SELECT event_id AS seq, ts_ms, vault, device, CASE event_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'file' WHEN 2 THEN 'config' ELSE 'folder' END AS kind,
  ts_ms - 60000 AS last_time, event_id % 3 AS n_tasks FROM fx_events WHERE event_id % 97 = 0"""
_KEPT_MARKS = """SELECT DISTINCT vault, device, 'note' AS kind, 1704000000000 AS last_time FROM fx_events
UNION ALL SELECT DISTINCT vault, device, 'other' AS kind, 1704000000001 AS last_time FROM fx_events"""


@query(
    "ag7_advance_watermarks",
    f"""WITH e AS ({_MARK_EVENTS}), n AS ({_MARK_ENDS}), k AS ({_KEPT_MARKS}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vault, device, kind ORDER BY ts_ms DESC, seq DESC) AS rn FROM n WHERE kind <> 'config' OR n_tasks > 0) q WHERE rn = 1),
a AS (SELECT vault, device, kind FROM e UNION SELECT vault, device, kind FROM l UNION SELECT vault, device, kind FROM k)
SELECT a.vault, a.device, a.kind, greatest(coalesce(l.last_time, k.last_time, 0),
   (SELECT max(e.last_time) FROM e WHERE e.vault = a.vault AND e.device = a.device AND e.kind = a.kind AND (l.ts_ms IS NULL OR (e.ts_ms, e.seq) > (l.ts_ms, l.seq)))) AS last_time
FROM a LEFT JOIN l ON a.vault = l.vault AND a.device = l.device AND a.kind = l.kind LEFT JOIN k ON a.vault = k.vault AND a.device = k.device AND a.kind = k.kind""",
)
def ag7(spark, sf):
    return aggregates.advance_watermarks(fx(spark, sf, _MARK_EVENTS), fx(spark, sf, _MARK_ENDS), fx(spark, sf, _KEPT_MARKS))


@query(
    "ag8_chunk_plan",
    """SELECT vault, device, count(*) AS n_files, CAST(sum(CASE WHEN size = 0 THEN 1 ELSE (size + 1023) // 1024 END) AS BIGINT) AS n_chunks
FROM fx_local GROUP BY vault, device""",
)
def ag8(spark, sf):
    return aggregates.chunk_totals(fx(spark, sf, "fx_local"), 1024)


MERGED = f"""g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth,
    count(*) OVER (PARTITION BY id) AS n FROM fx_log),
merged AS (SELECT id, max(CASE WHEN nth = 1 THEN ts END) AS "timestamp", max(CASE WHEN nth = n THEN type END) AS type, max(CASE WHEN nth = n THEN action END) AS action,
  arg_max(path, seq) FILTER (path IS NOT NULL) AS path,
  coalesce(arg_max(CASE WHEN status IS NULL THEN 'success' ELSE status END, seq) FILTER (status IN ('success', 'error') OR (nth = 1 AND status IS NULL)), 'pending') AS status,
  max(progress) AS progress, arg_max(message, seq) FILTER (message IS NOT NULL) AS message, arg_max(vault, seq) FILTER (vault IS NOT NULL) AS vault, min(seq) AS first_seq
  FROM g GROUP BY id),
log AS (SELECT *, {LOG_CATEGORY} AS category FROM merged)"""


def merged_log(spark, sf):
    return aggregates.merge_log(fx(spark, sf, "fx_log"))


@query("ag9_merge_log", f"WITH {MERGED} SELECT * FROM log")
def ag9(spark, sf):
    return merged_log(spark, sf)


@query(
    "ag10_assemble_files",
    """SELECT s.session_id, CASE WHEN CAST(substr(s.session_id, 25) AS BIGINT) % 10 = 0 THEN 'missing chunk'
   WHEN CAST(substr(s.session_id, 25) AS BIGINT) % 10 = 3 THEN 'size mismatch' END AS error,
  CASE WHEN CAST(substr(s.session_id, 25) AS BIGINT) % 10 NOT IN (0, 3) THEN md5(p.text) END AS content_md5
FROM fx_sessions s JOIN fx_paths p ON s.vault = p.vault AND s.path = p.path""",
)
def ag10(spark, sf):
    rows = chunks.assemble_files(arrived(spark, sf), fx(spark, sf, "fx_sessions"))
    return rows.select("session_id", "error", F.md5("content").alias("content_md5"))


@query(
    "ag11_in_flight_bytes",
    """SELECT * FROM (SELECT s.session_id, octet_length(encode(p.text)) - CASE WHEN CAST(substr(s.session_id, 25) AS BIGINT) % 10 = 0 THEN least(256, octet_length(encode(p.text))) ELSE 0 END AS held_bytes,
  CAST(substr(s.session_id, 25) AS BIGINT) % 10 = 0 AND s.total_chunks = 1 AS lost
FROM fx_sessions s JOIN fx_paths p ON s.vault = p.vault AND s.path = p.path WHERE s.vault <> 'vault2') q WHERE NOT lost""".replace("SELECT * FROM (", "SELECT session_id, held_bytes FROM ("),
)
def ag11(spark, sf):
    live = fx(spark, sf, "SELECT * FROM fx_sessions WHERE vault <> 'vault2'")
    return chunks.in_flight_bytes(arrived(spark, sf), live)


@query("ag12_page_totals", f"WITH {MERGED} SELECT count(*) AS total_rows, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS total_pages FROM log")
def ag12(spark, sf):
    return aggregates.page_totals(merged_log(spark, sf), 50)


_CLIENTS = """SELECT c_custkey AS uid, c_name AS client_name, c_mktsegment AS client_type, CASE c_nationkey % 4 WHEN 0 THEN 'ios' WHEN 1 THEN 'win' WHEN 2 THEN 'linux' END AS platform FROM customer"""


@query(
    "ag13_client_counts",
    f"""WITH c AS ({_CLIENTS}) SELECT client_type, platform, count(*) AS n_clients FROM c GROUP BY client_type, platform
UNION ALL SELECT NULL, NULL, count(*) FROM c""",
)
def ag13(spark, sf):
    return aggregates.client_counts(fx(spark, sf, _CLIENTS))


_EVENT_COLUMNS = "vault, device, path, event_id, ts_ms, op, content_hash"


@query(
    "w1_latest_per_path",
    f"""SELECT {_EVENT_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY vault, device, path ORDER BY ts_ms DESC, event_id DESC) AS rn FROM fx_events) e WHERE rn = 1""",
)
def w1(spark, sf):
    return windows.latest_per_path(fx(spark, sf, "fx_events")).select(*_EVENT_COLUMNS.split(", "))


#: the fixture's events of one path are hours apart, so the delay is long too
DELAY_MS = 2 * 3_600_000
DEBOUNCE_SQL = f"""pts AS (SELECT event_id, vault, device, path AS k, path, op, ts_ms, 1 AS kept FROM fx_events
  UNION ALL SELECT event_id, vault, device, old_path, path, op, ts_ms, 0 FROM fx_events WHERE op = 'rename'),
nxt AS (SELECT *, lead(ts_ms) OVER (PARTITION BY vault, device, k ORDER BY ts_ms, event_id, kept) AS after FROM pts),
settled AS (SELECT event_id, vault, path, op, ts_ms FROM nxt WHERE kept = 1 AND (after IS NULL OR after - ts_ms > {DELAY_MS}))"""


@query("w2_debounce", f"WITH {DEBOUNCE_SQL} SELECT * FROM settled")
def w2(spark, sf):
    return windows.debounce(fx(spark, sf, "fx_events"), DELAY_MS).select("event_id", "vault", "path", "op", "ts_ms")


#: the feed with writes to the new path of a rename, some within the delay
FEED = """SELECT event_id, ts_ms, vault, device, op, path, old_path, content_hash, mtime, size FROM fx_events
UNION ALL SELECT event_id + 1000000, ts_ms + event_id % 4 * 3600000, vault, device, 'modify', path, NULL, content_hash, mtime, size FROM fx_events WHERE op = 'rename'"""
SHADOW_SQL = f"""WITH feed AS ({FEED})
SELECT e.event_id, e.path, e.op, e.ts_ms FROM feed e WHERE NOT (e.op IN ('modify', 'create') AND EXISTS
  (SELECT 1 FROM feed r WHERE r.op = 'rename' AND r.vault = e.vault AND r.device = e.device AND r.path = e.path AND r.ts_ms BETWEEN e.ts_ms - {DELAY_MS} AND e.ts_ms))"""


@query("w2_drop_shadowed", SHADOW_SQL)
def w2_shadow(spark, sf):
    return acks.drop_shadowed(fx(spark, sf, FEED), DELAY_MS).select("event_id", "path", "op", "ts_ms")


@query(
    "w3_cap_per_kind",
    f"""WITH a AS ({_ALL}), r AS (SELECT *, row_number() OVER (PARTITION BY vault, device, kind ORDER BY path) AS rn FROM a)
SELECT vault, kind, path, CASE WHEN kind = 'config' THEN 0 ELSE (rn - 1) // 40 END AS request FROM r""",
)
def w3(spark, sf):
    return windows.cap_per_kind(fx(spark, sf, _ALL), 40).select("vault", "kind", "path", "request")


@query(
    "w4_hash_budget",
    f"""WITH j AS (SELECT a.vault, a.device, a.path, b.hash IS NULL AS needs_hash FROM fx_local a LEFT JOIN fx_base b ON {KEY} AND a.mtime = b.mtime AND a.size = b.size),
r AS (SELECT *, row_number() OVER (PARTITION BY vault, device ORDER BY path) AS rn FROM j WHERE needs_hash)
SELECT vault, path, needs_hash, (rn - 1) // 30 AS round FROM r UNION ALL SELECT vault, path, needs_hash, 0 FROM j WHERE NOT needs_hash""",
)
def w4(spark, sf):
    rows = compare.reuse_hashes(fx(spark, sf, "fx_local"), fx(spark, sf, "fx_base"))
    return windows.hash_budget(rows, 30).select("vault", "path", "needs_hash", "round")


@query("w5_paginate", "SELECT vault, path, size FROM fx_local ORDER BY vault, path LIMIT 25 OFFSET 50")
def w5(spark, sf):
    rows = fx(spark, sf, "fx_local").select("vault", "path", "size")
    return windows.paginate(rows, [By(F.col("vault")), By(F.col("path"))], 3, 25)


_DEEP = "SELECT event_id, vault, path, op, ts_ms FROM fx_events"


@query("w5_deep_page", f"WITH d AS ({_DEEP}) SELECT * FROM d ORDER BY vault, path DESC, ts_ms, event_id LIMIT 40 OFFSET 7000")
def w5_deep(spark, sf):
    keys = [By(F.col("vault")), By(F.col("path"), True), By(F.col("ts_ms")), By(F.col("event_id"))]
    return windows.paginate(fx(spark, sf, _DEEP), keys, 176, 40)


@query(
    "w6_batches",
    "SELECT path, vault, CAST((row_number() OVER (ORDER BY vault, path) - 1) // 70 AS BIGINT) AS batch FROM fx_local",
)
def w6(spark, sf):
    rows = fx(spark, sf, "fx_local").select("vault", "path")
    return windows.batches(rows, [F.col("vault").asc(), F.col("path").asc()], 70)


_DIFF_ROWS = """SELECT a.conv_id AS note_id, a.turn AS version, 0 AS ord, 0 AS type, substr(a.text, 1, 40) AS text FROM conversations a
UNION ALL SELECT a.conv_id, a.turn, 1, -1, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
UNION ALL SELECT a.conv_id, a.turn, 2, 1, substr(a.text, 41) FROM conversations a WHERE length(a.text) > 40
UNION ALL SELECT a.conv_id, a.turn, 3, 0, concat(chr(10), a.role, chr(10), chr(10), 'end') FROM conversations a
UNION ALL SELECT a.conv_id, a.turn, 4, 1, '' FROM conversations a WHERE a.turn = 0"""


def diff_history(spark, sf):
    """Diff lists of versions; each list is a handful of pieces of one version."""
    rows = fx(spark, sf, _DIFF_ROWS)
    parts = F.array_sort(F.collect_list(F.struct("ord", "type", "text")))
    diffs = F.transform("_p", lambda d: F.struct(d["type"].alias("type"), d["text"].alias("text")))
    return rows.groupBy("note_id", "version").agg(parts.alias("_p")).select("note_id", "version", diffs.alias("diffs"))


_LINES = f"""d AS ({_DIFF_ROWS}),
l AS (SELECT note_id, version, ord, type, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
c AS (SELECT *, sum(CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY note_id, version ORDER BY ord, i) AS line_no FROM l),
seg AS (SELECT note_id, version, CAST(line_no AS BIGINT) AS line_no, row_number() OVER (PARTITION BY note_id, version, line_no ORDER BY ord, i) - 1 AS segment_no, type, text FROM c WHERE text <> '' OR n = 1),
ln AS (SELECT note_id, version, line_no, bool_or(type <> 0) AS has_change, bool_or(type = 1) AS has_add, bool_or(type <> -1) AS counts FROM seg GROUP BY note_id, version, line_no),
lines AS (SELECT note_id, version, line_no, has_change, has_add, CAST(CASE WHEN counts THEN sum(CASE WHEN counts THEN 1 ELSE 0 END) OVER (PARTITION BY note_id, version ORDER BY line_no) END AS BIGINT) AS line_number FROM ln)"""


@query("hi1_diff_to_lines", f"WITH {_LINES} SELECT * FROM seg")
def hi1(spark, sf):
    return history.diff_to_lines(diff_history(spark, sf))


@query("w7_number_diff_lines", f"WITH {_LINES} SELECT * FROM lines")
def w7(spark, sf):
    return history.number_diff_lines(history.diff_to_lines(diff_history(spark, sf)))


@query("hi2_changed_lines", f"WITH {_LINES} SELECT *, line_number IS NULL AS is_pure_delete FROM lines WHERE has_change")
def hi2(spark, sf):
    return history.changed_lines(history.number_diff_lines(history.diff_to_lines(diff_history(spark, sf))))


@query(
    "hi3_rebuild_versions",
    f"""WITH d AS ({_DIFF_ROWS}) SELECT note_id, version, coalesce(string_agg(text, '' ORDER BY ord) FILTER (type <> 1), '') AS text_before,
  coalesce(string_agg(text, '' ORDER BY ord) FILTER (type <> -1), '') AS text_after FROM d GROUP BY note_id, version""",
)
def hi3(spark, sf):
    return history.rebuild_versions(diff_history(spark, sf))


@query(
    "hi4_restore_version",
    """SELECT note_id, version, content, created_at FROM fx_history UNION ALL
SELECT note_id, (SELECT max(version) + 1 FROM fx_history WHERE note_id = 7), content, 1800000000000 FROM fx_history WHERE note_id = 7 AND version = 1""",
)
def hi4(spark, sf):
    rows = fx(spark, sf, "SELECT note_id, version, content, created_at FROM fx_history")
    return history.restore_version(rows, 7, 1, 1800000000000)


@query(
    "w8_version_steps",
    """SELECT note_id, version, row_number() OVER (PARTITION BY note_id ORDER BY version DESC) AS newest_rank,
  lag(version) OVER (PARTITION BY note_id ORDER BY version) AS prev_version, lag(content) OVER (PARTITION BY note_id ORDER BY version) AS text_before FROM fx_history""",
)
def w8(spark, sf):
    return history.version_steps(fx(spark, sf, "fx_history"))


@query(
    "hi5_line_changes",
    """WITH s AS (SELECT note_id, version, lag(version) OVER (PARTITION BY note_id ORDER BY version) AS prev FROM fx_history),
c AS (SELECT note_id, version, line, count(*) AS n FROM (SELECT note_id, version, unnest(string_split(content, chr(10))) AS line FROM fx_history) l GROUP BY ALL),
k AS (SELECT s.note_id, s.version, s.prev, c.line FROM s JOIN c ON c.note_id = s.note_id AND c.version IN (s.version, s.prev) WHERE s.prev IS NOT NULL GROUP BY ALL)
SELECT k.note_id, k.version, k.line, coalesce(a.n, 0) AS n_after, coalesce(b.n, 0) AS n_before FROM k
LEFT JOIN c a ON a.note_id = k.note_id AND a.version = k.version AND a.line = k.line
LEFT JOIN c b ON b.note_id = k.note_id AND b.version = k.prev AND b.line = k.line WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def hi5(spark, sf):
    return history.line_changes(fx(spark, sf, "fx_history"))


@query("w9_log_ring", f"WITH {MERGED} SELECT id, first_seq, status, (row_number() OVER (ORDER BY first_seq DESC) - 1) // 500 AS ring FROM log")
def w9(spark, sf):
    return windows.log_ring(merged_log(spark, sf), 500).select("id", "first_seq", "status", "ring")


@query(
    "so1_order_log",
    f"""WITH {MERGED} SELECT id, "timestamp", category FROM log ORDER BY "timestamp" + CASE WHEN category = 'summary' THEN 2000 ELSE 0 END DESC, category = 'summary' DESC, first_seq DESC LIMIT 50 OFFSET 100""",
)
def so1(spark, sf):
    rows = ordering.log_page(merged_log(spark, sf), 3, 50)
    return rows.select("id", "timestamp", "category")


@query(
    "so2_top_paths",
    """SELECT vault, shown FROM (SELECT DISTINCT vault, shown FROM (SELECT vault, path AS shown FROM fx_local UNION ALL SELECT vault, concat(path, '/') FROM fx_folders) s
  WHERE shown ILIKE 'src1%') q ORDER BY length(shown), shown, vault LIMIT 50""",
)
def so2(spark, sf):
    return ordering.top_paths(filters.path_search(fx(spark, sf, "fx_local"), fx(spark, sf, "fx_folders"), "src1"), 50)


_VERSIONS = """SELECT DISTINCT concat(CASE WHEN o_custkey % 7 = 0 THEN 'v' ELSE '' END, CAST(o_custkey % 5 AS STRING), '.', CAST(o_orderkey % 23 AS STRING), '.', CAST(o_custkey % 13 AS STRING)) AS version FROM orders"""


@query(
    "so3_order_versions",
    f"""WITH v AS ({_VERSIONS}), p AS (SELECT version, list_transform(string_split(ltrim(version, 'v'), '.'), lambda x: CAST(x AS INT)) AS k FROM v WHERE ltrim(version, 'v') <> '4.22.12')
SELECT version, row_number() OVER (ORDER BY k DESC, version) AS position FROM p""",
)
def so3(spark, sf):
    return ordering.order_versions(fx(spark, sf, _VERSIONS), "v4.22.12")


_AMOUNTS = """SELECT c_name AS name, o_orderdate AS paid_at, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(
    "so4_top_records",
    f"""WITH a AS ({_AMOUNTS}), s AS (SELECT name, CAST(sum(cents) AS BIGINT) AS amount,
  CAST(coalesce(sum(cents) FILTER (paid_at > TIMESTAMP '1998-03-31' AND paid_at <= TIMESTAMP '1998-06-30'), 0) AS BIGINT) AS amount_3m FROM a GROUP BY name)
SELECT * FROM s ORDER BY amount_3m DESC, name LIMIT 10 OFFSET 10""",
)
def so4(spark, sf):
    return ordering.top_records(fx(spark, sf, _AMOUNTS), F.to_date(F.lit("1998-06-30")), "amount_3m", 2, 10)


_TO_APPLY = _reconcile_sql("") + """, f AS (SELECT vault, path, kind, outcome FROM r UNION ALL SELECT vault, path, 'folder', CASE WHEN path LIKE '%/en' THEN 'Delete' ELSE 'Modify' END FROM fx_folders)"""


@query(
    "so5_apply_order",
    _TO_APPLY + """ SELECT vault, path, kind, outcome, CAST(CASE WHEN kind = 'folder' AND outcome = 'Delete' THEN 4 ELSE list_position(['folder', 'note', 'file', 'config'], kind) - 1 END AS INTEGER) AS phase,
  CAST(CASE WHEN kind <> 'folder' THEN 0 WHEN outcome = 'Delete' THEN -len(string_split(path, '/')) ELSE len(string_split(path, '/')) END AS INTEGER) AS step FROM f""",
)
def so5(spark, sf):
    folders = fx(spark, sf, "SELECT vault, path, 'folder' AS kind, CASE WHEN path LIKE '%/en' THEN 'Delete' ELSE 'Modify' END AS outcome FROM fx_folders")
    return ordering.apply_order(decisions(spark, sf).select("vault", "path", "kind", "outcome").unionByName(folders))


@query(
    "src10_log_lines",
    f"""WITH {MERGED} SELECT id, first_seq, concat('[', strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d %H:%M:%S'), '] [', rpad(upper(type), 7, ' '), '] [', rpad(upper(category), 12, ' '), '] [',
  rpad(upper(status), 8, ' '), '] ', rpad(action, 25, ' '), CASE WHEN path IS NULL THEN '' ELSE concat(' [Path: ', path, ']') END,
  CASE WHEN message IS NULL THEN '' WHEN category = 'summary' THEN ' [Msg: Sync completed (Incremental): ]' ELSE concat(' [Msg: ', message, ']') END) AS line FROM log""",
)
def src10(spark, sf):
    return log_text.log_lines(merged_log(spark, sf))


@query("src4_load_state", "SELECT vault, device, path, hash, CASE WHEN length(path) % 2 = 0 THEN 0 ELSE mtime END AS mtime, CASE WHEN length(path) % 2 = 0 THEN 0 ELSE size END AS size FROM fx_base")
def src4(spark, sf):
    base = fx(spark, sf, "fx_base")
    new = state_store.state_maps(base.filter(F.length("path") % 2 == 1), 100)
    entry = F.struct(F.col("path").alias("key"), F.col("hash").alias("value"))
    shard = F.pmod(F.xxhash64("path"), F.lit(16))
    old = (
        base.filter(F.length("path") % 2 == 0)
        .groupBy("vault", "device", shard.alias("shard"))
        .agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    )
    return state_store.load_state(new.unionByName(old).drop("shard"))


@query("src5_state_maps", "SELECT vault, device, path, hash, mtime, size FROM fx_base")
def src5(spark, sf):
    return state_store.load_state(state_store.state_maps(fx(spark, sf, "fx_base"), 50)).drop("shard")


_LOGGED = FIELDS + """,
fx_messages_ts AS (SELECT seq, ts FROM fx_messages),
e AS (SELECT f.*, t.ts, CASE WHEN action IN ('NoteSync', 'FileSync', 'SettingSync', 'FolderSync')
    OR (direction = 'receive' AND action IN ('NoteSyncEnd', 'FileSyncEnd', 'SettingSyncEnd', 'FolderSyncEnd', 'SyncEnd')) THEN concat(action, '_full') ELSE action END AS log_action
  FROM fields f JOIN fx_messages_ts t USING (seq)
  WHERE action NOT IN ('Authorization', 'ClientInfo', 'FileUploadCheck', 'FileChunkDownload', 'NoteSyncNeedPush')
    AND NOT (direction = 'receive' AND action IN ('Pong', 'FileSyncUpdate', 'FileSyncChunkDownload')) AND NOT (direction = 'send' AND action = 'Ping')),
logged AS (SELECT seq, coalesce(session_id, concat('m', seq)) AS id, ts, direction AS type, log_action AS action, path, CASE
    WHEN direction = 'send' THEN CASE WHEN action IN ('FileUpload', 'FileDownload', 'ConfigUpload') THEN 'pending' ELSE 'success' END
    WHEN code = 0 OR code > 200 THEN 'error' WHEN session_id IS NULL THEN 'success' WHEN code IS NULL THEN 'pending'
    WHEN action IN ('FileUpload', 'FileDownload', 'ConfigUpload') THEN 'pending' ELSE 'success' END AS status, CAST(NULL AS INTEGER) AS progress,
  CASE WHEN direction = 'receive' THEN coalesce(nullif(message, ''), concat('Code: ', code)) END AS message, msg_vault AS vault FROM e)"""
_LOGGED = _LOGGED.replace("concat('Code: ', code)", "'Code: ' || code")


_MERGED_MESSAGES = MERGED.replace("FROM fx_log", "FROM logged").replace("action LIKE 'Setting%'", "action LIKE 'Setting%' OR action LIKE 'Config%'")


@query("src7_log_events", f"WITH {_LOGGED} SELECT * FROM logged")
def src7_log_events(spark, sf):
    return payloads.log_events(fx(spark, sf, "fx_messages"), "full")


@query("src7_message_log", f"WITH {_LOGGED}, {_MERGED_MESSAGES} SELECT * FROM log")
def src7_message_log(spark, sf):
    """The log of all messages, one row per transfer or message."""
    return aggregates.merge_log(payloads.log_events(fx(spark, sf, "fx_messages"), "full"))


def answer_messages(spark, sf):
    """Acks and pushes as they come over the wire: the one with its fields on top, the other under ``data``."""
    inner = F.struct("path", F.col("hash").alias("contentHash"), "mtime", "size", F.col("last_time").alias("lastTime"))
    actions = F.create_map(*[F.lit(x) for x in ("modify", "NoteSyncModify", "mtime", "NoteSyncMtime", "delete", "NoteSyncDelete", "update", "FileSyncUpdate")])
    pushed = fx(spark, sf, "fx_pushes").select(
        "event_id", "ts_ms", "device", F.concat(actions[F.col("op")], F.lit("|"), F.to_json(F.struct(F.lit(1).alias("code"), "vault", inner.alias("data")))).alias("raw")
    )
    acked = fx(spark, sf, "fx_acks").filter("op <> 'rename'").select(
        "event_id", "ts_ms", "device",
        F.concat(F.when(F.col("op") == "delete", "NoteDeleteAck|").otherwise("NoteModifyAck|"), F.to_json(F.struct("vault", "path", F.col("last_time").alias("lastTime")))).alias("raw"),
    )
    rows = pushed.unionByName(acked)
    return rows.select(F.col("event_id").alias("seq"), F.col("ts_ms").alias("ts"), "device", F.lit("receive").alias("direction"), "raw")


@query(
    "src7_answers",
    """SELECT event_id, ts_ms, vault, path, 'push' AS source, op, hash, mtime, size, last_time FROM fx_pushes
UNION ALL SELECT event_id, ts_ms, vault, path, 'ack', CASE WHEN op = 'delete' THEN 'delete' ELSE 'modify' END, NULL, NULL, NULL, last_time FROM fx_acks WHERE op <> 'rename'""",
)
def src7_answers(spark, sf):
    got, pushes = payloads.settle_feeds(answer_messages(spark, sf))
    rows = pushes.withColumn("source", F.lit("push")).unionByName(got.withColumn("source", F.lit("ack")), allowMissingColumns=True)
    return rows.drop("device")
