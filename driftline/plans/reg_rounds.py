"""Registered queries: whole jobs. Rounds over all paths and texts, and transfers from frames to state."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.fingerprint import string_fingerprint
from driftline.plans import sync_round, transfer
from driftline.plans.fixtures import fx
from driftline.plans.reg_filters import book, excluded, session_files
from driftline.plans.reg_functions import ORACLE_BYTES_HASH, TEXT_HASH
from driftline.plans.reg_joins import _NEW_FOLDERS, _reconcile_sql
from driftline.plans.registry import query
from driftline.sources import wire

KIND = "CASE WHEN path LIKE '%.md' THEN 'note' ELSE 'file' END"
_LISTED = f"""SELECT vault, device, {KIND} AS kind, path, CAST(NULL AS STRING) AS path_hash, CAST(NULL AS STRING) AS content_hash,
  mtime + CASE WHEN doc_id % 5 = 0 THEN 3600000 ELSE 0 END AS mtime, mtime AS ctime, size FROM fx_paths WHERE doc_id % 7 <> 0
UNION ALL SELECT vault, device, 'folder', path, NULL, NULL, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ({_NEW_FOLDERS}) f"""
#: the last synced state: some paths unknown, some with another content
_BASE = "SELECT vault, device, path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE th END AS hash, mtime, size FROM th WHERE doc_id % 11 <> 0"
_SERVER = f"""SELECT vault, {KIND} AS kind, path, CASE WHEN doc_id % 6 = 0 THEN 'server' ELSE th END AS content_hash,
  mtime + CASE WHEN doc_id % 6 = 0 THEN 7200000 WHEN doc_id % 4 = 1 THEN 1000 ELSE 0 END AS mtime, mtime AS ctime, size,
  doc_id % 17 = 0 AS is_deleted, mtime + 7200000 AS last_time FROM th WHERE doc_id % 13 <> 0"""
_MARKS = "SELECT DISTINCT vault, device, 'note' AS kind, 1704067200000 + 30000000 AS last_time FROM fx_paths"

_TABLES = f"""{TEXT_HASH},
th AS (SELECT p.*, t.content_hash AS th FROM fx_paths p JOIN text_hash t ON p.doc_id = t.doc_id),
listed AS ({_LISTED}),
rd_base AS ({_BASE}),
rd_all AS (SELECT l.vault, l.device, l.kind, l.path, h.th AS content_hash, l.mtime, l.size FROM listed l JOIN th h ON l.vault = h.vault AND l.path = h.path WHERE l.kind <> 'folder'),
rd_local AS (SELECT * FROM rd_all WHERE NOT {excluded("path")}),
rd_server AS (SELECT * FROM ({_SERVER}) s WHERE NOT {excluded("path")}),
gone AS (SELECT * FROM rd_base b WHERE NOT {excluded("path")} AND NOT EXISTS (SELECT 1 FROM rd_all l WHERE l.vault = b.vault AND l.path = b.path))"""


def _round(spark, sf, **how) -> sync_round.Round:
    th = fx(spark, sf, "fx_paths").withColumn("th", string_fingerprint(F.col("text")))
    th.createOrReplaceTempView("round_texts")
    base, server = (spark.sql(q.replace("FROM th ", "FROM round_texts ")) for q in (_BASE, _SERVER))
    content = fx(spark, sf, "SELECT vault, device, path, text FROM fx_paths")
    return sync_round.run(fx(spark, sf, _LISTED), content, base, server, book(spark), "newTimeMerge", folder_state=fx(spark, sf, "fx_folders"), **how)


_DECIDED = _reconcile_sql("newTimeMerge", "SELECT vault, path FROM gone").replace("fx_local", "rd_local").replace("fx_server", "rd_server").replace("fx_base", "rd_base")


@query("round_decisions", f"WITH RECURSIVE {_TABLES}, {_DECIDED.removeprefix('WITH ')} SELECT vault, path, kind, outcome, is_conflict FROM r")
def round_decisions(spark, sf):
    return _round(spark, sf, offline_delete=True).decisions.select("vault", "path", "kind", "outcome", "is_conflict")


@query(
    "round_state",
    f"""WITH RECURSIVE {_TABLES},
scanned AS (SELECT l.* FROM rd_local l WHERE NOT EXISTS (SELECT 1 FROM rd_base b WHERE b.vault = l.vault AND b.path = l.path AND b.mtime = l.mtime AND b.size = l.size)),
kept AS (SELECT * FROM rd_base b WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.vault = b.vault AND g.path = b.path))
SELECT coalesce(k.vault, s.vault) AS vault, coalesce(k.path, s.path) AS path, CASE WHEN s.path IS NOT NULL AND (k.path IS NULL OR k.mtime <= s.mtime) THEN s.content_hash ELSE k.hash END AS hash,
  CASE WHEN s.path IS NOT NULL AND (k.path IS NULL OR k.mtime <= s.mtime) THEN s.mtime ELSE k.mtime END AS mtime
FROM kept k FULL JOIN scanned s ON k.vault = s.vault AND k.path = s.path""",
)
def round_state(spark, sf):
    return _round(spark, sf, offline_delete=True).state.select("vault", "path", "hash", "mtime")


@query(
    "round_manifest",
    f"""WITH RECURSIVE {_TABLES}
SELECT l.vault, l.path, l.content_hash, b.hash AS base_hash FROM rd_local l LEFT JOIN rd_base b ON b.vault = l.vault AND b.path = l.path
WHERE NOT (l.kind = 'note' AND l.mtime < 1704067200000 + 30000000 AND b.path IS NOT NULL)""",
)
def round_manifest(spark, sf):
    """What an incremental round sends of paths that are there."""
    done = _round(spark, sf, incremental=True, watermarks=fx(spark, sf, _MARKS))
    return done.manifest.select("vault", "path", "content_hash", "base_hash")


@query(
    "round_reports",
    f"""WITH RECURSIVE {_TABLES}, f AS (SELECT * FROM fx_folders d WHERE NOT {excluded("d.path")} AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.kind = 'folder' AND l.vault = d.vault AND l.path = d.path))
SELECT vault, path, {KIND} AS kind, 'missing' AS change FROM gone UNION ALL SELECT vault, path, 'folder', 'missing' FROM f""",
)
def round_reports(spark, sf):
    """What an incremental round reports as missing: paths and folders."""
    done = _round(spark, sf, incremental=True, watermarks=fx(spark, sf, _MARKS))
    rows = done.missing.withColumn("change", F.lit("missing")).unionByName(done.folders)
    return rows.select("vault", "path", "kind", "change")


_RECEIVING = """SELECT s.session_id, s.vault, 'dev0' AS device, s.path, s.size, s.total_chunks, p.mtime - CASE WHEN p.doc_id % 4 = 0 THEN 7 ELSE 0 END AS mtime
FROM fx_sessions s JOIN fx_paths p ON s.vault = p.vault AND s.path = p.path"""


def frames(spark, sf):
    """Frames as they come: some lost, some twice, some cut short."""
    sent = wire.encode_chunks(session_files(spark, sf).select("session_id", "content"), 256)
    n, first = F.substring("session_id", -12, 12).cast("long"), F.conv(F.hex(F.substring("frame", 37, 4)), 16, 10).cast("long") == 0
    sent = sent.withColumn("seq", F.lit(1).cast("long"))
    short = sent.filter(first & (n % 10 == 4)).withColumn("frame", F.substring("frame", 1, 20))
    again = sent.filter(first & (n % 10 == 1)).withColumn("seq", F.lit(2).cast("long"))
    return sent.filter(~(first & (n % 10 == 0))).unionByName(again).unionByName(short)


@query(
    "transfer_state",
    f"""WITH RECURSIVE {ORACLE_BYTES_HASH},
n AS (SELECT s.vault, s.device, s.path, h.content_hash AS hash, s.mtime, s.size FROM ({_RECEIVING}) s JOIN bytes_hash h ON h.doc_id = CAST(substr(s.session_id, 25) AS BIGINT)
  WHERE h.doc_id % 10 NOT IN (0, 3))
SELECT coalesce(b.vault, n.vault) AS vault, coalesce(b.path, n.path) AS path, CASE WHEN n.path IS NOT NULL AND (b.path IS NULL OR b.mtime <= n.mtime) THEN n.hash ELSE b.hash END AS hash,
  CASE WHEN n.path IS NOT NULL AND (b.path IS NULL OR b.mtime <= n.mtime) THEN n.size ELSE b.size END AS size
FROM fx_base b FULL JOIN n ON b.vault = n.vault AND b.path = n.path""",
)
def transfer_state(spark, sf):
    """The state after all files whose frames came whole."""
    files = transfer.received_files(frames(spark, sf), fx(spark, sf, _RECEIVING))
    return transfer.commit(fx(spark, sf, "fx_base"), files).select("vault", "path", "hash", "size")
