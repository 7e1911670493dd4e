"""Registered queries: scalar functions as table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import fingerprint, media, messages, paths, reports
from driftline.operators import compare
from driftline.plans.fixtures import fx
from driftline.plans.registry import query
from driftline.sources import rounds, wire

_SLASHED = "replace(path, chr(92), '/')"
_BASE = "list_extract(string_split(replace(path, chr(92), '/'), '/'), -1)"


@query(
    "prj1_enrich_paths",
    f"""SELECT doc_id, path,
       CASE WHEN contains({_BASE}, '.') THEN {_BASE} ELSE '' END AS name,
       CASE WHEN contains({_BASE}, '.')
            THEN array_to_string(list_slice(string_split({_BASE}, '.'), 1, -2), '.') ELSE '' END AS stem,
       CASE WHEN contains({_SLASHED}, '/') THEN string_split(path, '/')[1] ELSE '' END AS top,
       CASE WHEN contains(path, '.') THEN concat('.', lower(list_extract(string_split(path, '.'), -1))) ELSE '' END AS ext,
       CASE WHEN suffix(path, '.md') THEN 'note' ELSE 'file' END AS kind,
       array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') AS parent,
       CAST(len(string_split(path, '/')) AS INTEGER) AS depth
FROM fx_odd""",
)
def prj1(spark, sf):
    return paths.enrich_paths(fx(spark, sf, "fx_odd"))


@query(
    "prj2_sanitize_paths",
    """SELECT doc_id, path,
       translate(replace(path, chr(92), '/'), ':*?"<>|', '-------') AS clean_path FROM fx_odd""",
)
def prj2(spark, sf):
    return paths.sanitize_paths(fx(spark, sf, "fx_odd"))


PATH_HASH = """list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))),
                   lambda a, x: (a * 31 + x) % 4294967296)"""
SIGNED = "CAST(CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END AS VARCHAR)"


@query(
    "prj3_fingerprint_paths",
    f"""WITH hashed AS (SELECT vault, path, {PATH_HASH.format("path")} AS h FROM fx_paths)
SELECT vault, path, {SIGNED} AS path_hash FROM hashed""",
)
def prj3(spark, sf):
    return fingerprint.fingerprint_paths(fx(spark, sf, "SELECT vault, path FROM fx_paths"))


#: powers of 31 and the hash of every document text, as a sum of units times powers
TEXT_HASH = """step(i, w) AS (
  SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, (w * 31) % 4294967296 FROM step WHERE i < 511),
leap(j, v) AS (
  SELECT 0, CAST(1 AS BIGINT)
  UNION ALL SELECT j + 1, CAST((CAST(v AS HUGEINT) * (SELECT (w * 31) % 4294967296 FROM step WHERE i = 511)) % 4294967296 AS BIGINT)
  FROM leap WHERE j < 1023),
units AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS pos,
                 length(text) AS n FROM documents WHERE length(text) > 0),
parts AS (SELECT doc_id, (CAST(w AS HUGEINT) * v) % 4294967296 * unicode(c) AS term
          FROM units JOIN step ON i = (n - pos) % 512 JOIN leap ON j = (n - pos) // 512),
sums AS (SELECT doc_id, CAST(sum(term) % 4294967296 AS BIGINT) AS h FROM parts GROUP BY doc_id),
text_hash AS (SELECT d.doc_id, CASE WHEN h IS NULL THEN '0' ELSE CAST(CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END AS VARCHAR) END AS content_hash
FROM documents d LEFT JOIN sums ON d.doc_id = sums.doc_id)"""


@query("prj4_fingerprint_text", f"WITH RECURSIVE {TEXT_HASH} SELECT doc_id, content_hash FROM text_hash")
def prj4(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return fingerprint.fingerprint_text(docs).drop("text")


ORACLE_BYTES_HASH = """step(i, w) AS (
  SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, (w * 31) % 4294967296 FROM step WHERE i < 511),
leap(j, v) AS (
  SELECT 0, CAST(1 AS BIGINT)
  UNION ALL SELECT j + 1, CAST((CAST(v AS HUGEINT) * (SELECT (w * 31) % 4294967296 FROM step WHERE i = 511)) % 4294967296 AS BIGINT)
  FROM leap WHERE j < 1023),
bytes AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents),
units AS (SELECT doc_id, unnest(b) AS c, generate_subscripts(b, 1) AS pos, len(b) AS n FROM bytes WHERE len(b) > 0),
parts AS (SELECT doc_id, (CAST(w AS HUGEINT) * v) % 4294967296 * CAST(concat('0x', c) AS BIGINT) AS term
          FROM units JOIN step ON i = (n - pos) % 512 JOIN leap ON j = (n - pos) // 512),
hashed AS (SELECT doc_id, CAST(sum(term) % 4294967296 AS BIGINT) AS h FROM parts GROUP BY doc_id),
bytes_hash AS (SELECT d.doc_id, CASE WHEN h IS NULL THEN '0' ELSE CAST(CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END AS VARCHAR) END AS content_hash
FROM documents d LEFT JOIN hashed ON d.doc_id = hashed.doc_id)"""


@query("prj5_fingerprint_binary", f"WITH RECURSIVE {ORACLE_BYTES_HASH} SELECT doc_id, content_hash FROM bytes_hash")
def prj5(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return fingerprint.fingerprint_binary(docs).drop("content")


_SIZES = """SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) *
       CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 37 WHEN 3 THEN 1024 WHEN 4 THEN 1234567
            WHEN 5 THEN 1048576 ELSE 7000000001 END AS size FROM orders"""


@query(
    "prj6_size_report",
    f"""WITH s AS ({_SIZES}),
u AS (SELECT * FROM (VALUES (0, 'B'), (1, 'KB'), (2, 'MB'), (3, 'GB'), (4, 'TB'), (5, 'PB'), (6, 'EB')) AS t(p, unit)),
best AS (SELECT id, size, max(p) AS p FROM s JOIN u ON CAST(size AS HUGEINT) >= CAST(power(1024, p) AS HUGEINT) GROUP BY id, size)
SELECT s.id, s.size, CASE WHEN s.size = 0 THEN '0 B' ELSE
  concat(regexp_replace(CAST(round(s.size / power(1024, best.p), 2) AS VARCHAR), '\\.0$', ''), ' ', u.unit) END AS size_text
FROM s LEFT JOIN best ON s.id = best.id LEFT JOIN u ON u.p = best.p""",
)
def prj6(spark, sf):
    return reports.size_report(fx(spark, sf, _SIZES))


@query(
    "prj7_safe_ctime",
    """SELECT vault, path, CASE WHEN ctime > 0 THEN ctime WHEN mtime <> 0 THEN mtime ELSE 1706745600000 END AS safe_ctime
FROM fx_local""",
)
def prj7(spark, sf):
    return reports.safe_ctime(fx(spark, sf, "fx_local"), 1706745600000).select("vault", "path", "safe_ctime")


_MEDIA = """SELECT doc_id, concat(CAST(doc_id AS STRING), CASE doc_id % 9 WHEN 0 THEN '.PNG' WHEN 1 THEN '.ogg' WHEN 2 THEN '.m4a'
       WHEN 3 THEN '.pdf' WHEN 4 THEN '.md' WHEN 5 THEN '' WHEN 6 THEN '.webm' WHEN 7 THEN '.wximage' ELSE '.tar.flac' END) AS path FROM documents"""


@query(
    "prj8_classify_media",
    f"""WITH m AS ({_MEDIA}),
e AS (SELECT doc_id, path, lower(regexp_extract(path, '\\.[^.]*$')) AS ext FROM m)
SELECT doc_id, path, CASE
  WHEN list_contains(['.jpg', '.jpeg', '.png', '.gif', '.bmp', '.svg', '.webp', '.wximage'], ext) THEN 'image'
  WHEN list_contains(['.mp4', '.webm', '.ogg', '.mov', '.avi'], ext) THEN 'video'
  WHEN list_contains(['.mp3', '.wav', '.m4a', '.flac'], ext) THEN 'audio'
  WHEN ext = '.pdf' THEN 'pdf' ELSE 'other' END AS media FROM e""",
)
def prj8(spark, sf):
    return media.classify_media(fx(spark, sf, _MEDIA))


URL_RULES = "src1/@.pdf$.png#https://cdn/{vault}/{path}{subpath}?t={type}\n\n.json#https://j/{vaultPath}\nbroken line\nsrc2@.pdf#https://two/{path}"
_ENC = "replace(replace(replace(url_encode({0}), '%20', '+'), '~', '%7E'), '%2A', '*')"
_FILES = """SELECT vault, path, CASE WHEN doc_id % 3 = 0 THEN concat('#t=', CAST(doc_id AS STRING)) END AS subpath
FROM fx_paths WHERE path NOT LIKE '%.md'"""


@query(
    "prj9_resolve_urls",
    f"""WITH f AS ({_FILES}),
k AS (SELECT *, {PATH_HASH.format("path")} AS h, lower(regexp_extract(path, '\\.[^.]*$')) AS ext FROM f)
SELECT vault, path, subpath, CASE
  WHEN starts_with(path, 'src1/') AND ext IN ('.pdf', '.png')
    THEN concat('https://cdn/', vault, '/', path, coalesce(subpath, ''), '?t=', CASE ext WHEN '.pdf' THEN 'pdf' ELSE 'image' END)
  WHEN ext = '.json' THEN concat('https://j/', path)
  WHEN starts_with(path, 'src2') AND ext = '.pdf' THEN concat('https://two/', path)
  ELSE concat('https://api.example.org/api/file?vault=', {_ENC.format("vault")}, '&path=', {_ENC.format("path")},
              '&token=t+1&pathHash=', {SIGNED}, '&client=desk') END AS url
FROM k""",
)
def prj9(spark, sf):
    return media.resolve_urls(fx(spark, sf, _FILES), URL_RULES, "https://api.example.org", "t 1", "desk")


_SPLIT = """SELECT seq, ts, direction, raw, substr(raw, 1, instr(raw, '|') - 1) AS action, substr(raw, instr(raw, '|') + 1) AS body FROM fx_messages"""


@query(
    "prj10_categorize_log",
    f"""WITH m AS ({_SPLIT})
SELECT seq, action,
  CASE WHEN action = 'SyncSummary' THEN 'summary' WHEN action LIKE 'Note%' THEN 'note' WHEN action LIKE 'File%' THEN 'attachment'
       WHEN action LIKE 'Setting%' OR action LIKE 'Config%' THEN 'config' WHEN action LIKE 'Folder%' THEN 'folder' ELSE 'other' END AS category,
  CASE WHEN action IN ('NoteSync', 'FileSync', 'SettingSync', 'FolderSync')
         OR (direction = 'receive' AND action IN ('NoteSyncEnd', 'FileSyncEnd', 'SettingSyncEnd', 'FolderSyncEnd', 'SyncEnd'))
       THEN concat(action, '_full') ELSE action END AS log_action
FROM m""",
)
def prj10(spark, sf):
    got = messages.categorize_log(wire.split_messages(fx(spark, sf, "fx_messages")), "full")
    return got.select("seq", "action", "category", "log_action")


FIELDS = f"""m AS ({_SPLIT}),
j AS (SELECT * FROM m WHERE json_valid(body)),
x AS (SELECT seq, direction, action,
  nullif(body ->> '$.Path', '') AS tp, nullif(body ->> '$.path', '') AS tq, nullif(body ->> '$.data.Path', '') AS dp, nullif(body ->> '$.data.path', '') AS dq,
  nullif(body ->> '$.sessionId', '') AS ts1, nullif(body ->> '$.SessionID', '') AS ts2,
  nullif(body ->> '$.data.sessionId', '') AS ds1, nullif(body ->> '$.data.SessionID', '') AS ds2,
  coalesce(nullif(body ->> '$.Vault', ''), nullif(body ->> '$.vault', ''), nullif(body ->> '$.data.Vault', ''), nullif(body ->> '$.data.vault', '')) AS msg_vault,
  CAST(body ->> '$.code' AS BIGINT) AS code, nullif(body ->> '$.context', '') AS context, body ->> '$.message' AS message FROM j),
fields AS (SELECT seq, direction, action, msg_vault, code, context, message,
  CASE WHEN direction = 'receive' THEN coalesce(dp, tp, tq, dq) ELSE coalesce(tp, tq, dp, dq) END AS path,
  CASE WHEN direction = 'receive' THEN coalesce(ts1, ds1, ds2) ELSE coalesce(ts1, ts2, ds1, ds2) END AS session_id FROM x)"""


def decoded(spark, sf):
    good, _ = wire.decode_messages(fx(spark, sf, "fx_messages"))
    return messages.message_fields(good)


@query("prj19_message_fields", f"WITH {FIELDS} SELECT * FROM fields")
def prj19(spark, sf):
    return decoded(spark, sf).select(
        "seq", "direction", "action", "msg_vault", "code", "context", "message", "path", "session_id"
    )


@query(
    "prj11_message_status",
    f"""WITH {FIELDS}
SELECT seq, action, CASE
  WHEN direction = 'send' THEN CASE WHEN action IN ('FileUpload', 'FileDownload', 'ConfigUpload') THEN 'pending' ELSE 'success' END
  WHEN code = 0 OR code > 200 THEN 'error'
  WHEN session_id IS NULL THEN 'success'
  WHEN code IS NULL THEN 'pending'
  WHEN action IN ('FileUpload', 'FileDownload', 'ConfigUpload') THEN 'pending' ELSE 'success' END AS status
FROM fields""",
)
def prj11(spark, sf):
    return messages.message_status(decoded(spark, sf)).select("seq", "action", "status")


_SCANS = """SELECT event_id, CASE event_id % 4
  WHEN 0 THEN concat('扫描完成 笔记: ', CAST(user_id AS STRING), ' 附件:', CAST(event_id AS STRING), ' 配置:  ', CAST(event_id % 7 AS STRING))
  WHEN 1 THEN concat('笔记:', CAST(user_id AS STRING), 'x') WHEN 2 THEN 'no counts 附件: none' END AS message FROM events"""


@query(
    "prj12_scan_counts",
    f"""WITH m AS ({_SCANS})
SELECT event_id, message,
  coalesce(TRY_CAST(regexp_extract(message, '笔记:\\s*([0-9]+)', 1) AS BIGINT), 0) AS notes,
  coalesce(TRY_CAST(regexp_extract(message, '附件:\\s*([0-9]+)', 1) AS BIGINT), 0) AS files,
  coalesce(TRY_CAST(regexp_extract(message, '配置:\\s*([0-9]+)', 1) AS BIGINT), 0) AS configs
FROM m""",
)
def prj12(spark, sf):
    return messages.scan_counts_from_text(fx(spark, sf, _SCANS))


_SUMMARIES = """SELECT event_id, CASE WHEN event_id % 9 = 8 THEN '{oops'
  ELSE concat('{"syncType":"', CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'incremental' END, '","hasChanges":true',
   CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',"note":{"upload":', CAST(user_id AS STRING), ',"modify":', CAST(event_id % 4 AS STRING), ',"delete":0}') END,
   ',"file":{"upload":0,"modify":', CAST(event_id % 2 AS STRING), ',"delete":', CAST(event_id % 3 AS STRING), '}}') END AS message FROM events"""


@query(
    "prj13_summary_from_json",
    f"""WITH m AS ({_SUMMARIES}),
v AS (SELECT event_id, message, message ->> '$.syncType' AS sync_type, unnest(['note', 'file', 'config']) AS kind FROM m WHERE json_valid(message)),
c AS (SELECT *, coalesce(CAST(json_extract_string(message, concat('$.', kind, '.upload')) AS BIGINT), 0) AS upload,
             coalesce(CAST(json_extract_string(message, concat('$.', kind, '.modify')) AS BIGINT), 0) AS modify,
             coalesce(CAST(json_extract_string(message, concat('$.', kind, '.delete')) AS BIGINT), 0) AS "delete" FROM v)
SELECT *, upload + modify + "delete" AS total FROM c WHERE upload + modify + "delete" > 0""",
)
def prj13(spark, sf):
    return messages.summary_from_json(fx(spark, sf, _SUMMARIES))


@query(
    "prj14_client_platform",
    """SELECT note_id, version, client_name, CASE WHEN client_name ILIKE '%web%' THEN 'web' WHEN client_name ILIKE '%mac%' THEN 'mac'
  WHEN client_name ILIKE '%win%' THEN 'windows' WHEN client_name ILIKE '%android%' THEN 'android' WHEN client_name ILIKE '%os%' THEN 'ios' ELSE 'unknown' END AS platform
FROM fx_history""",
)
def prj14(spark, sf):
    return reports.client_platform(fx(spark, sf, "SELECT note_id, version, client_name FROM fx_history"))


_SUBPATHS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('#t=', CAST(event_id % 500 AS STRING)) WHEN 1 THEN concat('#t=', CAST(user_id AS STRING), '.5,60')
  WHEN 2 THEN '#t=abc' WHEN 3 THEN concat('#page=', CAST(user_id AS STRING)) WHEN 4 THEN '#t=.25' END AS subpath FROM events"""


@query(
    "prj15_media_offset",
    f"""WITH s AS ({_SUBPATHS})
SELECT event_id, subpath, TRY_CAST(regexp_extract(subpath, '^#t=([0-9]*\\.?[0-9]+)', 1) AS DOUBLE) AS offset_seconds FROM s""",
)
def prj15(spark, sf):
    return media.media_offset(fx(spark, sf, _SUBPATHS))


_AUTH = """SELECT event_id, CAST(305 + event_id % 12 AS INT) AS code,
  CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'undefined' WHEN 2 THEN ' Token was Revoked ' WHEN 3 THEN event_type END AS message,
  CASE event_id % 7 WHEN 0 THEN 'vault no longer exists' WHEN 1 THEN '' WHEN 2 THEN props END AS details FROM events"""


@query(
    "prj16_auth_error_report",
    f"""WITH a AS ({_AUTH}),
texts AS (SELECT * FROM (VALUES (307, 'Authorization token is missing'), (308, 'Session expired or token has been revoked'),
  (309, 'Authorization token is invalid or incomplete'), (310, 'Authorization token has expired'), (312, 'Authorization token is restricted by IP'),
  (313, 'Authorization token is restricted by user agent'), (314, 'Authorization token is restricted by client'), (315, 'Authorization token scope is restricted')) AS t(code, fallback)),
b AS (SELECT a.*, coalesce(nullif(nullif(trim(a.message), ''), 'undefined'), texts.fallback, 'Authorization failed') AS m, coalesce(trim(a.details), '') AS d
      FROM a LEFT JOIN texts ON a.code = texts.code)
SELECT event_id, code, message, details, concat('Service Authorization Error: Code=', CAST(code AS VARCHAR), ' Msg=', m,
  CASE WHEN d <> '' THEN concat(' Details=', d) ELSE '' END,
  CASE WHEN code BETWEEN 307 AND 310 OR regexp_matches(concat(m, ' ', d), '(?i)rotated|revoked|no longer exists|missing')
       THEN ' Hint=Please re-import the API configuration from the management console.' ELSE '' END) AS report
FROM b""",
)
def prj16(spark, sf):
    return reports.auth_error_report(fx(spark, sf, _AUTH))


@query(
    "prj17_version_report",
    """WITH p AS (SELECT *, list_transform(string_split(split_part(current, '-', 1), '.'), lambda x: coalesce(TRY_CAST(x AS DOUBLE), 0)) AS a,
                     list_transform(string_split(split_part(latest, '-', 1), '.'), lambda x: coalesce(TRY_CAST(x AS DOUBLE), 0)) AS b FROM fx_versions)
SELECT id, current, latest,
  current <> '' AND latest <> '' AND list_resize(b, greatest(len(a), len(b)), 0) > list_resize(a, greatest(len(a), len(b)), 0) AS is_new
FROM p""",
)
def prj17(spark, sf):
    return reports.version_report(fx(spark, sf, "fx_versions"))


@query(
    "prj18_to_sync_records",
    """WITH rows_ AS (SELECT vault, device, kind, path, path_hash, content_hash, mtime, ctime, size FROM fx_local
              UNION ALL SELECT vault, device, kind, path, path_hash, content_hash, mtime, ctime, size FROM fx_config)
SELECT l.vault, l.path, l.mtime, concat('{"path":"', l.path, '","pathHash":"', path_hash, '","contentHash":"', content_hash, '","mtime":', l.mtime,
  ',"ctime":', ctime, ',"size":', l.size,
  CASE WHEN kind = 'config' THEN '' WHEN b.hash IS NULL THEN ',"baseHashMissing":true' ELSE concat(',"baseHash":"', b.hash, '"') END, '}') AS record
FROM rows_ l LEFT JOIN fx_base b ON l.vault = b.vault AND l.device = b.device AND l.path = b.path""",
)
def prj18(spark, sf):
    listing = fx(spark, sf, "fx_local").unionByName(fx(spark, sf, "fx_config"))
    based = compare.attach_base(listing, fx(spark, sf, "fx_base"))
    return reports.to_sync_records(based).select("vault", "path", "mtime", "record")


@query(
    "src7_decode_messages",
    f"WITH m AS ({_SPLIT}) SELECT seq, action, CASE WHEN json_valid(body) THEN body END AS body, json_valid(body) AS readable FROM m",
)
def src7(spark, sf):
    good, bad = wire.decode_messages(fx(spark, sf, "fx_messages"))
    return good.select("seq", "action", "body", F.lit(True).alias("readable")).unionByName(
        bad.select("seq", "action", F.lit(None).cast("string").alias("body"), F.lit(False).alias("readable"))
    )


_REQUEST_ITEMS = """SELECT CASE vault WHEN 'vault0' THEN 0 WHEN 'vault1' THEN 1 ELSE 2 END * 2 + CASE kind WHEN 'note' THEN 0 ELSE 1 END AS seq, kind, vault, 1704067200000 AS last_time, concat('c-', vault) AS context,
  CASE WHEN size % 5 = 0 THEN 'deleted' WHEN size % 5 = 1 THEN 'missing' ELSE 'present' END AS state, path, path_hash, content_hash, mtime, ctime, size FROM fx_local"""


@query("src7_requests", f"SELECT * FROM ({_REQUEST_ITEMS}) q")
def src7_requests(spark, sf):
    sent = rounds.encode_requests(fx(spark, sf, _REQUEST_ITEMS)).select("seq", "raw")
    good, _ = wire.decode_messages(sent)
    return rounds.request_items(good)


_TASKS = """SELECT CASE vault WHEN 'vault0' THEN 0 WHEN 'vault1' THEN 1 ELSE 2 END AS seq, path, content_hash, mtime,
  CASE WHEN size % 4 = 0 THEN 'NoteSyncDelete' WHEN size % 4 = 1 THEN 'NoteSyncNeedPush' WHEN size % 4 = 2 THEN 'NoteSyncModify' ELSE 'NoteSyncMtime' END AS task FROM fx_local WHERE kind = 'note'"""


@query(
    "src7_ends",
    f"""WITH t AS ({_TASKS})
SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY path) - 1 AS BIGINT) AS place, task, path, CASE WHEN task = 'NoteSyncModify' THEN content_hash END AS content_hash,
  CASE WHEN task IN ('NoteSyncModify', 'NoteSyncMtime') THEN mtime END AS mtime, count(*) OVER (PARTITION BY seq) AS n_tasks, count(*) FILTER (task = 'NoteSyncModify') OVER (PARTITION BY seq) AS need_modify FROM t""",
)
def src7_ends(spark, sf):
    task = F.struct(
        "path", F.struct(
            F.col("task").alias("action"),
            F.struct(
                "path", F.when(F.col("task") == "NoteSyncModify", F.col("content_hash")).alias("contentHash"),
                F.when(F.col("task").isin("NoteSyncModify", "NoteSyncMtime"), F.col("mtime")).alias("mtime"),
            ).alias("data"),
        ).alias("m"),
    )
    sent = (
        fx(spark, sf, _TASKS)
        .groupBy("seq")
        .agg(F.array_sort(F.collect_list(task)).alias("t"), F.count_if(F.col("task") == "NoteSyncModify").alias("n"))
        .select("seq", F.to_json(F.struct(F.lit(1).alias("code"), F.struct(F.lit(5).alias("lastTime"), F.col("t.m").alias("messages"), F.col("n").alias("needModifyCount")).alias("data"))).alias("body"))
    )
    good, _ = wire.decode_messages(sent.select("seq", F.concat(F.lit("NoteSyncEnd|"), "body").alias("raw")))
    tasks, facts = rounds.end_tasks(good), rounds.end_facts(good).select("seq", "n_tasks", "need_modify")
    return tasks.select("seq", "place", "task", "path", "content_hash", "mtime").join(facts, "seq")
