"""Inputs of the reference's shapes, derived from the driver's tables in SQL.

The text runs unchanged in Spark and in DuckDB (apart from the functions in ``_SPARK``), so
both sides of a check see the same rows. Every table is used whole: a remainder of an id only
decides in what way two listings *differ* for a path (deleted, edited, touched), which is
what the comparisons are about.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_SPARK = [
    (re.compile(r"epoch_us\((\w+)\)"), r"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)"),
]

#: name -> SQL, in dependency order
FIXTURES: dict[str, str] = {}

FIXTURES["fx_paths"] = """
SELECT concat('vault', CAST(doc_id % 3 AS STRING)) AS vault, 'dev0' AS device, doc_id,
       concat(source, '/', lang, '/', CAST(doc_id AS STRING),
              CASE WHEN doc_id % 10 = 0 THEN '.png' WHEN doc_id % 10 = 1 THEN '.pdf'
                   WHEN doc_id % 10 = 2 THEN '.json' ELSE '.md' END) AS path,
       source, lang, text, n_chars AS size, 1704067200000 + doc_id * 60000 AS mtime
FROM documents"""

FIXTURES["fx_odd"] = """
SELECT doc_id, CASE doc_id % 8
         WHEN 0 THEN replace(path, '/', chr(92)) WHEN 1 THEN concat(source, ' a:b?/c*d<e>.MD')
         WHEN 2 THEN concat(source, '/v1.2/no_dot', lang) WHEN 3 THEN concat(source, '/', lang, '/')
         WHEN 4 THEN concat(lang, CAST(doc_id AS STRING)) WHEN 5 THEN concat(source, '|"x".tar.gz')
         WHEN 6 THEN '' ELSE path END AS path
FROM fx_paths"""

FIXTURES["fx_base"] = """
SELECT vault, device, path, md5(text) AS hash, mtime, size FROM fx_paths WHERE doc_id % 11 <> 0"""

FIXTURES["fx_local_text"] = """
SELECT vault, device, CASE WHEN path LIKE '%.md' THEN 'note' ELSE 'file' END AS kind, path,
       CASE WHEN doc_id % 5 = 0 THEN concat(text, ' edited') ELSE text END AS text,
       mtime + CASE WHEN doc_id % 5 = 0 THEN 3600000 ELSE 0 END AS mtime,
       CASE WHEN doc_id % 4 = 0 THEN 0 ELSE mtime END AS ctime, size
FROM fx_paths WHERE doc_id % 7 <> 0"""

FIXTURES["fx_local"] = """
SELECT vault, device, kind, path, md5(path) AS path_hash, md5(text) AS content_hash, mtime, ctime, size
FROM fx_local_text"""

FIXTURES["fx_server"] = """
SELECT vault, CASE WHEN path LIKE '%.md' THEN 'note' ELSE 'file' END AS kind, path,
       md5(CASE WHEN doc_id % 6 = 0 THEN concat(text, ' server') ELSE text END) AS content_hash,
       mtime + CASE WHEN doc_id % 6 = 0 THEN 7200000 WHEN doc_id % 4 = 1 THEN 1000 ELSE 0 END AS mtime,
       mtime AS ctime, size, doc_id % 17 = 0 AS is_deleted, mtime + 7200000 AS last_time
FROM fx_paths WHERE doc_id % 13 <> 0"""

FIXTURES["fx_rules"] = """
SELECT * FROM (VALUES ('folder', 0, 'src1', false), ('folder', 1, 'src[23]/de', false),
                      ('extension', 0, 'pdf', false), ('whitelist', 0, 'src1/en', false))
         AS t(scope, ord, pattern, case_sensitive)"""

FIXTURES["fx_case"] = """
SELECT vault, upper(path) AS path FROM fx_paths WHERE doc_id % 5 = 0
UNION ALL SELECT vault, path FROM fx_paths WHERE doc_id % 5 = 1"""

FIXTURES["fx_folders"] = """
SELECT vault, device, path, max(mtime) AS mtime FROM (
  SELECT vault, device, source AS path, mtime FROM fx_paths
  UNION ALL SELECT vault, device, concat(source, '/', lang) AS path, mtime FROM fx_paths) f
GROUP BY vault, device, path"""

FIXTURES["fx_config"] = """
SELECT vault, device, 'config' AS kind, path, md5(path) AS path_hash, md5(text) AS content_hash,
       mtime, mtime AS ctime, size
FROM (
  SELECT vault, device, text, mtime, size,
    CASE doc_id % 14
      WHEN 0 THEN concat('.conf/', lang, CAST(doc_id AS STRING), '.json')
      WHEN 1 THEN '.conf/workspace.json'
      WHEN 2 THEN concat('.conf/plugins/', source, '/main', CAST(doc_id AS STRING), '.js')
      WHEN 3 THEN concat('.conf/plugins/', source, '/data', CAST(doc_id AS STRING), '.txt')
      WHEN 4 THEN concat('.conf/plugins/', source, '/deep/x', CAST(doc_id AS STRING), '.json')
      WHEN 5 THEN concat('.conf/themes/', source, '/theme', CAST(doc_id AS STRING), '.css')
      WHEN 6 THEN concat('.conf/themes/', source, '/theme', CAST(doc_id AS STRING), '.js')
      WHEN 7 THEN concat('.conf/snippets/', lang, CAST(doc_id AS STRING), '.css')
      WHEN 8 THEN concat('.conf/snippets/', lang, '/', CAST(doc_id AS STRING), '.css')
      WHEN 9 THEN concat('shared/conf/', source, '/', CAST(doc_id AS STRING), '.bin')
      WHEN 10 THEN concat('_localStorage/key', CAST(doc_id AS STRING))
      WHEN 11 THEN concat('.conf/plugins/', source, '/.git/', CAST(doc_id AS STRING))
      WHEN 12 THEN concat('.conf/plugins/', source)
      ELSE concat('.conf/', lang, CAST(doc_id AS STRING), '.md') END AS path
  FROM fx_paths) c"""

FIXTURES["fx_kv"] = """
SELECT concat('vault', CAST(doc_id % 3 AS STRING)) AS vault, 'dev0' AS device,
       concat('key', CAST(doc_id AS STRING)) AS key, text AS value,
       CASE WHEN doc_id % 2 = 0 THEN 1704067200000 + doc_id * 60000 END AS mtime
FROM documents"""

FIXTURES["fx_events"] = """
SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms, concat('vault', CAST(user_id % 3 AS STRING)) AS vault, 'dev0' AS device,
       CASE event_type WHEN 'purchase' THEN 'rename' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create'
            ELSE 'modify' END AS op,
       CASE WHEN event_type = 'purchase' THEN concat('r/', CAST(user_id AS STRING), '.md')
            ELSE concat('u/', CAST(user_id AS STRING), '.md') END AS path,
       CASE WHEN event_type = 'purchase' THEN concat('u/', CAST(user_id AS STRING), '.md') END AS old_path,
       CASE WHEN event_type = 'error' THEN NULL ELSE md5(concat(props, CAST(event_id AS STRING))) END AS content_hash,
       CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS mtime, CAST(floor(value * 100) AS BIGINT) AS size
FROM events"""

FIXTURES["fx_state"] = """
SELECT vault, device, path, min(md5(path)) AS hash, 1704000000000 AS mtime, CAST(7 AS BIGINT) AS size
FROM (SELECT vault, device, path FROM fx_events
      UNION ALL SELECT vault, device, concat('keep/', path) AS path FROM fx_events) s
GROUP BY vault, device, path"""

FIXTURES["fx_acks"] = """
SELECT event_id, ts_ms + 200 AS ts_ms, vault, device, path, op, ts_ms + 150 AS last_time
FROM fx_events WHERE event_id % 9 <> 0"""

FIXTURES["fx_pushes"] = """
SELECT event_id, ts_ms + CASE WHEN event_id % 3 = 0 THEN 300 ELSE 100 END AS ts_ms, vault, device, path,
       CASE event_id % 4 WHEN 0 THEN 'modify' WHEN 1 THEN 'mtime' WHEN 2 THEN 'delete' ELSE 'update' END AS op,
       CASE WHEN event_id % 4 = 0 THEN md5(concat(path, 'server', CAST(event_id AS STRING))) END AS hash,
       ts_ms + 77 AS mtime, size + 1 AS size, ts_ms + 90 AS last_time
FROM fx_events WHERE op <> 'rename' AND event_id % 5 <> 2"""

FIXTURES["fx_remote"] = """
SELECT vault, device, path, ts_ms - 300 AS ts_ms, op FROM fx_events WHERE event_id % 20 = 0
UNION ALL
SELECT vault, device, path, ts_ms - 501 AS ts_ms, op FROM fx_events WHERE event_id % 20 = 1
UNION ALL
SELECT vault, device, path, ts_ms - 500 AS ts_ms, op FROM fx_events WHERE event_id % 20 = 2"""

FIXTURES["fx_log"] = """
SELECT event_id AS seq, concat('s', CAST(CAST(floor(event_id / 4) AS BIGINT) AS STRING)) AS id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts,
       CASE event_id % 3 WHEN 0 THEN 'send' WHEN 1 THEN 'receive' ELSE 'info' END AS type,
       CASE event_type WHEN 'click' THEN 'NoteModify' WHEN 'view' THEN 'FileUpload' WHEN 'purchase' THEN 'SettingSync'
            WHEN 'error' THEN 'FolderSync' ELSE 'SyncSummary' END AS action,
       CASE WHEN event_id % 6 = 5 THEN NULL ELSE concat('u/', CAST(user_id AS STRING), '.md') END AS path,
       CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending' WHEN 2 THEN 'success' WHEN 3 THEN 'error'
            WHEN 4 THEN 'pending' ELSE NULL END AS status,
       CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(event_id % 101 AS INT) END AS progress,
       CASE WHEN event_id % 8 = 3 THEN NULL ELSE props END AS message,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('vault', CAST(CAST(floor(event_id / 4) AS BIGINT) % 3 AS STRING)) END AS vault
FROM events"""

FIXTURES["fx_messages"] = """
SELECT event_id AS seq, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts, CASE WHEN event_id % 2 = 0 THEN 'receive' ELSE 'send' END AS direction,
       concat(
         CASE event_id % 12 WHEN 0 THEN 'NoteModify' WHEN 1 THEN 'NoteSync' WHEN 2 THEN 'FileUpload'
              WHEN 3 THEN 'FileChunkDownload' WHEN 4 THEN 'SettingSyncEnd' WHEN 5 THEN 'Ping' WHEN 6 THEN 'Pong'
              WHEN 7 THEN 'FolderSyncModify' WHEN 8 THEN 'NoteSyncNeedPush' WHEN 9 THEN 'FileSyncUpdate'
              WHEN 10 THEN 'FileDownload' ELSE 'ConfigUpload' END, '|',
         CASE WHEN event_id % 10 = 0 THEN '{"broken": '
              WHEN event_id % 10 = 1 THEN concat('{"Path":"u/', CAST(user_id AS STRING), '.md","vault":"vault', CAST(user_id % 3 AS STRING), '","code":1}')
              WHEN event_id % 10 = 2 THEN concat('{"data":{"path":"d/', CAST(user_id AS STRING), '.md","vault":"vault1","sessionId":"S', CAST(event_id AS STRING), '"},"code":200}')
              WHEN event_id % 10 = 3 THEN concat('{"path":"p/', CAST(user_id AS STRING), '.md","Vault":"vault2","sessionId":"T', CAST(event_id AS STRING), '"}')
              WHEN event_id % 10 = 4 THEN concat('{"code":530,"message":"conflict","data":{"Path":"c/', CAST(user_id AS STRING), '.md","SessionID":"U', CAST(event_id AS STRING), '"}}')
              WHEN event_id % 10 = 5 THEN concat('{"code":0,"vault":"vault0","context":"ctx', CAST(user_id % 4 AS STRING), '"}')
              WHEN event_id % 10 = 6 THEN concat('{"code":307,"Path":"","path":"e/', CAST(user_id AS STRING), '.md","context":"ctx', CAST(user_id % 4 AS STRING), '"}')
              WHEN event_id % 10 = 7 THEN concat('{"code":150,"vault":"","message":"ok|', CAST(event_id AS STRING), '"}')
              ELSE props END) AS raw
FROM events"""

FIXTURES["fx_history"] = """
SELECT conv_id AS note_id, turn AS version, concat('h/', CAST(conv_id AS STRING), '.md') AS path, text AS content,
       concat(role, CASE conv_id % 8 WHEN 0 THEN '-Web' WHEN 1 THEN ' MacBook' WHEN 2 THEN ' Win11' WHEN 3 THEN 'Android'
              WHEN 4 THEN ' iOS' WHEN 5 THEN ' macOS web' WHEN 6 THEN ' linux' ELSE ' chromeos' END) AS client_name,
       1704067200000 + conv_id * 1000000 + turn * 1000 AS created_at
FROM conversations"""

FIXTURES["fx_embeds"] = """
SELECT vault, path, CASE WHEN doc_id % 8 = 0
            THEN concat(text, ' ![[', source, '/', lang, '/', CAST(doc_id + 1 AS STRING), '.pdf#t=', CAST(doc_id % 90 AS STRING), '.5]] and ![[',
                        source, '/', lang, '/', CAST(doc_id AS STRING), '.png]]')
            WHEN doc_id % 8 = 1 THEN concat(text, ' ![[', path, '#t=x]]')
            WHEN doc_id % 8 = 2 THEN concat(text, ' ![[img/a', CAST(doc_id AS STRING), '.webp#page=3]]') ELSE text END AS text
FROM fx_paths"""

FIXTURES["fx_shared"] = """
SELECT p.vault, p.device, p.path FROM labels l JOIN fx_paths p ON l.doc_id = p.doc_id WHERE l.quality = 1"""

FIXTURES["fx_shared_new"] = """
SELECT p.vault, p.device, p.path FROM labels l JOIN fx_paths p ON l.doc_id = p.doc_id WHERE l.toxic = 1
UNION SELECT vault, device, path FROM fx_shared WHERE size(path) > 14"""
FIXTURES["fx_shared_new"] = FIXTURES["fx_shared_new"].replace("size(path)", "length(path)")

FIXTURES["fx_versions"] = """
SELECT o_orderkey AS id,
       CASE o_orderkey % 6 WHEN 0 THEN '1.2' WHEN 1 THEN '1.2.0-alpha' WHEN 2 THEN '1.10.0' WHEN 3 THEN ''
            WHEN 4 THEN concat('1.', CAST(o_custkey % 30 AS STRING)) ELSE concat('v', CAST(o_custkey % 4 AS STRING), '.0') END AS current,
       CASE o_custkey % 5 WHEN 0 THEN '1.2.0' WHEN 1 THEN '1.9' WHEN 2 THEN '2.x' WHEN 3 THEN '1.10.1'
            ELSE concat('1.', CAST(o_orderkey % 20 AS STRING), '.3-beta.1') END AS latest
FROM orders"""

FIXTURES["fx_dict"] = """
SELECT concat('k', CAST(item_id AS STRING)) AS key,
       md5(CASE WHEN item_id % 5 = 0 THEN concat(text, 'x') ELSE text END) AS md5
FROM benchmark WHERE item_id % 3 <> 0"""

FIXTURES["fx_source"] = "SELECT concat('k', CAST(item_id AS STRING)) AS key, text FROM benchmark"

FIXTURES["fx_pending"] = """
SELECT vault, device, path, op, content_hash AS hash, ts_ms AS seq FROM fx_events WHERE op = 'modify' OR op = 'create'"""

FIXTURES["fx_sessions"] = """
SELECT concat('00000000-0000-0000-0000-', lpad(CAST(doc_id AS STRING), 12, '0')) AS session_id, vault, path,
       CASE WHEN doc_id % 10 = 3 THEN octet_length_of + 1 ELSE octet_length_of END AS size,
       greatest(CAST(1 AS BIGINT), CAST(ceil(octet_length_of / 256.0) AS BIGINT)) AS total_chunks
FROM (SELECT doc_id, vault, path, CAST(octet_length(encode(text)) AS BIGINT) AS octet_length_of FROM fx_paths) s"""
_SPARK.append((re.compile(r"encode\(text\)"), "encode(text, 'UTF-8')"))


def fixture_names(sql: str) -> list[str]:
    """Fixtures that ``sql`` needs, each after those it depends on."""
    need: set[str] = set()
    todo = set(re.findall(r"\bfx_\w+", sql)) & FIXTURES.keys()
    while todo:
        name = todo.pop()
        need.add(name)
        todo |= (set(re.findall(r"\bfx_\w+", FIXTURES[name])) & FIXTURES.keys()) - need
    return [n for n in FIXTURES if n in need]


def with_fixtures(sql: str) -> str:
    """``sql`` with the fixtures it names put in front as common table expressions."""
    names = fixture_names(sql)
    if not names:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({FIXTURES[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def spark_text(sql: str) -> str:
    for pattern, new in _SPARK:
        sql = pattern.sub(new, sql)
    return sql


def register_tables(spark: SparkSession, sf_dir: str, names) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fx(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture by name, or a query over fixtures, as a DataFrame."""
    if re.fullmatch(r"\w+", sql):
        sql = f"SELECT * FROM {sql}"
    text = spark_text(with_fixtures(sql))
    register_tables(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text)])
    return spark.sql(text)
