"""Registered queries: rules, filters and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.messages import log_category
from driftline.operators import filters, rules, vault_rules
from driftline.plans.fixtures import fx
from driftline.plans.reg_functions import FIELDS, PATH_HASH, SIGNED, TEXT_HASH, decoded
from driftline.plans.registry import query
from driftline.sources import listing as listings
from driftline.sources import wire

WHITELIST, EXTENSIONS, FOLDERS = '["src1/en"]', "pdf", '["src1", {"pattern": "src[23]/de"}]'


def book(spark):
    return rules.load_rule_book(spark, WHITELIST, EXTENSIONS, FOLDERS)


def hit(scope: str, path: str = "path") -> str:
    """SQL: the path meets a rule of ``fx_rules`` in this scope."""
    return f"""EXISTS (SELECT 1 FROM fx_rules r WHERE r.scope = '{scope}' AND (regexp_matches({path}, concat('^', r.pattern), 'i')
        OR lower({path}) = lower(r.pattern) OR starts_with(lower({path}), concat(lower(r.pattern), '/'))))"""


def excluded(path: str = "path") -> str:
    return f"""(NOT {hit("whitelist", path)} AND (lower(regexp_extract({path}, '\\.[^.]*$')) = '.pdf' OR {hit("folder", path)}))"""


@query("flt1_load_rules", "SELECT scope, CAST(ord AS INTEGER) AS ord, pattern, case_sensitive, n_paths FROM fx_rules, "
       "LATERAL (SELECT count(*) AS n_paths FROM fx_paths p WHERE starts_with(p.path, concat(fx_rules.pattern, '/')))")  # fmt: skip
def flt1(spark, sf):
    table = rules.load_rules(spark, {"folder": FOLDERS, "extension": EXTENSIONS, "whitelist": WHITELIST})
    paths = fx(spark, sf, "SELECT path FROM fx_paths")
    patterns = [r.pattern for r in table.select("pattern").distinct().collect()]
    counts = paths.agg(*[F.count_if(F.col("path").startswith(p + "/")).alias(f"n{i}") for i, p in enumerate(patterns)])
    per = counts.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("pattern"), F.col(f"n{i}").alias("n_paths")) for i, p in enumerate(patterns)
    ])).alias("_p")).select("_p.pattern", "_p.n_paths")
    return table.join(per, "pattern")


@query("flt2_match_rules", f"SELECT vault, path, {hit('folder')} AS matched FROM fx_paths")
def flt2(spark, sf):
    return rules.match_rules(fx(spark, sf, "SELECT vault, path FROM fx_paths"), book(spark).folders)


@query("flt3_exclude_paths", f"SELECT vault, path FROM fx_local WHERE NOT {excluded()}")
def flt3(spark, sf):
    return rules.exclude_paths(fx(spark, sf, "fx_local"), book(spark)).select("vault", "path")


CONF_FOLDERS, CONF_WHITE, CONF_INTERNAL = "shared/conf/src1", "shared/conf/src1/", [".conf/plugins/src7/"]
CONF_EXCLUDED = """(regexp_matches(path, '^shared/conf/src1') AND NOT starts_with(path, 'shared/conf/src1/')
   OR starts_with(path, '.conf/plugins/src7/'))"""


def config_book(spark):
    return rules.load_rule_book(spark, whitelist=CONF_WHITE, folders=CONF_FOLDERS, internal=CONF_INTERNAL)


@query("flt4_exclude_config", f"SELECT vault, path, size FROM fx_config WHERE NOT {CONF_EXCLUDED}")
def flt4(spark, sf):
    return rules.exclude_config(fx(spark, sf, "fx_config"), config_book(spark)).select("vault", "path", "size")


CONF_SCOPE = "(starts_with(path, '.conf/') OR starts_with(path, '_localStorage/') OR starts_with(path, 'shared/conf/'))"


@query(
    "flt5_config_scope",
    f"WITH c AS (SELECT vault, path FROM fx_config UNION ALL SELECT vault, path FROM fx_paths) SELECT vault, path FROM c WHERE {CONF_SCOPE}",
)
def flt5(spark, sf):
    rows = fx(spark, sf, "SELECT vault, path FROM fx_config UNION ALL SELECT vault, path FROM fx_paths")
    return rules.config_scope(rows, ".conf", "shared/conf//\n")


CONF_LAYOUT = """(regexp_matches(path, '^\\.conf/[^/]+\\.json$') AND NOT path IN ('.conf/workspace.json', '.conf/workspace-mobile.json')
  OR regexp_matches(path, '^\\.conf/plugins/[^/]+/[^/]*\\.(json|js|css)$') OR regexp_matches(path, '^\\.conf/themes/[^/]+/[^/]*\\.(css|json)$')
  OR regexp_matches(path, '^\\.conf/snippets/[^/]*\\.css$'))"""


@query(
    "flt6_watched_config_events",
    f"""SELECT vault, path, mtime FROM fx_config WHERE {CONF_SCOPE} AND NOT contains(path, '/.git')
  AND (NOT starts_with(path, '.conf/') OR {CONF_LAYOUT} OR regexp_matches(path, '^\\.conf/(plugins|themes)/[^/.]+$'))""",
)
def flt6(spark, sf):
    rows = filters.watched_config_events(fx(spark, sf, "fx_config"), ".conf", "shared/conf")
    return rows.select("vault", "path", "mtime")


@query(
    "src2_config_scan",
    f"""SELECT vault, path, mtime FROM fx_config
WHERE ({CONF_LAYOUT} OR starts_with(path, 'shared/conf/')) AND NOT {CONF_EXCLUDED}""",
)
def src2(spark, sf):
    rows = filters.config_scan(fx(spark, sf, "fx_config"), ".conf", "shared/conf", config_book(spark))
    return rows.select("vault", "path", "mtime")


_SIZED = """SELECT vault, kind, path, size * 6000 AS size, mtime FROM fx_local UNION ALL SELECT vault, kind, path, size * 6000 AS size, mtime FROM fx_config"""


@query(
    "flt7_size_guard",
    f"""WITH s AS ({_SIZED}) SELECT vault, kind, path, size, mtime, CASE kind WHEN 'note' THEN size > 20971520 WHEN 'file' THEN size > 52428800
  ELSE size > 134217728 END AS dropped FROM s""",
)
def flt7(spark, sf):
    kept, dropped = filters.size_guard(fx(spark, sf, _SIZED))
    return kept.withColumn("dropped", F.lit(False)).unionByName(dropped.withColumn("dropped", F.lit(True)))


_LISTED = """SELECT vault, device, kind, path, mtime FROM fx_local UNION ALL SELECT vault, device, kind, path, mtime FROM fx_config
UNION ALL SELECT vault, device, 'folder' AS kind, path, mtime FROM fx_folders"""
_WAITING = "SELECT vault, device, path FROM fx_paths WHERE doc_id % 5 = 0"
_MARKS = """SELECT vault, device, kind, 1704067200000 + CASE kind WHEN 'note' THEN 30000000 WHEN 'file' THEN 20000000 ELSE 10000000 END AS last_time
FROM (SELECT DISTINCT vault, device, kind FROM fx_local UNION SELECT DISTINCT vault, device, kind FROM fx_config
      UNION SELECT DISTINCT vault, device, 'folder' AS kind FROM fx_folders) k"""


@query(
    "flt8_incremental_since",
    f"""WITH l AS ({_LISTED}), w AS ({_WAITING}), m AS ({_MARKS})
SELECT l.vault, l.device, l.kind, l.path, l.mtime FROM l LEFT JOIN m USING (vault, device, kind)
WHERE NOT (l.mtime < coalesce(m.last_time, 0) AND (l.kind IN ('config', 'folder') OR
  (EXISTS (SELECT 1 FROM fx_base b WHERE b.vault = l.vault AND b.path = l.path) AND NOT EXISTS (SELECT 1 FROM w WHERE w.vault = l.vault AND w.path = l.path))))""",
)
def flt8(spark, sf):
    return filters.incremental_since(
        fx(spark, sf, _LISTED), fx(spark, sf, "fx_base"), fx(spark, sf, _WAITING), fx(spark, sf, _MARKS)
    )


@query(
    "flt9_path_search",
    """SELECT DISTINCT vault, shown FROM (SELECT vault, path AS shown FROM fx_local UNION ALL SELECT vault, concat(path, '/') FROM fx_folders) s
WHERE shown ILIKE 'src1/e%'""",
)
def flt9(spark, sf):
    return filters.path_search(fx(spark, sf, "fx_local"), fx(spark, sf, "fx_folders"), "SRC1/e")


_ECHO_BASE = """SELECT vault, device, path, max(content_hash) AS hash, max_by(mtime, content_hash) AS last_mtime
FROM fx_events WHERE op IN ('modify', 'create') GROUP BY vault, device, path"""


@query(
    "flt10_suppress_echo",
    f"""WITH b AS ({_ECHO_BASE})
SELECT e.event_id, e.path, e.op FROM fx_events e LEFT JOIN b ON e.vault = b.vault AND e.path = b.path
WHERE NOT coalesce(e.op IN ('modify', 'create') AND e.content_hash = b.hash AND e.mtime = b.last_mtime, false)
  AND NOT (e.op IN ('delete', 'rename') AND EXISTS (SELECT 1 FROM fx_remote r WHERE r.vault = e.vault AND r.path = e.path AND r.op = e.op))""",
)
def flt10(spark, sf):
    base = fx(spark, sf, _ECHO_BASE)
    kept = filters.suppress_echo(fx(spark, sf, "fx_events"), base, base, fx(spark, sf, "fx_remote"))
    return kept.select("event_id", "path", "op")


LOG_CATEGORY = """CASE WHEN action = 'SyncSummary' THEN 'summary' WHEN action LIKE 'Note%' THEN 'note' WHEN action LIKE 'File%' THEN 'attachment'
 WHEN action LIKE 'Setting%' THEN 'config' WHEN action LIKE 'Folder%' THEN 'folder' ELSE 'other' END"""


@query(
    "flt11_log_filter",
    f"""WITH l AS (SELECT *, {LOG_CATEGORY} AS category FROM fx_log)
SELECT seq, category, type, vault, 'all' AS shown FROM l WHERE vault IS NULL OR vault = 'vault1'
UNION ALL SELECT seq, category, type, vault, 'note send' FROM l WHERE category = 'note' AND type = 'send' AND (vault IS NULL OR vault = 'vault1')""",
)
def flt11(spark, sf):
    log = fx(spark, sf, "fx_log").withColumn("category", log_category(F.col("action")))
    every = filters.log_filter(log, vault="vault1").withColumn("shown", F.lit("all"))
    some = filters.log_filter(log, "note", "send", "vault1").withColumn("shown", F.lit("note send"))
    return every.unionByName(some).select("seq", "category", "type", "vault", "shown")


@query("flt12_purge_excluded", f"SELECT vault, path, {excluded()} AS purged FROM fx_base")
def flt12(spark, sf):
    kept, gone = rules.purge_excluded(fx(spark, sf, "fx_base"), book(spark))
    return kept.select("vault", "path", F.lit(False).alias("purged")).unionByName(
        gone.select("vault", "path", F.lit(True).alias("purged"))
    )


@query(
    "flt13_message_scope",
    f"""WITH {FIELDS} SELECT seq, msg_vault, context FROM fields
WHERE (msg_vault IS NULL OR msg_vault = 'vault1' OR msg_vault = '') AND (context IS NULL OR context = 'ctx2')""",
)
def flt13(spark, sf):
    return filters.message_scope(decoded(spark, sf), "vault1", "ctx2").select("seq", "msg_vault", "context")


@query(
    "flt14_loggable",
    f"""WITH {FIELDS} SELECT seq, direction, action FROM fields WHERE NOT (action IN ('Authorization', 'ClientInfo', 'FileUploadCheck', 'FileChunkDownload', 'NoteSyncNeedPush')
  OR direction = 'receive' AND action IN ('Pong', 'FileSyncUpdate', 'FileSyncChunkDownload') OR direction = 'send' AND action = 'Ping')""",
)
def flt14(spark, sf):
    return filters.loggable(decoded(spark, sf)).select("seq", "direction", "action")


@query("flt15_cloud_skip", "SELECT vault, path, kind FROM fx_local WHERE NOT (kind = 'file' AND (path LIKE '%.png' OR path LIKE '%.pdf'))")
def flt15(spark, sf):
    return filters.cloud_skip(fx(spark, sf, "fx_local"), True, True).select("vault", "path", "kind")


_REDIRECTS = """SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'https://sub.example.org/x' WHEN 1 THEN replace(url, 'http:', 'https:')
  WHEN 2 THEN 'not a url' WHEN 3 THEN 'http://Example.net:8080/y' ELSE 'https://badexample.org/' END AS target FROM pages"""
_HOST = "lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#:]+)', 1))"


@query(
    "flt16_redirect_audit",
    f"""WITH p AS ({_REDIRECTS}), h AS (SELECT *, {_HOST.format("url")} AS a, {_HOST.format("target")} AS b FROM p)
SELECT page_id, url, target, b <> '' AND (a = b OR b = 'example.org' OR suffix(b, '.example.org') OR b = 'example.net') AS allowed FROM h""",
)
def flt16(spark, sf):
    return filters.redirect_audit(fx(spark, sf, _REDIRECTS), "*.example.org; example.net\n")


@query(
    "flt17_error_responses",
    f"WITH {FIELDS} SELECT seq, code, code = 530 AS is_conflict FROM fields WHERE code <= 0 OR code >= 300",
)
def flt17(spark, sf):
    return filters.error_responses(decoded(spark, sf)).select("seq", "code", "is_conflict")


@query(
    "src3_virtual_entries",
    f"""WITH RECURSIVE {TEXT_HASH},
p AS (SELECT vault, device, key, coalesce(mtime, 1706745600000) AS mtime, length(value) AS size, concat('_localStorage/', key) AS path FROM fx_kv),
k AS (SELECT *, {PATH_HASH.format("path")} AS h FROM p)
SELECT vault, device, 'config' AS kind, path, {SIGNED} AS path_hash, content_hash, mtime, mtime AS ctime, size
FROM k JOIN text_hash t ON k.key = concat('key', CAST(t.doc_id AS VARCHAR))""",
)
def src3(spark, sf):
    return listings.virtual_entries(fx(spark, sf, "fx_kv"), 1706745600000)


@query(
    "src8_decode_chunks",
    """SELECT session_id, c AS chunk_index, size, least(256, octet_length(b) - c * 256) AS n_bytes, substr(hex(b), c * 512 + 1, 512) AS payload
FROM (SELECT s.session_id, s.size, encode(p.text) AS b, unnest(range(CAST(total_chunks AS BIGINT))) AS c
      FROM fx_sessions s JOIN fx_paths p ON s.vault = p.vault AND s.path = p.path) x""",
)
def src8(spark, sf):
    frames = wire.encode_chunks(session_files(spark, sf), 256)
    got = wire.decode_chunks(frames)
    return got.select(
        "session_id", "chunk_index", "size", F.octet_length("payload").cast("long").alias("n_bytes"), F.hex("payload").alias("payload")
    )


@query(
    "src9_encode_chunks",
    """SELECT vault, session_id, c AS chunk_index, 40 + least(256, octet_length(b) - c * 256) AS frame_bytes,
  concat(hex(encode(session_id)), lpad(to_hex(c), 8, '0')) AS header
FROM (SELECT s.vault, s.session_id, encode(p.text) AS b, unnest(range(CAST(total_chunks AS BIGINT))) AS c
      FROM fx_sessions s JOIN fx_paths p ON s.vault = p.vault AND s.path = p.path) x""",
)
def src9(spark, sf):
    frames = wire.encode_chunks(session_files(spark, sf), 256)
    index = F.conv(F.hex(F.substring("frame", 37, 4)), 16, 10).cast("long")
    return frames.select(
        "vault", "session_id", index.alias("chunk_index"), F.octet_length("frame").cast("long").alias("frame_bytes"),
        F.hex(F.substring("frame", 1, 40)).alias("header"),
    )


def session_files(spark, sf):
    return fx(
        spark,
        sf,
        "SELECT s.*, encode(text) AS content FROM fx_sessions s JOIN fx_paths p ON s.vault = p.vault AND s.path = p.path",
    )


@query(
    "src11_list_entries",
    """WITH h AS (SELECT * FROM fx_server WHERE kind = 'note' AND NOT is_deleted AND path ILIKE '%/en/%'),
t AS (SELECT count(*) AS total_rows FROM h)
SELECT vault, path, mtime, total_rows, CAST(greatest(1, ceil(total_rows / 20.0)) AS BIGINT) AS total_pages
FROM (SELECT * FROM h ORDER BY vault, path LIMIT 20 OFFSET 20) p, t""",
)
def src11(spark, sf):
    page = listings.list_entries(fx(spark, sf, "fx_server"), "note", 2, 20, keyword="/EN/")
    return page.select("vault", "path", "mtime", "total_rows", "total_pages")


_VAULT_RULES = """SELECT DISTINCT vault, 'folder' AS scope, concat(source, '/', lang) AS pattern, false AS case_sensitive FROM fx_paths WHERE lang = 'de' AND vault = 'vault0'
UNION ALL SELECT DISTINCT vault, 'folder', concat(upper(source), '/'), vault = 'vault1' FROM fx_paths WHERE source LIKE '%2'
UNION ALL SELECT DISTINCT vault, 'folder', concat(source, '[01]'), false FROM fx_paths WHERE vault = 'vault2'
UNION ALL SELECT DISTINCT vault, 'extension', CASE vault WHEN 'vault1' THEN 'PDF' ELSE '.json' END, false FROM fx_paths WHERE vault <> 'vault2'
UNION ALL SELECT DISTINCT vault, 'whitelist', concat(source, '/', lang, '/1'), true FROM fx_paths WHERE vault <> 'vault1' AND lang <> 'en'"""


@query(
    "flt3_by_vault",
    f"""WITH v AS ({_VAULT_RULES}),
x AS (SELECT p.vault, p.path, v.scope FROM (SELECT DISTINCT vault, path FROM fx_paths) p JOIN v ON v.vault = p.vault AND CASE WHEN v.scope = 'extension'
    THEN lower(regexp_extract(p.path, '\\.[^.]*$')) = concat('.', ltrim(lower(v.pattern), '.'))
  ELSE regexp_matches(p.path, concat(CASE WHEN v.case_sensitive THEN '' ELSE '(?i)' END, '^', v.pattern))
    OR starts_with(CASE WHEN v.case_sensitive THEN concat(p.path, '/') ELSE lower(concat(p.path, '/')) END, concat(rtrim(CASE WHEN v.case_sensitive THEN v.pattern ELSE lower(v.pattern) END, '/'), '/')) END)
SELECT p.vault, p.path FROM fx_paths p WHERE EXISTS (SELECT 1 FROM x WHERE x.vault = p.vault AND x.path = p.path AND x.scope = 'whitelist')
  OR NOT EXISTS (SELECT 1 FROM x WHERE x.vault = p.vault AND x.path = p.path)""",
)
def flt3_by_vault(spark, sf):
    return vault_rules.exclude_by_vault(fx(spark, sf, "fx_paths").select("vault", "path"), fx(spark, sf, _VAULT_RULES))
