"""Registered queries: comparisons, decisions, acknowledgements, sets and state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import acks, aggregates, compare, reconcile, sets, state
from driftline.plans.fixtures import fx
from driftline.plans.reg_filters import book, excluded
from driftline.plans.reg_functions import PATH_HASH, SIGNED
from driftline.plans.registry import query

KEY = "a.vault = b.vault AND a.device = b.device AND a.path = b.path"


@query(
    "jn1_reuse_hashes",
    f"""SELECT a.vault, a.path, a.mtime, b.hash AS cached_hash, b.hash IS NULL AS needs_hash
FROM fx_local a LEFT JOIN fx_base b ON {KEY} AND a.mtime = b.mtime AND a.size = b.size""",
)
def jn1(spark, sf):
    rows = compare.reuse_hashes(fx(spark, sf, "fx_local"), fx(spark, sf, "fx_base"))
    return rows.select("vault", "path", "mtime", "cached_hash", "needs_hash")


@query(
    "jn2_attach_base",
    f"SELECT a.vault, a.path, b.hash AS base_hash, b.hash IS NULL AS base_missing FROM fx_local a LEFT JOIN fx_base b ON {KEY}",
)
def jn2(spark, sf):
    rows = compare.attach_base(fx(spark, sf, "fx_local"), fx(spark, sf, "fx_base"))
    return rows.select("vault", "path", "base_hash", "base_missing")


_GONE = f"""gone AS (SELECT vault, device, CASE WHEN path LIKE '%.md' THEN 'note' ELSE 'file' END AS kind, path, {PATH_HASH.format("path")} AS h
FROM fx_base WHERE NOT {excluded("path")} AND NOT EXISTS (SELECT 1 FROM fx_local l WHERE l.vault = fx_base.vault AND l.path = fx_base.path))"""


def _deleted(spark, sf):
    return compare.detect_deleted(fx(spark, sf, "fx_base"), fx(spark, sf, "fx_local"), book(spark))


@query("jn3_detect_deleted", f"WITH {_GONE} SELECT vault, device, kind, path, {SIGNED} AS path_hash FROM gone")
def jn3(spark, sf):
    return _deleted(spark, sf)


@query("jn3_deleted_counts", f"WITH {_GONE} SELECT vault, kind, count(*) AS n_deleted FROM gone GROUP BY vault, kind")
def jn3_counts(spark, sf):
    return _deleted(spark, sf).groupBy("vault", "kind").agg(F.count(F.lit(1)).alias("n_deleted"))


@query(
    "jn4_detect_missing",
    f"""WITH {_GONE} SELECT 'incremental' AS round, vault, device, kind, path, {SIGNED} AS path_hash FROM gone""",
)
def jn4(spark, sf):
    base, local = fx(spark, sf, "fx_base"), fx(spark, sf, "fx_local")
    inc = compare.detect_missing(base, local, book(spark), incremental=True).withColumn("round", F.lit("incremental"))
    full = compare.detect_missing(base, local, book(spark), incremental=False).withColumn("round", F.lit("full"))
    return inc.unionByName(full)


_NEW_FOLDERS = """SELECT DISTINCT vault, device, source AS path FROM fx_paths WHERE lang <> 'de'
UNION SELECT DISTINCT vault, device, concat(source, '/', lang) AS path FROM fx_paths WHERE lang <> 'de'"""


@query(
    "jn5_detect_folder_changes",
    f"""WITH n AS ({_NEW_FOLDERS}), g AS (SELECT f.*, {PATH_HASH.format("f.path")} AS h FROM fx_folders f
  WHERE NOT {excluded("f.path")} AND NOT EXISTS (SELECT 1 FROM n WHERE n.vault = f.vault AND n.path = f.path))
SELECT vault, device, 'folder' AS kind, path, {SIGNED} AS path_hash, 'deleted' AS change FROM g
UNION ALL SELECT vault, device, 'folder', path, {SIGNED}, 'missing' FROM g""",
)
def jn5(spark, sf):
    old, new = fx(spark, sf, "fx_folders"), fx(spark, sf, _NEW_FOLDERS)
    deleted = compare.detect_folder_changes(old, new, book(spark), True, False)
    return deleted.unionByName(compare.detect_folder_changes(old, new, book(spark), False, True))


_OUTCOMES = """o AS (SELECT coalesce(c.vault, s.vault) AS vault, coalesce(c.path, s.path) AS path, coalesce(c.kind, s.kind) AS kind,
  c.content_hash AS ch, s.content_hash AS sh, b.hash AS bh, c.mtime AS cm, s.mtime AS sm, s.is_deleted AS gone, g.path IS NOT NULL AS reported
FROM fx_client c FULL OUTER JOIN fx_server s ON c.vault = s.vault AND c.path = s.path
LEFT JOIN fx_base b ON b.vault = coalesce(c.vault, s.vault) AND b.path = coalesce(c.path, s.path)
LEFT JOIN reported g ON g.vault = coalesce(c.vault, s.vault) AND g.path = coalesce(c.path, s.path))"""


def _reconcile_sql(strategy: str, reported: str = "SELECT vault, path FROM fx_base WHERE 1 = 0") -> str:
    both = {
        "": "CASE WHEN cm > sm THEN 'NeedPush' ELSE 'Modify' END",
        "newTimeMerge": "CASE WHEN cm > sm THEN 'Merge' ELSE 'Modify' END",
        "ignoreTimeMerge": "'Merge'",
    }[strategy]
    return f"""WITH fx_client AS (SELECT * FROM fx_local), reported AS ({reported}), {_OUTCOMES},
r AS (SELECT vault, path, kind, CASE
  WHEN gone AND ch IS NULL THEN 'None' WHEN gone AND bh = ch THEN 'Delete' WHEN gone THEN 'NeedPush'
  WHEN sh IS NULL THEN 'NeedPush' WHEN ch IS NULL AND reported THEN 'ServerDelete' WHEN ch IS NULL THEN 'Modify'
  WHEN ch = sh AND cm = sm THEN 'None' WHEN ch = sh THEN 'Mtime' WHEN bh = ch THEN 'Modify' WHEN bh = sh THEN 'NeedPush' ELSE {both} END AS outcome,
  NOT coalesce(gone, false) AND sh IS NOT NULL AND ch IS NOT NULL AND ch <> sh AND coalesce(bh <> ch, true) AND coalesce(bh <> sh, true) AS is_conflict
FROM o)"""


def decisions(spark, sf, strategy="", deleted=None):
    local, base = fx(spark, sf, "fx_local"), fx(spark, sf, "fx_base")
    server = reconcile.per_device(fx(spark, sf, "fx_server"), base.select("vault", "device"))
    return reconcile.reconcile(local, base, server, strategy, deleted)


for _name, _strategy in (("newest", ""), ("merge_newest", "newTimeMerge"), ("merge_always", "ignoreTimeMerge")):

    @query(f"jn6_reconcile_{_name}", _reconcile_sql(_strategy) + " SELECT vault, path, kind, outcome, is_conflict FROM r")
    def jn6(spark, sf, strategy=_strategy):
        return decisions(spark, sf, strategy).select("vault", "path", "kind", "outcome", "is_conflict")


_REPORTED = "SELECT vault, path FROM fx_base WHERE NOT EXISTS (SELECT 1 FROM fx_local l WHERE l.vault = fx_base.vault AND l.path = fx_base.path)"


@query("jn6_reconcile_deletes", _reconcile_sql("", _REPORTED) + " SELECT vault, path, kind, outcome, is_conflict FROM r")
def jn6_deletes(spark, sf):
    from driftline.operators.rules import RuleBook

    gone = compare.detect_deleted(fx(spark, sf, "fx_base"), fx(spark, sf, "fx_local"), RuleBook())
    return decisions(spark, sf, "", gone).select("vault", "path", "kind", "outcome", "is_conflict")


_PENDING = """SELECT vault, device, 'note' AS kind, path, hash FROM fx_base UNION ALL SELECT vault, device, kind, path, content_hash AS hash FROM fx_config"""


@query(
    "jn7_recover_pending",
    f"""WITH p AS ({_PENDING}) SELECT vault, kind, path, hash FROM p WHERE kind = 'config' OR EXISTS (SELECT 1 FROM fx_local l WHERE l.vault = p.vault AND l.path = p.path)""",
)
def jn7(spark, sf):
    return compare.recover_pending(fx(spark, sf, _PENDING), fx(spark, sf, "fx_local")).select("vault", "kind", "path", "hash")


@query(
    "jn8_case_conflicts",
    """SELECT DISTINCT i.vault, i.path AS expected_path, l.path AS actual_path FROM fx_case i JOIN fx_local l
ON i.vault = l.vault AND lower(i.path) = lower(l.path) AND i.path <> l.path""",
)
def jn8(spark, sf):
    return compare.case_conflicts(fx(spark, sf, "fx_local"), fx(spark, sf, "fx_case"))


@query(
    "jn9_missing_on_server",
    f"""SELECT l.vault, l.path, l.size FROM fx_local l WHERE l.path NOT LIKE '%.md' AND NOT {excluded("l.path")}
  AND NOT EXISTS (SELECT 1 FROM fx_server s WHERE s.vault = l.vault AND s.path = l.path AND NOT s.is_deleted)""",
)
def jn9(spark, sf):
    rows = compare.missing_on_server(fx(spark, sf, "fx_local"), fx(spark, sf, "fx_server"), book(spark))
    return rows.select("vault", "path", "size")


@query(
    "jn10_verified_removable",
    """SELECT l.vault, l.path FROM fx_local l JOIN fx_server s ON s.vault = l.vault AND s.path = l.path AND s.size = l.size AND s.mtime = l.mtime
WHERE NOT s.is_deleted""",
)
def jn10(spark, sf):
    return compare.verified_removable(fx(spark, sf, "fx_local"), fx(spark, sf, "fx_server")).select("vault", "path")


@query(
    "jn11_unresolved_embeds",
    """WITH e AS (SELECT vault, path AS note_path, regexp_extract_all(text, '!\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1) AS links FROM fx_embeds),
u AS (SELECT vault, note_path, unnest(links) AS link, CAST(generate_subscripts(links, 1) - 1 AS BIGINT) AS ord FROM e),
t AS (SELECT vault, note_path, ord, string_split(link, '#')[1] AS path, substr(link, length(string_split(link, '#')[1]) + 1) AS subpath FROM u)
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM fx_local l WHERE l.vault = t.vault AND l.path = t.path)""",
)
def jn11(spark, sf):
    return compare.unresolved_embeds(fx(spark, sf, "fx_embeds"), fx(spark, sf, "fx_local"))


_TREE = "SELECT vault, path FROM fx_local UNION ALL SELECT vault, path FROM fx_folders"


@query(
    "jn12_shared_tree",
    f"""WITH t AS ({_TREE}) SELECT vault, path, EXISTS (SELECT 1 FROM fx_shared s WHERE s.vault = t.vault
  AND (s.path = t.path OR starts_with(s.path, concat(t.path, '/')))) AS is_shared FROM t""",
)
def jn12(spark, sf):
    return compare.shared_tree(fx(spark, sf, _TREE), fx(spark, sf, "fx_shared"))


_REMOVED = """SELECT vault, device, path FROM fx_folders WHERE path LIKE '%/en' OR path = 'src7'
UNION ALL SELECT vault, device, path FROM fx_paths WHERE path LIKE '%.png'"""


@query(
    "jn13_cascade_delete",
    f"""WITH r AS ({_REMOVED}) SELECT vault, path, hash FROM fx_base b WHERE NOT EXISTS
  (SELECT 1 FROM r WHERE r.vault = b.vault AND (b.path = r.path OR starts_with(b.path, concat(r.path, '/'))))""",
)
def jn13(spark, sf):
    return compare.cascade_delete(fx(spark, sf, "fx_base"), fx(spark, sf, _REMOVED)).select("vault", "path", "hash")


_SENT = "SELECT event_id, ts_ms, vault, device, path, op, content_hash AS hash FROM fx_events WHERE op <> 'rename'"
_PATH_ACKS = """SELECT event_id, ts_ms, vault, device, path, op, last_time FROM fx_acks WHERE op <> 'rename'
UNION ALL SELECT event_id, ts_ms + 5, vault, device, path, op, last_time FROM fx_acks WHERE op <> 'rename' AND event_id % 7 = 0"""


@query(
    "jn14_match_acks",
    f"""WITH m AS (SELECT event_id, ts_ms, vault, device, path, CASE WHEN op = 'delete' THEN 'd' ELSE 'm' END AS op, hash, CAST(NULL AS BIGINT) AS last_time, 0 AS role FROM ({_SENT}) s
  UNION ALL SELECT event_id, ts_ms, vault, device, path, CASE WHEN op = 'delete' THEN 'd' ELSE 'm' END, NULL, last_time, 1 FROM ({_PATH_ACKS}) a),
w AS (SELECT *,
  last_value(CASE WHEN role = 0 AND op = 'm' THEN concat('+', hash) WHEN op = 'd' AND role = 0 OR op = 'm' AND role = 1 THEN '-' END IGNORE NULLS) OVER p AS pw,
  last_value(CASE WHEN role = 0 AND op = 'd' THEN '+' WHEN op = 'm' AND role = 0 OR op = 'd' AND role = 1 THEN '-' END IGNORE NULLS) OVER p AS dw
  FROM m WINDOW p AS (PARTITION BY vault, device, path ORDER BY ts_ms, role, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT vault, path, event_id, ts_ms, last_time, CASE WHEN op = 'm' AND pw LIKE '+%' THEN 'put' WHEN op = 'd' AND dw = '+' THEN 'remove' ELSE 'none' END AS effect,
  CASE WHEN op = 'm' AND pw LIKE '+%' THEN substr(pw, 2) END AS hash
FROM w WHERE role = 1""",
)
def jn14(spark, sf):
    rows = acks.match_acks(fx(spark, sf, _SENT), fx(spark, sf, _PATH_ACKS))
    return rows.select("vault", "path", "event_id", "ts_ms", "last_time", "effect", "hash")


_SENT_FACTS = "SELECT event_id, ts_ms, vault, device, path, op, content_hash AS hash, mtime, size FROM fx_events WHERE op <> 'rename'"
_SETTLED = f"""l AS (
  SELECT event_id, ts_ms, vault, device, path, '0' AS role, CASE WHEN op = 'delete' THEN 'delete' ELSE 'modify' END AS op, hash, mtime, size, CAST(NULL AS BIGINT) AS last_time FROM ({_SENT_FACTS}) s
  UNION ALL SELECT event_id, ts_ms, vault, device, path, '1', op, hash, mtime, size, last_time FROM fx_pushes
  UNION ALL SELECT event_id, ts_ms, vault, device, path, '2', CASE WHEN op = 'delete' THEN 'delete' ELSE 'modify' END, NULL, NULL, NULL, last_time FROM ({_PATH_ACKS}) a),
k AS (SELECT *, concat(role, op) AS what FROM l),
w AS (SELECT *,
  last_value(CASE WHEN what = '0modify' THEN {{'is': true, 'hash': hash, 'mtime': mtime, 'size': size}}
    WHEN what IN ('0delete', '2modify', '1modify', '1mtime', '1delete') THEN {{'is': false, 'hash': NULL, 'mtime': NULL, 'size': NULL}} END IGNORE NULLS) OVER p AS pw,
  last_value(CASE WHEN what = '0delete' THEN true WHEN what IN ('0modify', '2delete', '1modify', '1update') THEN false END IGNORE NULLS) OVER p AS dw
  FROM k WINDOW p AS (PARTITION BY vault, device, path ORDER BY ts_ms, role, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND {{END}})),
e AS (SELECT *, CASE WHEN what = '1modify' THEN 'put' WHEN what IN ('1mtime', '2modify') AND pw.is THEN 'put'
    WHEN what = '1delete' OR what = '2delete' AND dw THEN 'remove' ELSE 'none' END AS effect FROM w WHERE role <> '0'),
f AS (SELECT vault, device, path, event_id, ts_ms, role, CASE role WHEN '1' THEN 'push' ELSE 'ack' END AS source, op, last_time, effect,
  CASE WHEN effect = 'put' THEN CASE WHEN what = '1modify' THEN hash ELSE pw.hash END END AS hash,
  CASE WHEN effect = 'put' THEN CASE WHEN role = '1' THEN mtime ELSE pw.mtime END END AS mtime,
  CASE WHEN effect = 'put' THEN CASE WHEN what = '1modify' THEN size ELSE pw.size END END AS size FROM e)"""
_BEFORE, _UPTO = _SETTLED.replace("{END}", "1 PRECEDING"), _SETTLED.replace("{END}", "CURRENT ROW")


def settled(spark, sf):
    return acks.settle(fx(spark, sf, _SENT_FACTS), fx(spark, sf, _PATH_ACKS), fx(spark, sf, "fx_pushes"))


@query(
    "jn14_settle",
    f"WITH {_BEFORE} SELECT vault, path, event_id, ts_ms, source, op, last_time, effect, hash, mtime, size FROM f",
)
def jn14_settle(spark, sf):
    return settled(spark, sf).drop("device")


@query(
    "jn14_still_waiting",
    f"""WITH {_UPTO}, z AS (SELECT vault, path, arg_max(pw, (ts_ms, role, event_id)) AS pw, coalesce(arg_max(dw, (ts_ms, role, event_id)), false) AS dw
  FROM w GROUP BY vault, path)
SELECT vault, path, CASE WHEN pw.is THEN 'modify' ELSE 'delete' END AS op, pw.hash AS hash, pw.mtime AS mtime, pw.size AS size
FROM z WHERE coalesce(pw.is, false) OR dw""",
)
def jn14_still_waiting(spark, sf):
    return acks.still_waiting(fx(spark, sf, _SENT_FACTS), fx(spark, sf, _PATH_ACKS), fx(spark, sf, "fx_pushes")).drop("device")


@query(
    "jn14_state",
    f"""WITH {_BEFORE}, g AS (SELECT vault, device, path, arg_max({{'effect': effect, 'hash': hash, 'mtime': mtime, 'size': size}}, (ts_ms, role, event_id)) AS e
  FROM f WHERE effect <> 'none' GROUP BY vault, device, path)
SELECT coalesce(s.vault, g.vault) AS vault, coalesce(s.path, g.path) AS path, CASE WHEN g.path IS NULL THEN s.hash ELSE g.e.hash END AS hash,
  CASE WHEN g.path IS NULL THEN s.mtime ELSE coalesce(g.e.mtime, 0) END AS mtime, CASE WHEN g.path IS NULL THEN s.size ELSE coalesce(g.e.size, 0) END AS size
FROM fx_state s FULL JOIN g ON s.vault = g.vault AND s.device = g.device AND s.path = g.path WHERE g.path IS NULL OR g.e.effect = 'put'""",
)
def jn14_state(spark, sf):
    return acks.apply_effects(fx(spark, sf, "fx_state"), settled(spark, sf)).drop("device")


_RENAMES = "SELECT event_id, ts_ms, vault, device, old_path, path FROM fx_events WHERE op = 'rename'"
_RENAME_ACKS = """SELECT event_id, ts_ms, vault, device FROM fx_acks WHERE op = 'rename'
UNION ALL SELECT event_id, ts_ms - 86400000 AS ts_ms, vault, device FROM fx_acks WHERE op = 'rename' AND event_id % 50 = 1"""


@query(
    "jn15_match_rename_acks",
    f"""WITH l AS (SELECT vault, device, event_id, ts_ms, old_path, path, 0 AS role FROM ({_RENAMES}) r
  UNION ALL SELECT vault, device, event_id, ts_ms, NULL, NULL, 1 FROM ({_RENAME_ACKS}) a),
s AS (SELECT *, sum(role) OVER w AS na, sum(1 - role) OVER w AS nr FROM l WINDOW w AS (PARTITION BY vault, device ORDER BY ts_ms, role, event_id)),
q AS (SELECT *, least(0, min(nr - na) OVER (PARTITION BY vault, device ORDER BY ts_ms, role, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low FROM s),
t AS (SELECT vault, device, na + low AS nth, ts_ms AS acked_at FROM q WHERE role = 1 AND nr - na >= low)
SELECT q.vault, q.event_id, q.ts_ms, q.old_path, q.path, CAST(q.nr AS BIGINT) AS nth, t.acked_at
FROM q LEFT JOIN t ON q.vault = t.vault AND q.device = t.device AND q.nr = t.nth WHERE q.role = 0""",
)
def jn15(spark, sf):
    rows = acks.match_rename_acks(fx(spark, sf, _RENAMES), fx(spark, sf, _RENAME_ACKS))
    return rows.select("vault", "event_id", "ts_ms", "old_path", "path", "nth", "acked_at")


@query(
    "jn16_changed_fingerprints",
    "SELECT s.key, s.text, md5(s.text) AS md5 FROM fx_source s LEFT JOIN fx_dict d ON s.key = d.key WHERE md5(s.text) IS DISTINCT FROM d.md5",
)
def jn16(spark, sf):
    return compare.changed_fingerprints(fx(spark, sf, "fx_source"), fx(spark, sf, "fx_dict"))


_SCANNED = "SELECT vault, device, path, content_hash AS hash, mtime - CASE WHEN length(path) % 3 = 0 THEN 7 ELSE 0 END AS mtime, size FROM fx_local"


@query(
    "jn17_commit_scanned",
    f"""WITH n AS ({_SCANNED}) SELECT coalesce(a.vault, b.vault) AS vault, coalesce(a.path, b.path) AS path,
  CASE WHEN b.path IS NULL OR (a.path IS NOT NULL AND a.mtime < b.mtime) THEN CASE WHEN a.path IS NULL THEN b.hash ELSE CASE WHEN b.path IS NULL THEN a.hash ELSE b.hash END END
       WHEN a.path IS NULL THEN b.hash ELSE a.hash END AS hash,
  CASE WHEN a.path IS NULL THEN b.mtime WHEN b.path IS NULL OR b.mtime <= a.mtime THEN a.mtime ELSE b.mtime END AS mtime
FROM n a FULL OUTER JOIN fx_base b ON {KEY}""",
)
def jn17(spark, sf):
    return compare.commit_scanned(fx(spark, sf, "fx_base"), fx(spark, sf, _SCANNED)).select("vault", "path", "hash", "mtime")


_REMOTE_RENAMES = """SELECT doc_id, vault, device, concat('was/', path) AS old_path, path, md5(text) AS content_hash, size FROM fx_paths WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, vault, device, path AS old_path, concat('new/', path) AS path, md5(text) AS content_hash, size FROM fx_paths WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, vault, device, concat('was/', path) AS old_path, path, md5(text) AS content_hash, size + 1 AS size FROM fx_paths WHERE doc_id % 3 = 2"""


@query(
    "jn18_rename_outcome",
    f"""WITH e AS ({_REMOTE_RENAMES}) SELECT e.doc_id, e.path, CASE WHEN EXISTS (SELECT 1 FROM fx_local l WHERE l.vault = e.vault AND l.path = e.old_path) THEN 'rename'
  WHEN EXISTS (SELECT 1 FROM fx_local l WHERE l.vault = e.vault AND l.path = e.path AND l.content_hash = e.content_hash AND (e.path LIKE '%.md' OR l.size = e.size)) THEN 'skip'
  ELSE 'repush' END AS outcome FROM e""",
)
def jn18(spark, sf):
    return compare.rename_outcome(fx(spark, sf, _REMOTE_RENAMES), fx(spark, sf, "fx_local")).select("doc_id", "path", "outcome")


_PICKED = "SELECT vault, path, CASE WHEN length(path) % 2 = 0 THEN md5(path) END AS path_hash FROM fx_local"


@query(
    "jn19_restore_entries",
    f"""WITH p AS ({_PICKED}) SELECT 'restore' AS action, s.vault, s.path, s.is_deleted AND NOT EXISTS (SELECT 1 FROM p WHERE p.vault = s.vault AND p.path = s.path) AS is_deleted FROM fx_server s
UNION ALL SELECT 'purge', s.vault, s.path, s.is_deleted FROM fx_server s
  WHERE NOT (s.is_deleted AND EXISTS (SELECT 1 FROM p WHERE p.vault = s.vault AND p.path = s.path AND p.path_hash IS NOT NULL))""",
)
def jn19(spark, sf):
    server, picked = fx(spark, sf, "fx_server"), fx(spark, sf, _PICKED)
    out = [
        compare.restore_entries(server, picked, a).select(F.lit(a).alias("action"), "vault", "path", "is_deleted")
        for a in ("restore", "purge")
    ]
    return out[0].unionByName(out[1])


ECHO_SQL = """SELECT e.event_id, e.path, e.op, e.ts_ms FROM fx_events e WHERE NOT (e.op IN ('delete', 'rename') AND EXISTS
  (SELECT 1 FROM fx_remote r WHERE r.vault = e.vault AND r.device = e.device AND r.path = e.path AND r.op = e.op AND r.ts_ms BETWEEN e.ts_ms - 500 AND e.ts_ms))"""


@query("jn20_echo_window", ECHO_SQL)
def jn20(spark, sf):
    return acks.echo_window(fx(spark, sf, "fx_events"), fx(spark, sf, "fx_remote")).select("event_id", "path", "op", "ts_ms")


_ALL_KINDS = "vault, device, kind, path, content_hash, mtime, size"


@query(
    "set1_union_manifest",
    f"SELECT {_ALL_KINDS} FROM fx_config UNION ALL SELECT vault, device, 'config', concat('_localStorage/', key), md5(value), mtime, CAST(length(value) AS BIGINT) FROM fx_kv"
    f" UNION ALL SELECT {_ALL_KINDS} FROM fx_local",
)
def set1(spark, sf):
    virtual = fx(spark, sf, "SELECT vault, device, 'config' AS kind, concat('_localStorage/', key) AS path, md5(value) AS content_hash, mtime, CAST(length(value) AS BIGINT) AS size FROM fx_kv")
    names = _ALL_KINDS.split(", ")
    return sets.union_manifest(fx(spark, sf, "fx_config").select(*names), virtual, fx(spark, sf, "fx_local").select(*names))


@query(
    "set2_set_delta",
    """SELECT *, 'added' AS change FROM (SELECT * FROM fx_shared_new EXCEPT SELECT * FROM fx_shared) x
UNION ALL SELECT *, 'removed' FROM (SELECT * FROM fx_shared EXCEPT SELECT * FROM fx_shared_new) y""",
)
def set2(spark, sf):
    return sets.set_delta(fx(spark, sf, "fx_shared"), fx(spark, sf, "fx_shared_new"))


@query(
    "set3_replace_set",
    """SELECT vault, device, path, 'replaced' AS how FROM (SELECT DISTINCT * FROM fx_shared_new) a
UNION ALL SELECT vault, device, path, 'edited' FROM ((SELECT * FROM fx_shared UNION SELECT * FROM fx_shared_new)
   EXCEPT SELECT vault, device, path FROM fx_paths WHERE doc_id % 5 = 0) b""",
)
def set3(spark, sf):
    old, new = fx(spark, sf, "fx_shared"), fx(spark, sf, "fx_shared_new")
    gone = fx(spark, sf, "SELECT vault, device, path FROM fx_paths WHERE doc_id % 5 = 0")
    replaced = sets.replace_set(old, new).withColumn("how", F.lit("replaced"))
    return replaced.unionByName(sets.replace_set(old, add=new, remove=gone).withColumn("how", F.lit("edited")))


@query("set4_intersect_tracked", f"SELECT a.vault, a.path, a.hash FROM fx_base a WHERE EXISTS (SELECT 1 FROM fx_local b WHERE {KEY})")
def set4(spark, sf):
    return sets.intersect_tracked(fx(spark, sf, "fx_base"), fx(spark, sf, "fx_local")).select("vault", "path", "hash")


APPLY_SQL = """changes AS (
  SELECT vault, device, path, op <> 'delete' AS put, content_hash AS hash, mtime, size, ts_ms, event_id, 1 AS part FROM fx_events
  UNION ALL SELECT vault, device, old_path, false, NULL, mtime, size, ts_ms, event_id, 0 FROM fx_events WHERE op = 'rename'),
last AS (SELECT *, row_number() OVER (PARTITION BY vault, device, path ORDER BY ts_ms DESC, event_id DESC, part DESC) AS rn FROM changes),
applied AS (SELECT vault, device, path, hash, mtime, size FROM last WHERE rn = 1 AND put
  UNION ALL SELECT a.vault, a.device, a.path, a.hash, a.mtime, a.size FROM fx_state a WHERE NOT EXISTS (SELECT 1 FROM last b WHERE a.vault = b.vault AND a.device = b.device AND a.path = b.path))"""


@query("st_a1_apply_events", f"WITH {APPLY_SQL} SELECT * FROM applied")
def st_a1(spark, sf):
    return state.apply_events(fx(spark, sf, "fx_state"), fx(spark, sf, "fx_events"))


_MOVES = """SELECT event_id, ts_ms, vault, device, op, CASE WHEN op = 'rename' THEN CASE event_id % 5 WHEN 0 THEN concat('src1/', path) WHEN 1 THEN replace(path, '.md', '.txt') ELSE path END ELSE path END AS path,
  CASE WHEN op = 'rename' AND event_id % 3 = 0 THEN concat('src1/', old_path) ELSE old_path END AS old_path FROM fx_events"""


@query(
    "st_a2_classify_renames",
    f"""WITH m AS ({_MOVES}), x AS (SELECT *, op = 'rename' AND {excluded("path")} AS ne, op = 'rename' AND {excluded("old_path")} AS oe,
   regexp_extract(path, '\\.([^.]+)$', 1) <> regexp_extract(old_path, '\\.([^.]+)$', 1) AS retyped FROM m)
SELECT event_id, op, path, old_path FROM x WHERE op <> 'rename' OR (NOT ne AND NOT oe AND NOT retyped)
UNION ALL SELECT event_id, 'delete', old_path, NULL FROM x WHERE op = 'rename' AND NOT oe AND (ne OR retyped)
UNION ALL SELECT event_id, 'create', path, NULL FROM x WHERE op = 'rename' AND NOT ne AND (oe OR retyped)""",
)
def st_a2(spark, sf):
    return state.classify_renames(fx(spark, sf, _MOVES), book(spark)).select("event_id", "op", "path", "old_path")


_ROUND_PENDING = "SELECT vault, device, path, concat('p', content_hash) AS hash, mtime + 5 AS mtime, size FROM fx_local WHERE path LIKE '%.md'"
_ROUND_DELETES = "SELECT vault, device, path FROM fx_base WHERE length(path) % 4 = 0"


@query(
    "st_a3_commit_round",
    f"""WITH p AS ({_ROUND_PENDING}), d AS ({_ROUND_DELETES}), sc AS ({_SCANNED}),
k AS (SELECT * FROM p UNION ALL SELECT a.* FROM fx_base a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE {KEY}) AND NOT EXISTS (SELECT 1 FROM p b WHERE {KEY}))
SELECT coalesce(a.vault, b.vault) AS vault, coalesce(a.path, b.path) AS path,
  CASE WHEN a.path IS NOT NULL AND (b.path IS NULL OR b.mtime <= a.mtime) THEN a.hash ELSE b.hash END AS hash,
  CASE WHEN a.path IS NOT NULL AND (b.path IS NULL OR b.mtime <= a.mtime) THEN a.mtime ELSE b.mtime END AS mtime
FROM sc a FULL OUTER JOIN k b ON {KEY}""",
)
def st_a3(spark, sf):
    rows = state.commit_round(
        fx(spark, sf, "fx_base"), fx(spark, sf, _ROUND_PENDING), fx(spark, sf, _SCANNED), fx(spark, sf, _ROUND_DELETES)
    )
    return rows.select("vault", "path", "hash", "mtime")


_TRACKED = "SELECT vault, device, 'file' AS kind, path, hash FROM fx_base UNION ALL SELECT vault, device, kind, path, content_hash AS hash FROM fx_config"


@query(
    "st_a4_clear_state",
    f"""WITH t AS ({_TRACKED}) SELECT 'config' AS cleared, vault, kind, path, hash FROM t WHERE NOT (kind = 'config' AND vault = 'vault1')
UNION ALL SELECT 'vault', vault, kind, path, hash FROM t WHERE vault <> 'vault2'""",
)
def st_a4(spark, sf):
    rows = fx(spark, sf, _TRACKED)
    config = state.clear_state(rows, "config", "vault1").withColumn("cleared", F.lit("config"))
    vault = state.clear_state(rows, "all", "vault2").withColumn("cleared", F.lit("vault"))
    return config.unionByName(vault).select("cleared", "vault", "kind", "path", "hash")


_CONF_FOLDERS = """SELECT DISTINCT vault, device, concat('.conf/plugins/', source) AS path FROM fx_paths
UNION SELECT DISTINCT vault, device, concat('.conf/themes/', source) AS path FROM fx_paths
UNION SELECT DISTINCT vault, device, '.conf/snippets' AS path FROM fx_paths"""
_CONF_FILES = "SELECT vault, device, path FROM fx_config WHERE path LIKE '%.js' OR path LIKE '%.css' OR path LIKE '%/deep/%'"


@query(
    "st_a5_empty_folders",
    f"""WITH d AS ({_CONF_FOLDERS}), f AS ({_CONF_FILES}) SELECT vault, device, path FROM d WHERE regexp_matches(path, '^\\.conf/(plugins|themes)/[^/]+$')
  AND NOT EXISTS (SELECT 1 FROM f WHERE f.vault = d.vault AND starts_with(f.path, concat(d.path, '/')))""",
)
def st_a5(spark, sf):
    return state.empty_folders(fx(spark, sf, _CONF_FOLDERS), fx(spark, sf, _CONF_FILES), ".conf")


_NOW = 1704067200000 + 600 * 60000
_POINTS = """SELECT vault, device, md5(path) AS path_hash, concat('s', CAST(doc_id % 4 AS STRING)) AS session_id, md5(text) AS content_hash,
  doc_id % 9 - 1 AS last_chunk, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE mtime + CASE WHEN doc_id % 2 = 0 THEN 36000000 ELSE 0 END END AS timestamp FROM fx_paths"""
_UPLOADS = """SELECT vault, device, path, path_hash, concat('s', CAST(length(path) % 4 AS STRING)) AS session_id, content_hash, CAST(6 AS BIGINT) AS total_chunks FROM fx_local"""


@query(
    "st_a6_expire_checkpoints",
    f"""WITH c AS ({_POINTS}), u AS ({_UPLOADS}) SELECT u.vault, u.path, CASE WHEN c.session_id = u.session_id AND c.content_hash = u.content_hash AND c.last_chunk BETWEEN 0 AND u.total_chunks - 2
   THEN c.last_chunk + 1 ELSE 0 END AS start_chunk
FROM u LEFT JOIN c ON u.vault = c.vault AND u.path_hash = c.path_hash AND {_NOW} - c.timestamp <= 1200000""",
)
def st_a6(spark, sf):
    return state.expire_checkpoints(fx(spark, sf, _POINTS), fx(spark, sf, _UPLOADS), _NOW).select("vault", "path", "start_chunk")


@query(
    "ag1_task_counts",
    _reconcile_sql("") + """, c AS (SELECT vault, kind, count_if(outcome IN ('NeedPush', 'Merge')) AS need_upload, count_if(outcome = 'Modify') AS need_modify,
  count_if(outcome = 'Mtime') AS need_mtime, count_if(outcome = 'Delete') AS need_delete FROM r GROUP BY ROLLUP (vault, kind))
SELECT vault, kind, CAST(need_upload AS BIGINT) AS need_upload, CAST(need_modify AS BIGINT) AS need_modify, CAST(need_mtime AS BIGINT) AS need_mtime, CAST(need_delete AS BIGINT) AS need_delete FROM c""",
)
def ag1(spark, sf):
    return aggregates.task_counts(decisions(spark, sf), totals=True)


def _n(kind: str, outcomes: str) -> str:
    return f"count_if(kind = '{kind}' AND outcome IN ({outcomes}))"


def _part(kind: str) -> str:
    up, mod, rem = _n(kind, "'NeedPush', 'Merge'"), _n(kind, "'Modify', 'Mtime'"), _n(kind, "'Delete'")
    return f"""'"{kind}":{{"upload":', {up}, ',"modify":', {mod}, ',"delete":', {rem}, '}}'"""


@query(
    "ag2_round_summary",
    _reconcile_sql("") + f""" SELECT vault, count_if(kind IN ('note', 'file', 'config') AND outcome IN ('NeedPush', 'Merge', 'Modify', 'Mtime', 'Delete')) > 0 AS has_changes,
  concat('{{"syncType":"full","hasChanges":', CASE WHEN count_if(kind IN ('note', 'file', 'config') AND outcome IN ('NeedPush', 'Merge', 'Modify', 'Mtime', 'Delete')) > 0 THEN 'true' ELSE 'false' END, ',',
   {_part("note")}, ',', {_part("file")}, ',', {_part("config")}, '}}') AS message FROM r GROUP BY vault""",
)
def ag2(spark, sf):
    return aggregates.round_summary(aggregates.task_counts(decisions(spark, sf)), "full")
