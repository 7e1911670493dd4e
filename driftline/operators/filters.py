"""Row filters over listings, events, logs and messages. None of them shuffles, unless it
compares with a second table."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.media import media_type
from driftline.functions.messages import SILENT_RECEIVED, SILENT_SENT
from driftline.functions.paths import extension
from driftline.operators.rules import RuleBook, custom_dirs, in_config_scope, is_config_excluded, matches
from driftline.operators.skew import join_facts

# Size limits in bytes and the layout of a config folder.
NOTE_LIMIT = 20 * 1024 * 1024
FILE_LIMIT = 50 * 1024 * 1024
BINARY_LIMIT = 128 * 1024 * 1024
ROOT_CONFIG_SKIPPED = ["workspace.json", "workspace-mobile.json"]
PLUGIN_EXTS = [".json", ".js", ".css"]
THEME_EXTS = [".css", ".json"]
CONFLICT_CODE = 530


def _layout(config_dir: str, folder: str) -> str:
    """Files of a config folder by place and ending, as one pattern. ``folder`` matches the name of a
    plugin or theme folder."""

    def ends(exts: list[str]) -> str:
        return "[^/]*(?:" + "|".join(re.escape(e) for e in exts) + ")"

    places = [
        "[^/]*\\.json",
        f"plugins/{folder}/{ends(PLUGIN_EXTS)}",
        f"themes/{folder}/{ends(THEME_EXTS)}",
        "snippets/[^/]*\\.css",
    ]
    return rf"\A{re.escape(config_dir)}/(?:{'|'.join(places)}"


def _skipped_root(path: Column, config_dir: str) -> Column:
    return path.isin([f"{config_dir}/{name}" for name in ROOT_CONFIG_SKIPPED])


def is_config_file(path: Column, config_dir: str, custom: Iterable[str], book: RuleBook) -> Column:
    """Files a config scan lists: by depth, folder and extension inside the config folder; all
    files of custom folders. A whitelist hit saves a skipped root file."""
    hit = path.rlike(_layout(config_dir, "[^/]+") + r")\z") & ~(
        _skipped_root(path, config_dir) & ~matches(path, book.whitelist)
    )
    for d in custom:
        hit = hit | path.startswith(d + "/")
    return hit & ~is_config_excluded(path, book)


def config_scan(listing: DataFrame, config_dir: str, custom: str = "", book: RuleBook = RuleBook()) -> DataFrame:
    return listing.filter(is_config_file(F.col("path"), config_dir, custom_dirs(custom), book))


def watched_config_events(
    df: DataFrame, config_dir: str, custom: str = "", book: RuleBook = RuleBook(), path: str = "path"
) -> DataFrame:
    """Raw events that may concern a config file.

    Outside the config folder all paths of the scope pass. Inside it a whitelist hit passes;
    else layout decides, where plugin and theme folders themselves (no dot in the name) pass too.
    """
    p = F.col(path)
    by_layout = p.rlike(_layout(config_dir, "[^/.]+") + r"|(?:plugins|themes)/[^/.]+)\z")
    passes = (
        ~p.startswith(config_dir + "/") | matches(p, book.whitelist) | (by_layout & ~_skipped_root(p, config_dir))
    )
    noise = p.contains("/.git") | p.contains("/.DS_Store")
    return df.filter(~noise & in_config_scope(p, config_dir, custom_dirs(custom)) & passes)


def is_oversized(kind: Column, size: Column, binary_limit: bool = True) -> Column:
    """Notes over 20 MiB, attachments over 50 MiB; config files over 128 MiB unless switched off."""
    large = (size > BINARY_LIMIT) if binary_limit else F.lit(False)
    return (
        F.when(kind == "note", size > NOTE_LIMIT)
        .when(kind == "file", (size > FILE_LIMIT) | large)
        .when(kind == "config", large)
        .otherwise(False)
    )


def size_guard(df: DataFrame, binary_limit: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows small enough to be synced, and the rows that are reported instead."""
    big = F.coalesce(is_oversized(F.col("kind"), F.col("size"), binary_limit), F.lit(False))
    return df.filter(~big), df.filter(big)


def incremental_since(df: DataFrame, base: DataFrame, pending: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Rows a round since the watermark must still look at.

    A note or file is skipped when it is older than the watermark of its kind, is known in
    the base and is not pending. Config rows and folders are skipped by age alone.
    ``base`` has one row per path, ``watermarks`` one per (vault, device, kind).
    """
    key = ["vault", "device", "path"]
    known = base.select(*key, F.lit(True).alias("_known"))
    waiting = pending.select(*key).distinct().withColumn("_waiting", F.lit(True))
    marks = watermarks.select("vault", "device", "kind", F.col("last_time").alias("_mark"))
    old = F.col("mtime") < F.coalesce(F.col("_mark"), F.lit(0))
    settled = F.col("_known").isNotNull() & F.col("_waiting").isNull()
    skipped = F.when(F.col("kind").isin("note", "file"), old & settled).otherwise(old)
    return (
        join_facts(df, marks, ["vault", "device", "kind"], ["path"])
        .join(known, key, "left")
        .join(waiting, key, "left")
        .filter(~skipped)
        .select(*df.columns)
    )


def path_search(
    files: DataFrame,
    folders: DataFrame,
    prefix: str,
    only_folders: bool = False,
    only_hidden: bool = False,
    exclude_config: str | None = None,
) -> DataFrame:
    """Case-blind prefix search; a folder shows with a slash at its end."""
    shown = F.when(F.col("path").endswith("/"), F.col("path")).otherwise(F.concat("path", F.lit("/")))
    found = folders.select("vault", "path", shown.alias("shown"))
    if not only_folders:
        found = found.unionByName(files.select("vault", "path", F.col("path").alias("shown")))
    bare = F.regexp_replace("path", r"/\z", "")
    keep = (F.col("path") != "") & (F.col("path") != "/") & F.lower("shown").startswith(prefix.lower())
    if only_hidden:
        keep = keep & F.element_at(F.split(bare, "/"), -1).startswith(".")
    if exclude_config:
        root = exclude_config.rstrip("/")
        keep = keep & (bare != root) & ~bare.startswith(root + "/")
    return found.filter(keep).select("vault", "shown").distinct()


def suppress_echo(events: DataFrame, base: DataFrame, last_sync: DataFrame, applied: DataFrame) -> DataFrame:
    """Drop local events that only repeat what was just applied from remote.

    A modify is dropped when its hash is the base hash and its mtime the last synced one; a
    delete or rename when ``applied`` (key and op) holds it. ``last_sync`` has a ``last_mtime`` per key.
    """
    key = ["vault", "device", "path"]
    hashes = base.select(*key, F.col("hash").alias("_base"))
    synced = last_sync.select(*key, F.col("last_mtime").alias("_synced"))
    done = applied.select(*key, "op").distinct().withColumn("_done", F.lit(True))
    same = (F.col("content_hash") == F.col("_base")) & (F.col("mtime") == F.col("_synced"))
    echo = F.when(F.col("op").isin("modify", "create"), F.coalesce(same, F.lit(False))).otherwise(
        F.col("op").isin("delete", "rename") & F.col("_done").isNotNull()
    )
    return (
        events.join(hashes, key, "left")
        .join(synced, key, "left")
        .join(done, [*key, "op"], "left")
        .filter(~echo)
        .select(*events.columns)
    )


def log_filter(df: DataFrame, category: str = "all", type_: str = "all", vault: str | None = None) -> DataFrame:
    """Rows of a log view; summaries show only among all or other rows of all types."""
    summary = F.col("category") == "summary"
    show_summary = F.lit(category in ("all", "other") and type_ == "all")
    own = F.lit(True)
    if category != "all":
        own = own & (F.col("category") == category)
    if type_ != "all":
        own = own & (F.col("type") == type_)
    keep = F.when(summary, show_summary).otherwise(own)
    if vault is not None:
        keep = keep & (F.col("vault").isNull() | (F.col("vault") == "") | (F.col("vault") == vault))
    return df.filter(keep)


def message_scope(df: DataFrame, vault: str, context: str | None = None) -> DataFrame:
    """Messages of this vault; with an active context, those of it or without any."""
    other = F.coalesce((F.col("msg_vault") != "") & (F.col("msg_vault") != vault), F.lit(False))
    keep = ~other
    if context:
        keep = keep & ~F.coalesce((F.col("context") != "") & (F.col("context") != context), F.lit(False))
    return df.filter(keep)


def loggable(df: DataFrame) -> DataFrame:
    silent = F.when(F.col("direction") == "receive", F.col("action").isin(SILENT_RECEIVED)).otherwise(
        F.col("action").isin(SILENT_SENT)
    )
    return df.filter(~silent)


def cloud_skip(df: DataFrame, preview: bool, restricted: bool, first_done: bool = True) -> DataFrame:
    """With preview on after the first round, leave out all attachments, or only media types."""
    if not (preview and first_done):
        return df
    skip = F.col("kind") == "file"
    if restricted:
        skip = skip & (media_type(extension(F.col("path"))) != "other")
    return df.filter(~skip)


def redirect_audit(df: DataFrame, allowed: str, out: str = "allowed") -> DataFrame:
    """May ``url`` lead to ``target``: same host, or a host of the list (``*.x`` holds x too).

    The list is a setting, split on newline, comma and semicolon. An invalid URL is refused.
    """
    own = F.lower(F.try_parse_url(F.col("url"), F.lit("HOST")))
    host = F.lower(F.try_parse_url(F.col("target"), F.lit("HOST")))
    patterns = [p.strip().lower() for p in allowed.replace(",", "\n").replace(";", "\n").split("\n") if p.strip()]
    hit = host == own
    for p in patterns:
        hit = hit | (host == p)
        if p.startswith("*."):
            hit = hit | host.endswith(p[1:]) | (host == p[2:])
    return df.withColumn(out, own.isNotNull() & host.isNotNull() & F.coalesce(hit, F.lit(False)))


def error_responses(df: DataFrame) -> DataFrame:
    """Messages that report an error, with ``is_conflict``."""
    return df.filter((F.col("code") <= 0) | (F.col("code") >= 300)).withColumn(
        "is_conflict", F.col("code") == CONFLICT_CODE
    )
