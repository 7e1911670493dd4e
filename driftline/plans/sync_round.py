"""A whole round as one plan: exclude, reuse or compute hashes, compare, decide, commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.fingerprint import string_fingerprint
from driftline.operators.aggregates import task_counts
from driftline.operators.compare import attach_base, detect_deleted, detect_folder_changes, detect_missing, reuse_hashes
from driftline.operators.filters import config_scan, incremental_since, size_guard
from driftline.operators.reconcile import per_device, reconcile
from driftline.operators.rules import RuleBook, custom_dirs, exclude_config, exclude_paths, in_config_scope
from driftline.operators.state import commit_round
from driftline.schema import STATE_KEY


@dataclass(frozen=True)
class ConfigScope:
    """The folder of config files, further ones (a setting), and the rules for them."""

    folder: str
    custom: str = ""
    book: RuleBook = RuleBook()

    def holds(self) -> Column:
        return in_config_scope(F.col("path"), self.folder, custom_dirs(self.custom))


@dataclass(frozen=True)
class Round:
    manifest: DataFrame
    deleted: DataFrame
    decisions: DataFrame
    counts: DataFrame
    state: DataFrame
    #: rows too large to be synced, with a ``reason``
    oversized: DataFrame
    #: tracked paths that are gone and not reported as deleted (an incremental round with offline delete off)
    missing: DataFrame
    #: tracked folders that are gone, with the ``change`` reported; null without a folder state
    folders: DataFrame | None


def hash_listing(listing: DataFrame, content: DataFrame, base: DataFrame) -> DataFrame:
    """Listing with content hashes: kept ones where mtime and size agree, computed ones elsewhere.

    Texts are read for the rows that need a hash only.
    """
    cached = reuse_hashes(listing.drop("content_hash"), base)
    todo = cached.filter("needs_hash").select(*STATE_KEY)
    fresh = content.join(todo, STATE_KEY, "left_semi").select(*STATE_KEY, string_fingerprint(F.col("text")).alias("_fresh"))
    joined = cached.join(fresh, STATE_KEY, "left")
    return joined.withColumn("content_hash", F.coalesce("cached_hash", "_fresh")).drop("_fresh", "cached_hash")


def run(
    listing: DataFrame,
    content: DataFrame,
    base: DataFrame,
    server: DataFrame,
    book: RuleBook,
    strategy: str = "",
    offline_delete: bool = False,
    watermarks: DataFrame | None = None,
    pending: DataFrame | None = None,
    incremental: bool = False,
    folder_state: DataFrame | None = None,
    config: ConfigScope | None = None,
) -> Round:
    """Tables of one round for all devices of a listing. Nothing runs until one of them is used.

    An ``incremental`` round (with ``watermarks``) sends only rows that ``incremental_since`` keeps; what is absent is found on the full
    listing all the same. ``folder_state`` are the folders known so far; the listing's rows of kind ``folder`` are those that are
    there. With a ``config`` scope its files go by its own rules, as kind ``config``; others of that kind are left out.

    With ``watermarks`` a device sees the server's rows as its round asks for them (see ``per_device``). Server rows
    under an exclude rule are left alone. ``pending`` (the key, ``hash, mtime, size``) is put into the state at the end.
    """
    files = listing.filter(F.col("kind") != "folder")
    own = files.filter("kind <> 'config'")
    allowed = exclude_paths(own, book)
    if config is not None:
        settings = config_scan(files.filter("kind = 'config'"), config.folder, config.custom, config.book)
        allowed = allowed.unionByName(exclude_config(settings, config.book))
        base_own, base_config = base.filter(~config.holds()), base.filter(config.holds())
    else:
        allowed = exclude_paths(files, book)
        own, base_own, base_config = files, base, None
    kept, large = size_guard(allowed)
    nothing = base.limit(0)
    if incremental and watermarks is not None:
        asked = incremental_since(kept, base, nothing if pending is None else pending, watermarks)
    else:
        asked = kept
    hashed = hash_listing(asked, content, base)
    manifest = attach_base(hashed.withColumn("path_hash", string_fingerprint(F.col("path"))), base)

    def absent(find, **how) -> DataFrame:
        rows = find(base_own, own, book, offline_delete, **how)
        if base_config is None:
            return rows
        return rows.unionByName(find(base_config, files.filter("kind = 'config'"), config.book, offline_delete, config=True, **how))

    deleted = absent(detect_deleted)
    missing = absent(detect_missing, incremental=incremental)
    folders = None
    if folder_state is not None:
        there = listing.filter("kind = 'folder'").select(*STATE_KEY)
        folders = detect_folder_changes(folder_state, there, book, offline_delete, incremental)
    devices = listing.select("vault", "device").unionByName(base.select("vault", "device"))
    known = deleted.select(*STATE_KEY).unionByName(missing.select(*STATE_KEY)) if incremental else base.select(*STATE_KEY)
    present = hashed.select(*STATE_KEY).unionByName(known)  # what the round names to the server
    server_kept = exclude_paths(server, book) if config is None else exclude_paths(server.filter("kind <> 'config'"), book).unionByName(
        exclude_config(server.filter("kind = 'config'"), config.book)
    )
    wanted = per_device(server_kept, devices, watermarks, present)
    decisions = reconcile(hashed, base, wanted, strategy, deleted)
    scanned = hashed.filter("needs_hash").select(*STATE_KEY, F.col("content_hash").alias("hash"), "mtime", "size")
    waiting = scanned.limit(0) if pending is None else pending.select(*scanned.columns)
    state = commit_round(base, waiting, scanned, deleted)
    oversized = large.withColumn("reason", F.concat("kind", F.lit(" too large")))
    return Round(manifest, deleted, decisions, task_counts(decisions), state, oversized, missing, folders)
