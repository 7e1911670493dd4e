"""Comparisons of a listing with the last acknowledged state, the server and other tables.

Joins use the whole key (vault, device, path) or (vault, path), never the vault alone, so one
large vault is spread over all tasks. Which join Spark runs is left to it: tables below its
measured broadcast threshold are broadcast, all others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.fingerprint import string_fingerprint
from driftline.functions.paths import ancestors, kind_of
from driftline.operators.rules import RuleBook, is_config_excluded, is_excluded
from driftline.operators.skew import join_facts
from driftline.schema import ITEM_KEY, STATE_KEY


def reuse_hashes(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Add ``cached_hash`` (valid only when mtime and size are both the kept ones) and ``needs_hash``."""
    kept = state.select(*STATE_KEY, "mtime", "size", F.col("hash").alias("cached_hash"))
    joined = listing.join(kept, [*STATE_KEY, "mtime", "size"], "left")
    return joined.select(*listing.columns, "cached_hash", F.col("cached_hash").isNull().alias("needs_hash"))


def attach_base(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Add the last acknowledged hash, or mark it missing."""
    base = state.select(*STATE_KEY, F.col("hash").alias("base_hash"))
    joined = listing.join(base, STATE_KEY, "left")
    return joined.select(*listing.columns, "base_hash", F.col("base_hash").isNull().alias("base_missing"))


def _absent(state: DataFrame, listing: DataFrame, drop: Column) -> DataFrame:
    tracked = state.select(*STATE_KEY).filter(~drop)
    return tracked.join(listing.select(*STATE_KEY), STATE_KEY, "left_anti")


def _keyed(df: DataFrame, kind: Column) -> DataFrame:
    return df.select("vault", "device", kind.alias("kind"), "path", string_fingerprint(F.col("path")).alias("path_hash"))


def absent_paths(state: DataFrame, listing: DataFrame, book: RuleBook, config: bool = False) -> DataFrame:
    """Tracked paths that no rule excludes and that the *full* listing lacks."""
    drop = is_config_excluded(F.col("path"), book) if config else is_excluded(F.col("path"), book)
    kind = F.lit("config") if config else kind_of(F.col("path"))
    return _keyed(_absent(state, listing, drop), kind)


def detect_deleted(
    state: DataFrame, listing: DataFrame, book: RuleBook, offline_delete: bool = True, config: bool = False
) -> DataFrame:
    """Absent paths to delete on the server; none while offline delete is off."""
    rows = absent_paths(state, listing, book, config)
    return rows if offline_delete else rows.limit(0)


def detect_missing(
    state: DataFrame,
    listing: DataFrame,
    book: RuleBook,
    offline_delete: bool = False,
    incremental: bool = True,
    config: bool = False,
) -> DataFrame:
    """Absent paths to report as missing: only in an incremental round with offline delete off."""
    rows = absent_paths(state, listing, book, config)
    return rows if incremental and not offline_delete else rows.limit(0)


def detect_folder_changes(
    folder_state: DataFrame, folders: DataFrame, book: RuleBook, offline_delete: bool, incremental: bool
) -> DataFrame:
    """Tracked folders that are gone, as ``deleted`` or ``missing``."""
    gone = _keyed(_absent(folder_state, folders, is_excluded(F.col("path"), book)), F.lit("folder"))
    if not offline_delete and not incremental:
        gone = gone.limit(0)
    return gone.withColumn("change", F.lit("deleted" if offline_delete else "missing"))


def recover_pending(pending: DataFrame, listing: DataFrame) -> DataFrame:
    """Pending rows to keep after a restart: those whose path exists; config rows always."""
    config = pending.filter(F.col("kind") == "config")
    rest = pending.filter(F.col("kind") != "config")
    return rest.join(listing.select(*STATE_KEY), STATE_KEY, "left_semi").unionByName(config)


def case_conflicts(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming paths that differ from a local path only in letter case.

    One local path is named per incoming one. Local spellings are folded to their smallest and
    largest first, so many copies of one spelling never meet many incoming rows.
    """
    lower = F.lower("path")
    spellings = local.groupBy("vault", lower.alias("_low")).agg(
        F.min("path").alias("_first"), F.max("path").alias("_last")
    )
    wanted = incoming.select("vault", F.col("path").alias("expected_path"), lower.alias("_low")).distinct()
    actual = F.when(F.col("_first") != F.col("expected_path"), F.col("_first")).when(
        F.col("_last") != F.col("expected_path"), F.col("_last")
    )
    return (
        wanted.join(spellings, ["vault", "_low"])
        .withColumn("actual_path", actual)
        .filter(F.col("actual_path").isNotNull())
        .select("vault", "expected_path", "actual_path")
    )


def missing_on_server(listing: DataFrame, server: DataFrame, book: RuleBook) -> DataFrame:
    """Attachments that no rule excludes and that the server has no live row for."""
    path = F.col("path")
    files = listing.filter(~path.endswith(".md") & ~is_excluded(path, book))
    live = server.filter(~F.col("is_deleted")).select(*ITEM_KEY)
    return files.join(live, ITEM_KEY, "left_anti")


def verified_removable(listing: DataFrame, server: DataFrame) -> DataFrame:
    """Local copies that the server holds with equal path, size and mtime."""
    live = server.filter(~F.col("is_deleted")).select(*ITEM_KEY, "size", "mtime")
    return listing.join(live, [*ITEM_KEY, "size", "mtime"], "left_semi")


def embeds(notes: DataFrame) -> DataFrame:
    """Embedded links ``![[target#sub]]`` of note texts, one row each in text order."""
    links = F.regexp_extract_all(F.col("text"), F.lit(r"!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)
    flat = notes.select("vault", F.col("path").alias("note_path"), F.posexplode(links).alias("ord", "link"))
    target = F.substring_index("link", "#", 1)
    return flat.select(
        "vault",
        "note_path",
        F.col("ord").cast("long").alias("ord"),
        target.alias("path"),
        F.substring(F.col("link"), F.length(target) + 1, F.length("link")).alias("subpath"),
    )


def unresolved_embeds(notes: DataFrame, listing: DataFrame) -> DataFrame:
    """Embeds whose target is not in the listing of the vault."""
    return embeds(notes).join(listing.select(*ITEM_KEY), ITEM_KEY, "left_anti")


def shared_tree(listing: DataFrame, shared: DataFrame) -> DataFrame:
    """Add ``is_shared``: the path is shared, or is a folder above a shared path."""
    above = shared.select("vault", F.explode(ancestors(F.col("path"))).alias("path"))
    marked = shared.select("vault", "path").unionByName(above).distinct().withColumn("_marked", F.lit(True))
    return listing.join(marked, ITEM_KEY, "left").select(*listing.columns, F.col("_marked").isNotNull().alias("is_shared"))


def below(paths: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and paths of ``paths`` that equal, or lie under, a path of ``roots``.

    Each path meets the roots by its ancestors, as an equi join. A root that holds a large part of
    all paths is split by a salt of the path; the roots are repeated once per salt.
    """
    chain = F.array_append(ancestors(F.col("path")), F.col("path"))
    climbs = paths.select(*keys, "path", F.explode(chain).alias("_root"))
    tops = roots.select(*keys, F.col("path").alias("_root")).distinct()
    hits = join_facts(climbs, tops, [*keys, "_root"], ["path"], "left_semi")
    return hits.select(*keys, "path").distinct()


def cascade_delete(state: DataFrame, removed: DataFrame) -> DataFrame:
    """State without the removed paths and all that lay under them."""
    return state.join(below(state, removed, ["vault", "device"]), STATE_KEY, "left_anti")


def changed_fingerprints(source: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entries whose md5 differs from the dictionary, or is not in it."""
    known = dictionary.select("key", F.col("md5").alias("_known"))
    fresh = source.withColumn("md5", F.md5("text"))
    return fresh.join(known, "key", "left").filter(~F.col("md5").eqNullSafe(F.col("_known"))).drop("_known")


def commit_scanned(state: DataFrame, scanned: DataFrame) -> DataFrame:
    """State with scanned rows put in where there is no row or an older (or equally old) one."""
    fields = ["hash", "mtime", "size"]
    new = scanned.select(*STATE_KEY, F.struct(*fields).alias("_new"))
    old = state.select(*STATE_KEY, F.struct(*fields).alias("_old"))
    use_new = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col("_old.mtime") <= F.col("_new.mtime")))
    chosen = F.when(use_new, F.col("_new")).otherwise(F.col("_old"))
    return (
        old.join(new, STATE_KEY, "full_outer").withColumn("_row", chosen).select(*STATE_KEY, *[f"_row.{f}" for f in fields])
    )


def rename_outcome(events: DataFrame, listing: DataFrame) -> DataFrame:
    """What a rename from remote leads to: ``rename`` when the old path is here; ``skip`` when the new
    path already has the content (attachments: and the size, when given); else ``repush``."""
    here = listing.select(*STATE_KEY)
    old = here.withColumnRenamed("path", "old_path").distinct().withColumn("_old", F.lit(True))
    new = listing.select(*STATE_KEY, F.col("content_hash").alias("_hash"), F.col("size").alias("_size"))
    sized = F.col("path").endswith(".md") | F.col("size").isNull() | (F.col("_size") == F.col("size"))
    same = F.coalesce((F.col("_hash") == F.col("content_hash")) & sized, F.lit(False))
    outcome = F.when(F.col("_old").isNotNull(), "rename").when(same, "skip").otherwise("repush")
    return (
        events.join(old, ["vault", "device", "old_path"], "left")
        .join(new, STATE_KEY, "left")
        .select(*events.columns, outcome.alias("outcome"))
    )


def restore_entries(state: DataFrame, selected: DataFrame, action: str) -> DataFrame:
    """The server table after items of the bin were restored or purged.

    Only rows in the bin are touched. A purge needs the path hash and skips selected rows without it.
    """
    if action not in ("restore", "purge"):
        raise ValueError("action is restore or purge")
    picked = selected.filter(F.col("path_hash").isNotNull() & (F.col("path_hash") != "")) if action == "purge" else selected
    marks = picked.select(*ITEM_KEY).distinct().withColumn("_picked", F.lit(True))
    joined = state.join(marks, ITEM_KEY, "left")
    hit = F.col("is_deleted") & F.col("_picked").isNotNull()
    if action == "purge":
        return joined.filter(~hit).select(*state.columns)
    return joined.withColumn("is_deleted", F.col("is_deleted") & ~hit).select(*state.columns)
