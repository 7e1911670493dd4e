"""Listings of a vault: files on storage, key-value items, pages of a server table."""

from __future__ import annotations

import os
from collections.abc import Sequence
from itertools import islice
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.fingerprint import string_fingerprint
from driftline.functions.paths import kind_of
from driftline.operators.rules import VIRTUAL_PREFIX
from driftline.operators.timeline import By, page_of
from driftline.session import is_local, materialise


LISTED = "path string, is_folder boolean, mtime long, size long"
#: names given on by a listing task at a time, and files whose facts one task reads
NAMES, FACTS = 10_000, 20_000


def _place(folder: str):
    """File system and path of a folder. A plain path or ``file:`` is a mounted one."""
    from pyarrow import fs

    url = urlparse(folder)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(url.path)
    return fs.FileSystem.from_uri(folder)


def _facts(info) -> tuple[int | None, int | None]:
    return None if info.mtime_ns is None else info.mtime_ns // 1_000_000, info.size


def _names(fs, folder: str, base: str):
    """Entries of one folder: path below ``base``, is it a folder, and mtime and size where the listing tells them.

    A mounted folder is read name by name, so it is never held whole; links to folders are files without facts. A
    folder that is gone has no entries.
    """
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                for e in found:
                    yield e.path[len(base) :].lstrip("/"), e.is_dir(follow_symlinks=False), None, None
        except FileNotFoundError:
            return
    else:
        for i in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            is_folder = i.type == pafs.FileType.Directory
            yield i.path[len(base) :].lstrip("/"), is_folder, *((None, None) if is_folder else _facts(i))


def _batches(rows):
    types = [pa.string(), pa.bool_(), pa.int64(), pa.int64()]
    while some := list(islice(rows, NAMES)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], ["path", "is_folder", "mtime", "size"])


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Everything below ``root``, level by level: ``path``, ``is_folder``, ``mtime`` and ``size`` (both null for folders).

    Each round the tasks list the folders that the last one found, one level deep, and their rows are written down; the driver
    sees one number per level. The facts of the files of a mounted folder are read in a second step by path, so the files
    of one big folder go to many tasks.
    """
    root = root.rstrip("/")
    _, base = _place(root)

    def below(batches):
        fs, base = _place(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                yield from _batches(_names(fs, f"{base}/{folder}".rstrip("/"), base))

    def with_facts(batches):
        fs, base = _place(root)
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = [_facts(i) for i in fs.get_file_info([f"{base}/{p}" for p in paths])]
            yield from _batches((p, False, *f) for p, f in zip(paths, found))

    folders = spark.createDataFrame([("",)], "path string")
    n, found = 1, None
    while n:
        level = materialise(folders.repartition(min(n, 10_000), "path").mapInArrow(below, LISTED))
        found = level if found is None else found.unionByName(level)
        folders = level.filter("is_folder").select("path")
        n = folders.count()
    bare = found.filter("NOT is_folder AND mtime IS NULL")
    parts = bare.count() // FACTS + 1
    told = found.filter("is_folder OR mtime IS NOT NULL")
    return told.unionByName(bare.select("path").repartition(max(parts, 1), "path").mapInArrow(with_facts, LISTED))


def inventory_entries(inventory: DataFrame) -> DataFrame:
    """The same rows from a table of all files (``path, mtime, size``), as object stores write them: nothing is listed.

    Folders are those that hold a file; an inventory knows no empty ones.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    folders = inventory.filter(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct()
    none = F.lit(None).cast("long")
    files = inventory.select("path", F.lit(False).alias("is_folder"), F.col("mtime").cast("long"), F.col("size").cast("long"))
    return files.unionByName(folders.select("path", F.lit(True).alias("is_folder"), none.alias("mtime"), none.alias("size")))


def vault_scan(
    spark: SparkSession, root: str, vault: str, device: str, hidden: Sequence[str] = (), inventory: DataFrame | None = None
) -> DataFrame:
    """Files and folders below ``root``: path, kind, size, mtime. The root itself is no row.

    Every name counts, also those that begin with a dot or an underscore, and so do empty folders. Files below a
    folder named in ``hidden`` are of kind ``config``. With an ``inventory`` of the files nothing is listed. On a
    cluster a root needs a scheme: ``file:`` says that the folder is mounted on every machine.
    """
    if inventory is None and not urlparse(root).scheme and not is_local(spark):
        raise ValueError("a root without a scheme is a folder of this machine; name its file system")
    listed = entries(spark, root) if inventory is None else inventory_entries(inventory)
    config = F.lit(False)
    for h in hidden:
        config = config | F.col("path").startswith(h.rstrip("/") + "/")
    kind = F.when(F.col("is_folder"), "folder").when(config, "config").otherwise(kind_of(F.col("path")))
    return listed.select(
        F.lit(vault).alias("vault"), F.lit(device).alias("device"), kind.alias("kind"),
        "path", string_fingerprint(F.col("path")).alias("path_hash"), "mtime", "size",
    )


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def virtual_entries(kv: DataFrame, now: int) -> DataFrame:
    """Key-value items (``vault``, ``device``, ``key``, ``value``, ``mtime``) as config rows of a manifest.

    An item without a kept mtime gets ``now``. Items without a value are left out.
    """
    path = F.concat(F.lit(VIRTUAL_PREFIX), F.col("key"))
    mtime = F.coalesce(F.when(F.col("mtime") != 0, F.col("mtime")), F.lit(now))
    return kv.filter(F.col("value").isNotNull()).select(
        "vault",
        "device",
        F.lit("config").alias("kind"),
        path.alias("path"),
        string_fingerprint(path).alias("path_hash"),
        string_fingerprint(F.col("value")).alias("content_hash"),
        mtime.alias("mtime"),
        mtime.alias("ctime"),
        utf16_length(F.col("value")).alias("size"),
    )


def list_entries(
    state: DataFrame, kind: str, page: int, page_size: int, recycled: bool = False, keyword: str = ""
) -> DataFrame:
    """One page of notes or files by path, with the number of rows and pages of the whole list."""
    hits = state.filter((F.col("kind") == kind) & (F.col("is_deleted") == F.lit(recycled)))
    if keyword:
        hits = hits.filter(F.lower("path").contains(keyword.lower()))
    total = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = page_of(hits, [By(F.col("vault")), By(F.col("path"))], page, page_size)
    return rows.withColumn("total_rows", total).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / page_size)).cast("long")
    )
