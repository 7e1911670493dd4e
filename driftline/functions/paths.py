"""Path expressions: names, extensions, ancestors, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    """Path with ``\\`` written as ``/``."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def extension(path: Column) -> Column:
    """Lower-case text from the last dot of the whole path, with the dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)\z", 1))


def kind_of(path: Column) -> Column:
    return F.when(path.endswith(".md"), "note").otherwise("file")


def parent_of(path: Column) -> Column:
    """Text before the last slash; empty at the top."""
    return F.regexp_extract(path, r"(?s)\A(.*)/", 1)


def depth_of(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """Folders above a path, from the top: ``a/b/c.md`` gives ``[a, a/b]``."""
    parts = F.split(path, "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def enrich_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Add name, stem, top, ext, kind, parent, depth.

    ``name`` and ``stem`` are empty when the last segment has no dot. ``top`` is the first
    segment, not the parent, and is empty without a slash.
    """
    p = F.col(path)
    base = F.regexp_extract(p, r"([^\\/]*)\z", 1)
    dotted = base.contains(".")
    return df.withColumns(
        {
            "name": F.when(dotted, base).otherwise(""),
            "stem": F.when(dotted, F.regexp_extract(base, r"(?s)\A(.*)\.", 1)).otherwise(""),
            "top": F.when(slashed(p).contains("/"), F.substring_index(p, "/", 1)).otherwise(""),
            "ext": extension(p),
            "kind": kind_of(p),
            "parent": parent_of(p),
            "depth": depth_of(p),
        }
    )


def sanitize_paths(df: DataFrame, path: str = "path", out: str = "clean_path") -> DataFrame:
    """Replace characters that a file name may not have; slashes stay."""
    return df.withColumn(out, F.regexp_replace(slashed(F.col(path)), r'[:*?"<>|]', "-"))
