"""The rolling 31-hash of paths, texts and bytes, all inside the JVM.

``h = 31*h + unit`` in 32-bit arithmetic is the hash code of a Java string. Bytes are
hashed the same way after reading each byte as one ISO-8859-1 character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values of the wire format: whole content up to this size, else head and tail slices
FULL_HASH_LIMIT = 10 * 1024 * 1024
SLICE_SIZE = 5 * 1024 * 1024


def string_fingerprint(text: Column) -> Column:
    return F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), text)


def sampled_bytes(content: Column) -> Column:
    """Content as hashed on the wire: all of it, or the first and last slice of a large file."""
    head = F.substring(content, 1, SLICE_SIZE)
    tail = F.substring(content, -SLICE_SIZE, SLICE_SIZE)
    return F.when(F.octet_length(content) <= FULL_HASH_LIMIT, content).otherwise(F.concat(head, tail))


def bytes_fingerprint(content: Column) -> Column:
    """Hash of the whole content, whatever its size: an edit anywhere changes it."""
    return string_fingerprint(F.decode(content, "ISO-8859-1"))


def wire_fingerprint(content: Column) -> Column:
    """The hash that the wire format carries. An edit in the middle of a large file does not show in it, so nothing is decided by it."""
    return bytes_fingerprint(sampled_bytes(content))


def fingerprint_paths(df: DataFrame, path: str = "path", out: str = "path_hash") -> DataFrame:
    return df.withColumn(out, F.when(F.col(path).isNotNull(), string_fingerprint(F.col(path))))


def fingerprint_text(df: DataFrame, text: str = "text", out: str = "content_hash") -> DataFrame:
    return df.withColumn(out, F.when(F.col(text).isNotNull(), string_fingerprint(F.col(text))))


def fingerprint_binary(df: DataFrame, content: str = "content", out: str = "content_hash") -> DataFrame:
    """Add the hash of the whole content as ``out``."""
    return df.withColumn(out, F.when(F.col(content).isNotNull(), bytes_fingerprint(F.col(content))))
