"""Chunked transfers from frames to state rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.fingerprint import bytes_fingerprint
from driftline.operators.chunks import assemble_files
from driftline.operators.compare import commit_scanned
from driftline.sources.wire import decode_chunks


def received_files(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files of all sessions with their hash, or an error. ``frames`` has ``frame`` and ``seq``."""
    files = assemble_files(decode_chunks(frames), sessions)
    return files.withColumn("hash", F.when(F.col("error").isNull(), bytes_fingerprint(F.col("content"))))


def commit(state: DataFrame, files: DataFrame) -> DataFrame:
    """State after received files; ``files`` has the key, ``hash``, ``mtime`` and ``size``."""
    good = files.filter(F.col("error").isNull()).select("vault", "device", "path", "hash", "mtime", "size")
    return commit_scanned(state, good)
