"""Protocol messages and binary chunk frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Layout of a chunk frame in bytes, and the default chunk size.
SESSION_BYTES = 36
INDEX_BYTES = 4
HEADER_BYTES = SESSION_BYTES + INDEX_BYTES
DEFAULT_CHUNK = 1024 * 1024


def split_messages(raw: DataFrame) -> DataFrame:
    """Add ``action`` (before the first ``|``), ``body`` and ``is_valid`` (the body is JSON)."""
    at = F.instr(F.col("raw"), "|")
    body = F.when(at > 0, F.substring(F.col("raw"), at + 1, F.length("raw"))).otherwise(F.col("raw"))
    action = F.when(at > 0, F.substring(F.col("raw"), F.lit(1), at - 1)).otherwise("")
    return raw.withColumn("action", action).withColumn("body", body).withColumn(
        "is_valid", F.try_parse_json(F.col("body")).isNotNull()
    )


def decode_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable messages (with ``action`` and ``body``), and those whose body is no JSON."""
    split = split_messages(raw)
    return split.filter("is_valid").drop("is_valid"), split.filter("NOT is_valid").drop("is_valid", "body")


def decode_action(messages: DataFrame, action: str, schema: str) -> DataFrame:
    """Typed payload of one action: ``schema`` names the fields of the body."""
    return messages.filter(F.col("action") == action).withColumn("data", F.from_json("body", schema))


def decode_chunks(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Session, index and payload of frames; frames shorter than the header are dropped."""
    f = F.col(frame)
    return frames.filter(F.octet_length(f) >= HEADER_BYTES).select(
        *[c for c in frames.columns if c not in (frame, "session_id", "chunk_index", "payload")],
        F.decode(F.substring(f, 1, SESSION_BYTES), "UTF-8").alias("session_id"),
        F.conv(F.hex(F.substring(f, SESSION_BYTES + 1, INDEX_BYTES)), 16, 10).cast("long").alias("chunk_index"),
        F.substring(f, HEADER_BYTES + 1, (1 << 31) - 1).alias("payload"),
    )


def cut_chunks(files: DataFrame, chunk_size: int = DEFAULT_CHUNK, content: str = "content") -> DataFrame:
    """Chunks of each content: ``chunk_index`` and ``payload``; an empty content gives one empty chunk."""
    size = F.octet_length(F.col(content))
    last = F.greatest(F.ceil(size / F.lit(chunk_size)).cast("int") - 1, F.lit(0))
    pieces = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(F.col(content), i * chunk_size + 1, F.lit(chunk_size))
    )
    kept = [c for c in files.columns if c != content]
    return files.select(*kept, F.posexplode(pieces).alias("_i", "payload")).select(
        *kept, F.col("_i").cast("long").alias("chunk_index"), "payload"
    )


def encode_chunks(files: DataFrame, chunk_size: int = DEFAULT_CHUNK, content: str = "content") -> DataFrame:
    """Frames of each file (``session_id`` and a binary content): session, big-endian index, payload."""
    cut = cut_chunks(files, chunk_size, content)
    index = F.unhex(F.lpad(F.hex("chunk_index"), 2 * INDEX_BYTES, "0"))
    return cut.withColumn("frame", F.concat(F.encode("session_id", "UTF-8"), index, F.col("payload"))).drop(
        "payload", "chunk_index"
    )
