"""Chunked transfers: whole files from chunks, bytes in flight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_lengths(chunks: DataFrame) -> DataFrame:
    """Payload length per (session, index); the payload itself is not shuffled."""
    sized = chunks.select("session_id", "chunk_index", "seq", F.octet_length("payload").cast("long").alias("_len"))
    return sized.groupBy("session_id", "chunk_index").agg(F.max_by("_len", "seq").alias("n_bytes"))


def judged_sessions(chunks: DataFrame, sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions with an ``error`` or null, judged on counts and lengths; no payload moves. Without ``limit`` any size will do."""
    facts = latest_lengths(chunks).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("chunk_index").alias("_top"), F.sum("n_bytes").alias("_bytes")
    )
    checked = sessions.join(facts, "session_id", "left")
    n, total = F.coalesce(F.col("_n"), F.lit(0)), F.col("total_chunks")
    got = F.coalesce(F.col("_bytes"), F.lit(0))
    too_large = F.col("size") > limit if limit is not None else F.lit(False)
    error = (
        F.when(too_large, "too large")
        .when(F.col("_top") >= total, "invalid chunk index")
        .when(n < total, "missing chunk")
        .when(got != F.col("size"), "size mismatch")
    )
    return checked.select(*sessions.columns, error.alias("error"))


def _winners(chunks: DataFrame) -> DataFrame:
    """The last copy of each chunk, by ``seq`` and length."""
    copy = F.struct("seq", F.octet_length("payload").cast("long").alias("n"))
    return chunks.groupBy("session_id", "chunk_index").agg(F.max(copy).alias("_last"))


def ordered_pieces(chunks: DataFrame, sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Content of the sessions without error as rows: ``session_id, chunk_index, offset, payload``.

    For sessions of any size: no cell holds more than one chunk.
    """
    good = judged_sessions(chunks, sessions, limit).filter(F.col("error").isNull()).select("session_id")
    before = Window.partitionBy("session_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        _winners(chunks)
        .join(good, "session_id", "left_semi")
        .select("session_id", "chunk_index", F.col("_last.seq").alias("seq"), F.coalesce(F.sum("_last.n").over(before), F.lit(0)).alias("offset"))
    )
    pieces = chunks.join(places, ["session_id", "chunk_index", "seq"])
    return pieces.select("session_id", "chunk_index", "offset", "payload").dropDuplicates(["session_id", "chunk_index"])


def assemble_files(chunks: DataFrame, sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Content of each session, or an ``error``.

    Sessions are judged on counts and lengths first. The payloads of the good ones then move once, by session, are sorted by
    position and copy, and of each position the last copy is taken in one pass. Each content is one cell; sessions too
    large for that are read by :func:`ordered_pieces`.
    """
    judged = judged_sessions(chunks, sessions, limit)
    good = judged.filter(F.col("error").isNull()).select("session_id")
    copy = F.struct("chunk_index", "seq", F.octet_length("payload").alias("n"), "payload")
    sorted_copies = (
        chunks.join(good, "session_id", "left_semi").groupBy("session_id").agg(F.array_sort(F.collect_list(copy)).alias("_all"))
    )
    ends = F.filter("_all", lambda x, i: (i == F.size("_all") - 1) | (F.get("_all", i + 1)["chunk_index"] != x["chunk_index"]))
    whole = sorted_copies.select("session_id", ends.alias("_parts")).select("session_id", joined_bytes("_parts").alias("content"))
    return judged.join(whole, "session_id", "left")


def joined_bytes(parts: str):
    """Payloads of an ordered array as one binary, in one pass over the bytes."""
    texts = F.transform(F.col(parts), lambda p: F.decode(p["payload"], "ISO-8859-1"))
    return F.encode(F.array_join(texts, ""), "ISO-8859-1")


def in_flight_bytes(chunks: DataFrame, open_sessions: DataFrame) -> DataFrame:
    """Bytes held per open session."""
    held = latest_lengths(chunks).groupBy("session_id").agg(F.sum("n_bytes").alias("held_bytes"))
    return held.join(open_sessions.select("session_id"), "session_id", "left_semi")
