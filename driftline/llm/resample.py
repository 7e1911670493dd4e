"""Resampling of documents towards a target distribution by hashed n-gram weights (operator 13).

Each run of one or two words is a feature; its bucket is a CRC-32 modulo the number of buckets. The CRC of a
span is affine in its bytes: every byte contributes a number that depends only on its value and its distance from the
span's end, and the length adds a constant. So the contributions come from one table, and all features of many
texts are hashed at once by ``bitwise_xor.reduceat`` over their spans. Spans longer than the table are cut in blocks from
their end, which are folded pairwise with shift tables.

A document's weight is the mean of the log ratios of its buckets between target and documents; adding Gumbel noise that
is fixed by the id and taking the highest scores draws without replacement in proportion to the weights.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import short_batches, slices, stored, text_bytes
from driftline.operators.timeline import global_rank

#: generator of CRC-32, bits reversed (fixed value)
POLYNOMIAL = 0xEDB88320
#: distances from a span's end that the table covers; longer spans are cut in blocks of as many bytes
REACH = 64
#: bytes of text, and of spans, taken at a time
PIECE = 1 << 20
ONES = np.uint32(0xFFFFFFFF)


@cache
def _bytes_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ (np.uint32(POLYNOMIAL) * (table & 1))
    return table


def _past_zero(crc: np.ndarray) -> np.ndarray:
    """States after one zero byte more."""
    return _bytes_table()[crc & 255] ^ (crc >> 8)


@cache
def positions() -> np.ndarray:
    """Contribution of a byte at each distance from the end, at ``256 * distance + byte``."""
    rows = [_bytes_table()]
    while len(rows) < REACH:
        rows.append(_past_zero(rows[-1]))
    return np.concatenate(rows)


@cache
def _shift_table(power: int) -> np.ndarray:
    """What a state becomes past ``2 ** power`` zero bytes: one row for each of its four bytes."""
    if power == 0:
        return np.stack([_past_zero(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])
    half = _shift_table(power - 1)
    return _shifted(half, half.ravel()).reshape(4, 256)


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes, which is the part of a CRC that depends on the length alone."""
    state = np.full(len(lengths), ONES)
    power, left = 0, lengths.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        state[odd] = _shifted(_shift_table(power), state[odd])
        left >>= 1
        power += 1
    return state ^ ONES


def _long_span(span: np.ndarray) -> np.uint32:
    """Contribution of all bytes of one span, whatever its length."""
    blocks = -(-len(span) // REACH)
    span = np.concatenate([np.zeros(blocks * REACH - len(span), dtype=np.uint8), span])  # zero bytes in front contribute nothing
    far = np.arange(REACH - 1, -1, -1, dtype=np.int32) << 8
    parts = []
    for at in range(0, blocks, PIECE // REACH):
        part = span[at * REACH : (at + PIECE // REACH) * REACH].reshape(-1, REACH)
        parts.append(np.bitwise_xor.reduceat(positions()[(far + part).ravel()], np.arange(0, part.size, REACH)))
    folded, power = np.concatenate(parts), REACH.bit_length() - 1
    while len(folded) > 1:
        if len(folded) % 2:
            folded = np.concatenate([folded[:1] & 0, folded])
        folded = _shifted(_shift_table(power), folded[0::2]) ^ folded[1::2]
        power += 1
    return folded[0]


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for many spans, none of them empty."""
    lengths = ends - starts
    out = np.empty(len(starts), dtype=np.uint32)
    long = lengths > REACH
    for i in np.flatnonzero(long):
        out[i] = _long_span(data[starts[i] : ends[i]])
    short = np.flatnonzero(~long)
    upto = np.cumsum(lengths[short])
    cuts = np.searchsorted(upto, np.arange(PIECE, upto[-1] if len(upto) else 0, PIECE), side="right")
    for some in np.split(short, cuts):
        if len(some):
            size = lengths[some]
            first = np.cumsum(size) - size
            at = np.arange(first[-1] + size[-1], dtype=np.int32)
            byte = data[at + np.repeat((starts[some] - first).astype(np.int32), size)]
            far = np.repeat((first + size - 1).astype(np.int32), size) - at
            out[some] = np.bitwise_xor.reduceat(positions()[(far << 8) | byte], first)
    constants = length_constants(np.arange(REACH + 1))
    out[short] ^= constants[lengths[short]]
    out[long] ^= length_constants(lengths[long])
    return out


@cache
def _word_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether it belongs to a word (digits, letters, all above ASCII), and itself with A-Z lower-cased."""
    b = np.arange(256)
    upper = (b >= 65) & (b <= 90)
    word = (b >= 128) | (b >= 48) & (b <= 57) | (b >= 97) & (b <= 122) | upper
    return word, np.where(upper, b + 32, b).astype(np.uint8)


def _features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every feature, and words per text."""
    is_word, lower = _word_bytes()
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    word = is_word[data]
    after = np.concatenate([[False], word[:-1]])
    text_ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    words_upto = np.searchsorted(np.flatnonzero(after & ~word), text_ends)
    count = np.diff(words_upto, prepend=0)
    text = np.repeat(np.arange(len(texts)), count)
    kept = word | after  # the words, one byte behind each
    spaced = np.where(word, lower[data], np.uint8(32))[kept]
    ends = np.flatnonzero(~word[kept])
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    pair = np.flatnonzero(text[1:] == text[:-1])
    crcs = span_crcs(spaced, np.concatenate([starts, starts[pair]]), np.concatenate([ends, ends[pair + 1]]))
    return np.concatenate([text, text[pair]]), (crcs % np.uint32(buckets)).astype(np.int64), count


def _few(batches, col: int):
    """Row numbers and texts of about ``PIECE`` bytes at a time, or one text that is longer."""
    for batch in batches:
        sizes = np.cumsum(np.fromiter((len(t.as_buffer()) for t in batch.column(col)), dtype=np.int64, count=batch.num_rows))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, done + PIECE, side="right")))
            yield batch.slice(at, upto - at), batch.column(col).slice(at, upto - at).to_pylist()
            at = upto


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """``bucket`` and ``n``, the number of features of all texts in it; buckets without any have no row."""

    def work(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for _, some in _few(slices(batches), 0):
            total += np.bincount(_features(some, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    short_batches(texts.sparkSession)
    return texts.select(text_bytes()).mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Per bucket the log ratio of its smoothed shares in ``target`` and ``docs``, in thousandths, rounded down."""
    seen = np.zeros((2, buckets))
    for row, texts in zip(seen, (docs, target)):
        for r in bucket_counts(texts, buckets).collect():  # one row a bucket
            row[r.bucket] = r.n
    (all_docs, all_target), (s, t) = seen.sum(axis=1), seen
    return np.floor(1000 * np.log((t + 1) * (all_docs + buckets) / ((s + 1) * (all_target + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the floored mean gain of a text's features (none: 0)."""

    def work(batches):
        for batch, some in _few(slices(batches), 1):
            text, bucket, words = _features(some, len(gain))
            n = np.bincount(text, minlength=len(some))
            total = np.zeros(len(some), dtype=np.int64)
            np.add.at(total, text, gain[bucket])
            columns = [batch.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    short_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_features long, weight long"
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(work, schema)


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by the seed and the id; a null id counts as the word null."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    Of the rows with ``least_words`` words or more, ``percent`` of a hundred are drawn, by score, then smaller id, null
    last; ``rank`` is the place in that order, and null where a row is not drawn. Counts, weights and ranks cover all rows
    and whole texts. Null and empty texts have no features, weight 0, and are never drawn unless ``least_words`` is 0.
    Rows are told apart by nothing but these columns, so of equal rows any may have the better rank. An empty
    table gives no rows; an empty target leaves the smoothed shares of ``docs`` alone to decide.
    """
    rows = stored(weighted(docs, gains(docs, target, buckets)), "weights")
    rows = rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"))
    fit = F.col("n_words") >= least_words
    drawn = percent * rows.where(fit).count() // 100
    ranked = global_rank(rows.where(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")


def keep_drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """All columns of the rows of ``docs`` whose id is drawn, copies of a row included."""
    ids = resampled(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, docs.doc_id.cast("long").eqNullSafe(ids["__id"]), "left_semi")
