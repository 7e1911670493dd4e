"""Token ids as flat binary files (operator 2).

One folder holds, for each partition of the documents in ascending order of ``doc_id``,

- ``part-N.bin``: the ids of its documents one after another, unsigned integers of 16 bits if
  the vocabulary has at most 65,536 ids, else of 32 bits, little-endian;
- ``part-N.off``: 64-bit offsets into it in ids, one more than there are documents;
- ``part-N.doc``: the documents' ids as 64-bit integers, the least one standing for null.

The manifest (a Parquet table) has one row per partition with the documents and tokens before it, which
are prefix sums of the partitions' counts: a document's place in the whole corpus is its
partition's base plus its offset. Readers map the files into memory where they are local and read
ranges of them elsewhere.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib
from array import array
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.bpe import CACHE_CHARS, SAFE_BLANK, byte_alphabet
from driftline.llm.common import KEPT, parts_of, short_batches, slices
from driftline.session import scratch_path

#: pieces of text whose ids a worker keeps; when they are more they are forgotten
CACHE_PIECES = 1_500_000
#: new pieces that are encoded as one text
TOGETHER = 1000
NO_ID = -(1 << 63)
PARTS = "part int, n_docs long, n_tokens long, bytes_per_id int"


class LibraryEncoder:
    """Ids by the tokenizers library; each distinct piece between safe blanks is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        alphabet = byte_alphabet()
        specials = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)  # bytes of each token
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token.encode()) if token in specials or not alphabet.keys() >= set(token) else len(token)
        self.kept: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        out = array("H" if self.type.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def fresh(self, units: list[str]) -> dict[str, bytes]:
        """Ids of pieces that each begin with a safe blank. So many of them together are one text whose
        tokens part where the pieces do, and the library is called once for all."""
        out = {}
        for at in range(0, len(units), TOGETHER):
            some = units[at : at + TOGETHER]
            ids = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids
            ends = np.cumsum(self.sizes[ids])
            last = np.searchsorted(ends, np.cumsum([len(u.encode()) for u in some])) + 1
            packed, start = self.packed(ids), 0
            for u, end in zip(some, (last * self.type.itemsize).tolist()):
                out[u] = packed[start:end]
                start = end
        return out

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        cut, new, firsts = [], set(), set()
        for text in texts:
            first, *more = SAFE_BLANK.split(text)
            units = list(map(" ".__add__, more))
            new.update(units)
            firsts.add(first)
            cut.append([first, *units])
        new = {u for u in new if u not in self.kept}
        firsts = {u for u in firsts if u not in self.kept and u not in new}
        if len(self.kept) + len(new) + len(firsts) > CACHE_PIECES:
            here = {u for units in cut for u in units}
            self.kept = {u: self.kept[u] for u in here & self.kept.keys()}  # what these texts need stays
        self.kept.update(self.fresh(list(new)))
        alone = list(firsts)
        found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        self.kept.update((u, self.packed(e.ids)) for u, e in zip(alone, found))
        end = self.packed([end_id])
        of = self.kept.__getitem__
        out = [b"".join([*map(of, u), end]) for u in cut]
        for u in [*new, *alone]:
            if len(u) > CACHE_CHARS:
                del self.kept[u]
        return out


@lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


KEPT["library"] = library.cache_clear


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; a plain path or ``file:`` is the shared folder as mounted."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(url.path)
    return pafs.FileSystem.from_uri(folder)


def put(fs: pafs.FileSystem, path: str, data) -> None:
    """A file appears whole or not at all; two attempts of a task write the same bytes."""
    draft = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        for x in data:
            f.write(x)
    fs.move(draft, path)


def write_tokens(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Write the files of all documents and give the manifest.

    Rows are ordered by ``doc_id``, nulls first, equal ones by their text. Only ``doc_id`` and ``text`` are
    read; a null text is an empty document (the end id alone). A task holds one block of
    texts and the ids of one partition's offsets, not its tokens.
    """
    spark = docs.sparkSession
    fs, root = place(folder)
    fs.create_dir(root, recursive=True)

    def work(batches):
        fs, root = place(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        coder = library(path)
        base = f"{root}/part-{part:06d}"
        draft = f"{base}.bin.{uuid.uuid4().hex}"
        sizes, ids = [], []
        with fs.open_output_stream(draft) as out:
            for batch in slices(batches, holds="library"):
                ids += [NO_ID if d is None else d for d in batch.column(0).to_pylist()]
                for packed in coder.encode(batch.column(1).to_pylist(), end_id):
                    sizes.append(len(packed) // coder.type.itemsize)
                    out.write(packed)
        fs.move(draft, f"{base}.bin")
        offsets = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64)))).astype("<u8")
        put(fs, f"{base}.off", [offsets.tobytes()])
        put(fs, f"{base}.doc", [np.array(ids, dtype="<i8").tobytes()])
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])], "bytes_per_id": [coder.type.itemsize]},
            schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes_per_id", pa.int32())]),
        )

    short_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = parts_of(spark)
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(work, PARTS).write.parquet(f"{folder}/counts")
    # one row per partition, however many documents there are
    counts = spark.read.parquet(f"{folder}/counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = counts.select(
        "*",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"),
    )
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped into memory if it is local."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def token_range(folder: str, part: int, bytes_per_id: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a partition's file, without reading the rest of it."""
    fs, root = place(folder)
    path, dtype = f"{root}/part-{part:06d}.bin", np.dtype(f"<u{bytes_per_id}")
    if isinstance(fs, pafs.LocalFileSystem):
        return mapped(fs, path, dtype)[start:stop]
    with fs.open_input_file(path) as f:
        f.seek(start * bytes_per_id)
        return np.frombuffer(f.read((stop - start) * bytes_per_id), dtype=dtype)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, read back from the files: its place, its token count and a checksum of its ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, doc_index long"

    def work(batches):
        fs, root = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                part, width = row["part"], row["bytes_per_id"]
                offsets = mapped(fs, f"{root}/part-{part:06d}.off", "<u8").astype(np.int64)
                ids = mapped(fs, f"{root}/part-{part:06d}.doc", "<i8")
                tokens = mapped(fs, f"{root}/part-{part:06d}.bin", f"<u{width}")
                for at in range(0, len(ids), 4096):
                    some = np.asarray(ids[at : at + 4096])
                    ends = offsets[at : at + len(some) + 1]
                    crcs = []
                    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                        crc = 0
                        for x in range(a, b, 1 << 20):
                            crc = zlib.crc32(np.asarray(tokens[x : min(x + (1 << 20), b)]).astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, mask=some == NO_ID),
                            pa.array(ends[:-1] + row["token_base"]),
                            pa.array(np.diff(ends)),
                            pa.array(crcs, type=pa.int64()),
                            pa.array(np.arange(at, at + len(some)) + row["doc_base"]),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "doc_index"],
                    )

    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.repartition(parts_of(spark), "part").mapInArrow(work, schema)


def written_tokens(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write all documents to a new folder of the shared file system and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, end_id, folder)
    return read_tokens(docs.sparkSession, folder)
