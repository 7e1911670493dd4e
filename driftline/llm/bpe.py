"""Byte-pair encoding as a streaming transducer, and its inverse (operator 3).

A merge list has a *sufficient lookahead*: a number of bytes L such that the tokens of a
piece that end L or more bytes before the end of what has been read cannot change, whatever
follows. Take two runs of the merges, over x and over xy. Let p be the last boundary up to
which both have the same tokens. p moves left only when a merge (u, v) takes place across it in
one of the runs; it then moves by the length of u. The next such merge (u2, v2) has a later
rank, and its right part starts where u starts, so u stands on the left spine of v2. The longest
chain of such merges, measured by the bytes of their left parts, bounds how far p can go.
``MergeTable`` finds it by one pass over the merges from the last to the first.

Two facts make the encoder stream: tokens are cut at pre-token boundaries, which depend on a few
following characters only, and every run of whole tokens of an encoding is the encoding of
its own bytes, so work can go on from any boundary that is stable. Memory is bounded by
the block, the lookahead and the cache of pieces, never by the text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from driftline.llm.common import KEPT, short_batches, slices

#: entries of the cache of pieces; when it is full it is emptied
CACHE_PIECES = 300_000
#: characters of a piece that is kept in the cache
CACHE_CHARS = 64
#: characters of text taken in at a time
BLOCK = 1 << 16
#: characters without a safe blank after which the encoder goes on inside the piece
HELD = 1 << 13


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """Characters that stand for the 256 bytes in files of byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: bounds of characters for which there are patterns: all, those of two bytes in UTF-16, those of Latin-1
ALL, BASIC, LATIN = sys.maxunicode + 1, 1 << 16, 1 << 8
#: characters that are white space to the tokenizer
WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


@lru_cache(maxsize=3)
def classes(below: int = ALL) -> dict[str, str]:
    """Inner parts of classes for letters (L), numbers (N) and white space (S), of the characters under ``below``."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": [], "S": []}
    for c in range(below):
        category = unicodedata.category(chr(c))
        kind = ranges.get("S" if c in WHITE else category[0] if category[0] in "LN" else "")
        if kind is not None:
            if kind and kind[-1][1] == c - 1:
                kind[-1][1] = c
            else:
                kind.append([c, c])
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in r) for k, r in ranges.items()}


@lru_cache(maxsize=3)
def patterns(below: int = ALL) -> dict[str, re.Pattern]:
    """The pre-token pattern, and one pattern per class of characters that can make a long pre-token, for texts of characters under ``below``."""
    letters, numbers, space = (classes(below)[k] for k in "LNS")
    word, digits, rest = f"[{letters}]+", f"[{numbers}]+", f"[^{space}{letters}{numbers}]+"
    return {  # words come first, as no other alternative starts like them
        "piece": re.compile(f" ?{word}|'s|'t|'re|'ve|'m|'ll|'d| ?{digits}| ?{rest}|[{space}]+(?![^{space}])|[{space}]+"),
        "word": re.compile(word),
        "digits": re.compile(digits),
        "rest": re.compile(rest),
        "space": re.compile(f"[{space}]+"),
    }


def _below(text: str) -> int:
    """The least bound of ``patterns`` that holds for a text."""
    try:
        text.isascii() or text.encode("latin-1")
        return LATIN
    except UnicodeEncodeError:
        return BASIC if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else ALL


#: a blank with a visible character on both sides: always a boundary of pre-tokens, and it opens the next one
SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


class HashedPairs:
    """Ranks of many pairs at once: open addressing in NumPy arrays."""

    BITS = 18
    NONE = np.iinfo(np.int32).max

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(self.BITS, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, self.NONE, dtype=np.int32)
        self.made = np.zeros(len(pairs), dtype=np.int64)
        todo = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        ranks = np.array([r for r, _ in pairs.values()], dtype=np.int32)
        for rank, new in pairs.values():
            self.made[rank] = new
        slots = self._slot(todo)
        while len(todo):
            free = np.flatnonzero(self.keys[slots] == -1)
            _, one = np.unique(slots[free], return_index=True)
            put = free[one]
            self.keys[slots[put]], self.ranks[slots[put]] = todo[put], ranks[put]
            rest = np.ones(len(todo), dtype=bool)
            rest[put] = False
            todo, ranks, slots = todo[rest], ranks[rest], (slots[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        slots = self._slot(keys)
        out = np.full(keys.shape, self.NONE, dtype=np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys, slots = keys.ravel(), slots.ravel()
        flat = out.ravel()
        while len(open_):
            seen = self.keys[slots[open_]]
            hit = seen == keys[open_]
            flat[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
        return flat.reshape(out.shape)


class MergeTable:
    """A merge list read from a tokenizer file, with its sufficient lookahead in bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        self.pairs = {
            (vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)
        }
        self.hashed = HashedPairs(self.pairs)
        self.byte_array = np.array(self.byte_ids, dtype=np.int64)
        self.lookahead = self._lookahead([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])

    def _lookahead(self, merges: list[tuple[int, int, int]]) -> int:
        left_part = {}
        for u, _, t in merges:
            left_part.setdefault(t, u)
        longest: dict[int, int] = defaultdict(int)  # by token: the longest chain that goes on from it
        best = 0
        for u, v, _ in reversed(merges):
            chain = len(self.token_bytes[u]) + longest[u]
            best = max(best, chain)
            t: int | None = v
            while t is not None:  # the left spine of v
                longest[t] = max(longest[t], chain)
                t = left_part.get(t)
        return best

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one pre-token."""
        ids = [self.byte_ids[b] for b in data]
        return self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many short pre-tokens at once, packed: one merge in each of them per round."""
        out = [b""] * len(words)
        sized: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            sized[next((n for n in (6, 9, 12, 16, 24) if len(w) <= n), len(w))].append(i)
        for width, rows in sized.items():
            flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), dtype=np.uint8)
            sizes = np.array([len(words[i]) for i in rows])
            ids = self.byte_array[flat].reshape(len(rows), width)
            ids[np.arange(width) >= sizes[:, None]] = -1
            ranks = self.hashed.rank(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(rows))
            cols = np.arange(width)
            while len(live):
                at = ranks[live].argmin(axis=1)
                best = ranks[live, at]
                go = best != HashedPairs.NONE
                live, at, best = live[go], at[go], best[go]
                if not len(live):
                    break
                mine = ids[live]
                mine[np.arange(len(live)), at] = self.hashed.made[best]
                take = np.minimum(cols + (cols > at[:, None]), width - 1)
                mine = np.take_along_axis(mine, take, axis=1)
                mine[:, -1] = -1
                mine_ranks = np.take_along_axis(ranks[live], np.minimum(take[:, :-1], width - 2), axis=1)
                mine_ranks[:, -1] = HashedPairs.NONE
                n = np.arange(len(live))
                left = np.maximum(at - 1, 0)
                before = self.hashed.rank(mine[n, left], mine[n, left + 1])
                here = np.minimum(at, width - 2)
                after = self.hashed.rank(mine[n, here], mine[n, here + 1])
                mine_ranks[n, left] = before
                mine_ranks[n, here] = after
                ids[live], ranks[live] = mine, mine_ranks
            ends = np.cumsum(4 * (ids >= 0).sum(axis=1)).tolist()
            packed, at = ids[ids >= 0].astype("<u4").tobytes(), 0
            for i, end in zip(rows, ends):
                out[i] = packed[at:end]
                at = end
        return out

    def _merge_short(self, ids: list[int]) -> list[int]:
        pairs = self.pairs
        while len(ids) > 1:
            best, at, new = None, -1, -1
            for i, pair in enumerate(zip(ids, ids[1:])):
                found = pairs.get(pair)
                if found is not None and (best is None or found[0] < best):
                    best, new = found
                    at = i
            if best is None:
                break
            ids[at : at + 2] = [new]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked positions: n log n for a piece of n bytes."""
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = pairs[a, b][1]
            alive[j] = 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := pairs.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (found := pairs.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (found[0], before[i], ids[before[i]], ids[i]))
        return [t for i, t in enumerate(ids) if alive[i]]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Pieces(dict):
    """Packed ids of pre-tokens, and of texts that begin and end at safe blanks; a cache with a bound."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table = table

    def find(self, text: str) -> list[str]:
        """Pre-tokens of a text. Classes without the characters that it can't have are looked up much faster."""
        return patterns(_below(text))["piece"].findall(text)

    def _keep(self, text: str, packed: bytes) -> bytes:
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[text] = packed
        return packed

    def pretoken(self, word: str) -> bytes:
        packed = self.get(word)
        return self._keep(word, pack(self.table.merge(word.encode()))) if packed is None else packed

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens that are not in the cache, the short ones together."""
        short = [w for w in words if len(w) <= 24]
        self.update(zip(short, self.table.merge_many([w.encode() for w in short])))
        self.update((w, pack(self.table.merge(w.encode()))) for w in words if len(w) > 24)

    def room(self, texts: set[str], entries: int) -> list[str]:
        """Those of the texts that are to be kept but are not in the cache, each of which makes up to ``entries``.

        If they don't fit, the cache is emptied and all of them are new, so that none has to be encoded alone.
        """
        new = [t for t in texts if t not in self and len(t) <= CACHE_CHARS]
        if len(self) + entries * len(new) > CACHE_PIECES:
            self.clear()
            new = [t for t in texts if len(t) <= CACHE_CHARS]
        return new

    def ready(self, texts: set[str]) -> None:
        """Have texts that begin with a safe blank in the cache. Those with other characters than ASCII are looked at apart."""
        new = self.room(texts, 3)
        for plain in (True, False):
            if some := [t for t in new if t.isascii() is plain]:
                self.warm(some)

    def warm(self, texts: list[str]) -> None:
        """Encode texts that are not in the cache; each begins with a safe blank, so together they are one text."""
        words = self.find("".join(texts))
        self.learn([w for w in {*words} if w not in self])
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))))
        first = np.concatenate(([0], last[:-1] + 1))
        of = self.__getitem__
        for i in np.flatnonzero(last > first).tolist():  # one pre-token alone is in the cache by now
            self[texts[i]] = b"".join(map(of, words[first[i] : last[i] + 1]))

    def __missing__(self, text: str) -> bytes:
        return self._keep(text, b"".join(map(self.pretoken, self.find(text))))


class StreamEncoder:
    """Feed blocks of text, get the bytes of the ids that are stable; ``finish`` gives the rest."""

    def __init__(self, pieces: Pieces, held: int = HELD):
        self.pieces, self.table, self.held = pieces, pieces.table, held
        self.tail = ""  # may be the beginning of a special token
        self.text = ""  # from the last stable pre-token boundary
        self.run: str | None = None  # class of the pre-token that is under way
        self.window = b""  # its bytes from the last stable token boundary

    # special tokens part the text first

    def feed(self, text: str) -> bytes:
        out = []
        self.tail += text
        while True:
            hits = [(at, -len(s), s) for s in self.table.specials if (at := self.tail.find(s)) >= 0]
            if not hits:
                break
            at, _, special = min(hits)
            out += [self._plain(self.tail[:at]), self._end(), pack([self.table.specials[special]])]
            self.tail = self.tail[at + len(special) :]
        keep = max((k for s in self.table.specials for k in range(1, len(s)) if self.tail.endswith(s[:k])), default=0)
        cut = len(self.tail) - keep
        ready, self.tail = self.tail[:cut], self.tail[cut:]
        return b"".join([*out, self._plain(ready)])

    def finish(self) -> bytes:
        ready, self.tail = self.tail, ""
        return self._plain(ready) + self._end()

    def _whole(self, text: str) -> bytes:
        """Ids of a text that ends at a pre-token boundary."""
        first, *more = SAFE_BLANK.split(text)
        of = self.pieces.__getitem__
        return b"".join([of(first), *[of(" " + x) for x in more]]) if text else b""

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        out = []
        if self.run:
            text = self._in_run(text, out)
        self.text += text
        cut = self._last_safe_blank()
        if cut > 0:
            out.append(self._whole(self.text[:cut]))
            self.text = self.text[cut:]
        while len(self.text) > self.held and not self.run and self._inside(out):
            pass
        return b"".join(out)

    def _last_safe_blank(self) -> int:
        text, at = self.text, len(self.text) - 1
        while (at := text.rfind(" ", 0, at)) > 0:
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                return at
        return 0

    def _inside(self, out: list[bytes]) -> bool:
        """Go on in a long text without safe blanks: whole pre-tokens first, then into one that is under way."""
        done, last = 0, None
        for m in patterns()["piece"].finditer(self.text):
            if last is not None and last.end() + 4 <= len(self.text):
                out.append(self.pieces.pretoken(last[0]))
                done = last.end()
            last = m
        if done:
            self.text = self.text[done:]
            return len(self.text) > self.held
        if last.start() or len(last[0]) < 16:  # no pre-token under way that is long enough to be told from a contraction
            return False
        text, self.text = self.text, ""
        kinds = patterns()
        start = int(len(text) > 1 and text[0] == " " and not text[1].isspace())
        self.run = next(k for k in ("word", "digits", "rest", "space") if kinds[k].match(text, start))
        self.window = text[:start].encode()
        self.text = self._in_run(text[start:], out)
        return False

    def _in_run(self, text: str, out: list[bytes]) -> str:
        """Take in what belongs to the pre-token under way; give back what follows it."""
        m = patterns()[self.run].match(text)
        end = m.end() if m else 0
        self.window += text[:end].encode()
        if end == len(text):
            self._stable(out)
            return ""
        rest = text[end:]
        if self.run == "space":  # the last one goes with what follows
            window = self.window.decode()
            self.window, rest = window[:-1].encode(), window[-1] + rest
        out.append(self._flush())
        return rest

    def _stable(self, out: list[bytes]) -> None:
        room = self.table.lookahead + (4 if self.run == "space" else 0)
        if len(self.window) <= 2 * room:
            return
        ids, at, limit = self.table.merge(self.window), 0, len(self.window) - room
        for n, t in enumerate(ids):
            if at + len(self.table.token_bytes[t]) > limit:
                break
            at += len(self.table.token_bytes[t])
        out.append(pack(ids[:n]))
        self.window = self.window[at:]

    def _flush(self) -> bytes:
        window, self.window, self.run = self.window, b"", None
        return pack(self.table.merge(window)) if window else b""

    def _end(self) -> bytes:
        if self.run:
            return self._flush()
        text, self.text = self.text, ""
        return self._whole(text)


class StreamDecoder:
    """Feed ids, get text; bytes of a character that is not whole yet wait for the next call."""

    def __init__(self, table: MergeTable):
        self.of = table.token_bytes.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.of, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    """One table and cache per Python worker and tokenizer file."""
    return Pieces(MergeTable(path))


KEPT["bpe"] = pieces_of.cache_clear


def blocks(text: str, size: int = BLOCK):
    for at in range(0, len(text), size):
        yield text[at : at + size]


def encode_many(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts, as ``encode`` gives them. New pieces of all texts are merged together.

    A text of one block without special tokens is whole when it arrives, so all its pieces are stable.
    """
    pieces = pieces_of(path)
    cut: list[list[str] | None] = []
    new: set[str] = set()
    for text in texts:
        if len(text) > BLOCK or any(s in text for s in pieces.table.specials):
            cut.append(None)
            continue
        first, *more = SAFE_BLANK.split(text)
        units = list(map(" ".__add__, more))
        new.update(units)
        cut.append([first, *units])
    pieces.ready(new)
    of = pieces.__getitem__
    return [encode(t, path) if u is None else b"".join(map(of, u)) for t, u in zip(texts, cut)]


def encode(text: str, path: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    stream = StreamEncoder(pieces_of(path))
    return b"".join([*(stream.feed(b) for b in blocks(text)), stream.finish()])


def decode(packed: bytes, table: MergeTable, block: int = BLOCK):
    """Texts of packed ids, block by block."""
    stream = StreamDecoder(table)
    for at in range(0, len(packed), 4 * block):
        yield stream.feed(np.frombuffer(packed[at : at + 4 * block], dtype="<u4").tolist())
    yield stream.finish()


# Spark


def encode_texts(docs: DataFrame, path: str, keep: list[str], col: str = "text") -> DataFrame:
    """``keep`` columns and ``ids``: the packed ids of the text, empty for a null text.

    ``path`` is a tokenizer file that every executor has. Row by row, no shuffle.
    """

    def work(batches):
        for batch in slices(batches, holds="bpe"):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = pa.array(encode_many(texts, path), type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keep, "ids"])

    short_batches(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col(col), F.lit("")).alias("__text"))
    schema = StructType([*rows.select(*keep).schema.fields, StructField("ids", BinaryType())])
    return rows.mapInArrow(work, schema)


def decode_ids(encoded: DataFrame, path: str, keep: list[str], col: str = "ids") -> DataFrame:
    """``keep`` columns and ``text``: what the packed ids stand for; null ids give an empty text."""

    def work(batches):
        table = pieces_of(path).table
        for batch in slices(batches, holds="bpe"):
            texts = ["".join(decode(b or b"", table)) for b in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    schema = StructType([*encoded.select(*keep).schema.fields, StructField("text", StringType())])
    return encoded.select(*keep, col).mapInArrow(work, schema)


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of each text and of what they decode to, in one pass.

    A null text counts as empty. Rows with equal or null ``doc_id`` stay rows of their own;
    other columns are not read. An empty table gives an empty result.
    """

    def work(batches):
        table = pieces_of(path).table
        for batch in slices(batches, holds="bpe"):
            texts = batch.column(1).to_pylist()
            out: list[tuple] = []
            for text, packed in zip(texts, encode_many(texts, path)):
                seen, same, at = hashlib.sha256(), True, 0
                for part in decode(packed, table):
                    seen.update(part.encode())
                    same &= text.startswith(part, at)
                    at += len(part)
                same &= at == len(text)
                out.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), seen.hexdigest(), same))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in cols)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(work, ROUND_TRIP)
