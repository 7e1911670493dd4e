"""Token counts that follow edits (operator 8).

A document's pre-tokens hang in a segment tree: leaves are runs of whole pre-tokens with their characters and tokens, inner
nodes have the sums. An edit goes down to the leaves it touches, and only those are encoded again, with the
context that pre-token boundaries depend on:

- to the left, a pre-token can change if the edit begins less than two characters after its end;
- to the right, encoding goes on leaf by leaf until a boundary of the new pre-tokens falls on a boundary between
  old leaves behind the edit. From there on the text is the same, so the pre-tokens are.

Then the sums on the way up are set right. Tokens are counted when they are asked for, so that the new pre-tokens of many
documents are encoded together. Strings of special tokens count as ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.llm.bpe import SAFE_BLANK, Pieces, pieces_of
from driftline.llm.common import short_batches, slices

#: pre-tokens, or pieces between safe blanks, in a new leaf
LEAF = 48
#: characters behind a place that tell whether a pre-token ends there: contractions and white space look at two
AHEAD = 4


class Node:
    """A leaf with its text, or an inner node with the sums of two children.

    ``tokens`` is None as long as a leaf below has new ``words`` that are not counted.
    """

    __slots__ = ("chars", "left", "leaves", "right", "text", "tokens", "words")

    def __init__(self, text: str | None = None, tokens: int | None = None, left: Node | None = None, right: Node | None = None, words: list[str] | None = None):
        self.text, self.left, self.right, self.words = text, left, right, words
        if text is not None:
            self.chars, self.tokens, self.leaves = len(text), tokens, 1
        else:
            self.chars = left.chars + right.chars
            self.tokens = None if left.tokens is None or right.tokens is None else left.tokens + right.tokens
            self.leaves = left.leaves + right.leaves

    def count(self, pieces: Pieces) -> int:
        """Tokens; sums that are not known yet are set right."""
        if self.tokens is None:
            if self.text is None:
                self.tokens = self.left.count(pieces) + self.right.count(pieces)
            else:
                self.tokens = sum(map(len, map(pieces.pretoken, self.words))) // 4
        return self.tokens


def balanced(leaves: list[Node]) -> Node | None:
    while len(leaves) > 1:
        pairs = [Node(left=a, right=b) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = pairs + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0] if leaves else None


def walk(node: Node | None) -> Iterator[Node]:
    stack = [node] if node else []
    while stack:
        x = stack.pop()
        if x.text is not None:
            yield x
        else:
            stack += [x.right, x.left]


class Tree:
    """The pre-token segment tree of one document."""

    def __init__(self, leaves: list[tuple[str, int]], pieces: Pieces):
        self.pieces = pieces
        self.root = balanced([Node(t, n) for t, n in leaves])
        self.encoded_chars = 0

    @property
    def tokens(self) -> int:
        return self.root.count(self.pieces) if self.root else 0

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """Index and first character of the leaf that holds the character ``offset``; past the end, the number of leaves."""
        if self.root is None or offset >= self.root.chars:
            return (self.root.leaves, self.root.chars) if self.root else (0, 0)
        node, index, start = self.root, 0, 0
        while node.text is None:
            if offset - start < node.left.chars:
                node = node.left
            else:
                index, start, node = index + node.left.leaves, start + node.left.chars, node.right
        return index, start

    def leaf(self, index: int) -> Node:
        node = self.root
        while node.text is None:
            if index < node.left.leaves:
                node = node.left
            else:
                index, node = index - node.left.leaves, node.right
        return node

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters from ``at`` on by ``insert``. Places beyond the text are cut to it."""
        at = min(max(at, 0), self.chars)
        delete = min(max(delete, 0), self.chars - at)
        if not delete and not insert:
            return
        first, start = self.leaf_at(max(at - 2, 0)) if self.root else (0, 0)
        total = self.root.leaves if self.root else 0
        if first == total and total:  # an end behind which nothing stands: the last leaf can change
            first, start = self.leaf_at(self.chars - 1)
        last, end, parts = first, start, []
        while last < total and (end < at + delete or last == first):
            parts.append(self.leaf(last).text)
            end += len(parts[-1])
            last += 1
        old = "".join(parts)
        new = old[: at - start] + insert + old[at + delete - start :]
        while True:
            after = self.leaf(last).text if last < total else ""
            words = self._whole(new, after)
            if words is not None:
                break
            new, last = new + after, last + 1
        leaves = []
        for i in range(0, len(words), LEAF):
            some = words[i : i + LEAF]
            leaves.append(Node("".join(some), words=some))
        self.encoded_chars += len(new)
        self.root = _replaced(self.root, first, last, balanced(leaves))
        if self.root and _depth_over(self.root):
            self.root = balanced(list(walk(self.root)))

    def _whole(self, new: str, after: str) -> list[str] | None:
        """Pre-tokens of ``new`` if one ends where it ends, with ``after`` behind it; else None."""
        words = self.pieces.find(new + after[:AHEAD])
        if not after:
            return words
        at = len(new) + min(len(after), AHEAD)
        while at > len(new):
            at -= len(words.pop())
        return words if at == len(new) else None


def uncounted(node: Node | None) -> Iterator[Node]:
    """Leaves whose new words are not counted."""
    stack = [node] if node else []
    while stack:
        x = stack.pop()
        if x.tokens is None:
            if x.text is None:
                stack += [x.right, x.left]
            else:
                yield x


def counted_together(trees: list[Tree], pieces: Pieces) -> list[int]:
    """Tokens of each tree. New words of all trees are encoded together."""
    words = {w for tree in trees for leaf in uncounted(tree.root) for w in leaf.words}
    pieces.learn(pieces.room(words, 1))
    return [tree.tokens for tree in trees]


def _depth_over(node: Node, factor: int = 3) -> bool:
    """Whether the leftmost or rightmost way down is much longer than that of a balanced tree; a cheap sign of many edits at one place."""
    limit = factor * (node.leaves.bit_length() + 2)
    for side in ("left", "right"):
        x, depth = node, 0
        while x.text is None:
            x, depth = getattr(x, side), depth + 1
        if depth > limit:
            return True
    return False


def _replaced(node: Node | None, first: int, last: int, new: Node | None) -> Node | None:
    """The tree with leaves [first, last) replaced by ``new``; sums on the way up are those of the new children."""
    if node is None:
        return new
    if first <= 0 and last >= node.leaves:
        return new
    if node.text is not None:  # an empty range before or behind this leaf
        pair = (new, node) if last <= 0 else (node, new)
        return Node(left=pair[0], right=pair[1]) if new else node
    n = node.left.leaves
    if last <= n and (first < n or last < n):
        left, right = _replaced(node.left, first, last, new), node.right
    elif first >= n:
        left, right = node.left, _replaced(node.right, first - n, last - n, new)
    else:
        left, right = _replaced(node.left, first, n, new), _replaced(node.right, 0, last - n, None)
    if left is None or right is None:
        return left or right
    return Node(left=left, right=right)


def leaves_of(texts: list[str], pieces: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
    """Characters and tokens of the leaves of each text, cut at safe blanks."""
    cut, new = [], set()
    for text in texts:
        first, *more = SAFE_BLANK.split(text)
        units = list(map(" ".__add__, more))
        new.update(units)
        cut.append([first, *units] if text else [])
    pieces.ready(new)
    of = pieces.__getitem__
    out = []
    for units in cut:
        starts = np.arange(0, len(units), LEAF)
        chars = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        tokens = np.fromiter(map(len, map(of, units)), dtype=np.int64, count=len(units)) // 4
        out.append((np.add.reduceat(chars, starts), np.add.reduceat(tokens, starts)) if units else (chars, tokens))
    return out


# Spark

LEAVES = "array<struct<chars: long, tokens: long>>"
_LEAVES = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64())]))
EDITS = "array<struct<at: long, removed: long, inserted: string>>"


def _packed(sizes: list[int], chars: np.ndarray, tokens: np.ndarray) -> pa.Array:
    """Leaves of several trees as a column, from their numbers in each and their sums in order."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], fields=list(_LEAVES.value_type))
    return pa.ListArray.from_arrays(pa.array(ends), flat).cast(_LEAVES)


def _unpacked(leaves: pa.Array) -> Iterator[tuple[list[int], list[int]]]:
    """Characters and tokens of the leaves of each tree."""
    flat, at = leaves.flatten(), 0
    chars, tokens = (flat.field(name).to_pylist() for name in ("chars", "tokens"))
    for size in leaves.value_lengths().to_pylist():
        end = at + (size or 0)
        yield chars[at:end], tokens[at:end]
        at = end


def build(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``text`` (null as empty), ``leaves`` and ``n_tokens``: the trees of all documents. No shuffle."""

    def work(batches):
        for batch in slices(batches, holds="bpe"):
            texts = batch.column(batch.num_columns - 1)
            made = leaves_of(texts.to_pylist(), pieces_of(path))
            leaves = _packed([len(c) for c, _ in made], *(np.concatenate([x[i] for x in made]) for i in (0, 1)))
            sums = pa.array([int(t.sum()) for _, t in made], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, leaves, sums], [*keep, "text", "leaves", "n_tokens"])

    short_batches(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(work, _with(rows.schema, f"leaves {LEAVES}, n_tokens long"))


def _with(schema: StructType, more: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def edited(trees: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Apply each row's ``edits`` (an array, in order; null for none) to its tree.

    Gives ``keep`` columns, the new ``text``, ``leaves`` and ``n_tokens``, and ``encoded_chars``, the characters that had to be encoded.
    """

    def work(batches):
        pieces = pieces_of(path)
        for batch in slices(batches, holds="bpe"):
            text, leaves, edits = batch.columns[-3:]
            trees = []
            for t, (chars, tokens), es in zip(text.to_pylist(), _unpacked(leaves), edits.to_pylist()):
                ends = [0, *accumulate(chars)]
                tree = Tree([(t[a:b], n) for a, b, n in zip(ends, ends[1:], tokens)], pieces)
                for e in es or []:
                    tree.edit(e["at"], e["removed"], e["inserted"] or "")
                trees.append(tree)
            sums = counted_together(trees, pieces)
            last = [list(walk(tree.root)) for tree in trees]
            flat = [x for some in last for x in some]
            arrays = [
                pa.array(["".join(x.text for x in some) for some in last], pa.string()),
                _packed(list(map(len, last)), np.array([x.chars for x in flat], dtype=np.int64), np.array([x.tokens for x in flat], dtype=np.int64)),
                pa.array(sums, pa.int64()), pa.array([tree.encoded_chars for tree in trees], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *arrays], [*keep, "text", "leaves", "n_tokens", "encoded_chars"])

    rows = trees.select(*keep, "text", "leaves", "edits")
    schema = _with(rows.select(*keep).schema, f"text string, leaves {LEAVES}, n_tokens long, encoded_chars long")
    return rows.mapInArrow(work, schema)


def apply_edits(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """Trees (``doc_id, text, leaves``) after ``edits`` (``doc_id, seq, at, removed, inserted``), in the order of ``seq``.

    Edits of one document depend on each other, so they are gathered in its row. Edits of unknown or null documents are ignored.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "at", "removed", "inserted")))
    listed = edits.groupBy("doc_id").agg(ordered.alias("edits"))
    listed = listed.withColumn("edits", F.expr("transform(edits, e -> named_struct('at', e.at, 'removed', e.removed, 'inserted', e.inserted))"))
    return edited(trees.join(listed, "doc_id", "left"), path, ["doc_id"])


def own_edits(text: str = "text") -> str:
    """SQL: four edits made from the text itself: a passage moved forward, a cut, a turned passage, an addition at the end."""
    n, h = f"length({text})", f"crc32({text})"
    place = "cast(pmod({0} * {1}, {2} + 1) as long)"
    p = [place.format(h, k, n) for k in (1, 7, 31)]
    return (
        f"array(named_struct('at', {p[0]}, 'removed', 0L, 'inserted', substring({text}, 1, 40)),"
        f" named_struct('at', {p[1]}, 'removed', 17L, 'inserted', ''),"
        f" named_struct('at', {p[2]}, 'removed', 9L, 'inserted', reverse(substring({text}, cast({p[2]} as int) + 1, 9))),"
        f" named_struct('at', cast({n} as long) + 1000, 'removed', 0L, 'inserted', concat(chr(10), left({text}, 25))))"
    )


def counted(docs: DataFrame, path: str) -> DataFrame:
    """Token counts of each document before and after the edits of ``own_edits``, one row per row of ``docs``.

    ``doc_id, n_tokens_before, n_tokens, encoded_chars, n_chars, text_sha256`` (of the new text). Null texts count as
    empty; repeated rows get equal results; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("edits", F.expr(own_edits()))
    trees = build(rows, path, ["doc_id", "edits"]).withColumn("n_tokens_before", F.col("n_tokens"))
    done = edited(trees, path, ["doc_id", "n_tokens_before"])
    return done.select(
        "doc_id", "n_tokens_before", "n_tokens", "encoded_chars", F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )
