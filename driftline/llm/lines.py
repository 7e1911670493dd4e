"""Near-duplicate lines by a segment-partition edit join (operator 5), with DataFrame functions only.

A line of length n is split into ``edits + 1`` segments. Two lines within ``edits`` edits share a segment:
one of the shorter line's is a substring of the longer, at a place that the lengths narrow down to a few. Lines
are looked up under (length, segment number, segment) and under the substrings that can match
segments of lines of equal or smaller length; the multi-match-aware windows say which. What meets is
verified by a banded bit-parallel edit distance on the parts that differ.

Equal lines are one row throughout, known by two 64-bit hashes. Rows that move between machines hold
hashes, not texts; only texts of candidate lines are fetched. Under a segment that many lines share,
lines are not paired off: there, for one edit, lines meet again under their text without one character,
and a star per such group carries the links (see ``_crowded``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import NOT_SPACES, SPACES, numbered, row_place, stored, unpacked
from driftline.llm.components import components

#: lines of fewer characters are left alone: so short, they are alike by chance
MIN_CHARS = 20
#: lines under one segment that are compared directly
CROWD = 64
#: candidate lines whose hashes (16 bytes each) are sent to every executor; beyond it they are joined by a shuffle
SENT = 500_000


def lines_of(rows: DataFrame) -> DataFrame:
    """Of ``numbered`` rows: ``doc_id``, ``th``, ``at``, ``line_no`` from 0, the line with white space runs as one blank, its length and two hashes; every line of every text."""
    line = F.trim(F.regexp_replace("raw", f"{SPACES}+", " "))
    rows = rows.select(F.col("__row.doc_id").cast("long").alias("doc_id"), "th", "at", F.posexplode(F.split("__row.text", "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "th", "at", F.col("line_no").cast("long"), line.alias("line"))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line"), "n": F.length("line")})


def _segment(n: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line of length n; the longer ones come last."""
    parts = edits + 1
    short, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    before = F.greatest(F.lit(0), F.lit(i - parts) + longer)
    return F.lit(1) + F.lit(i) * short + before, short + (F.lit(i - parts) + longer >= 0).cast("int")


def _key(line: Column, n: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(n.cast("int"), F.lit(i), F.substring(line, start, size))


def index_keys(edits: int) -> list[Column]:
    n = F.col("n")
    return [_key(F.col("line"), n, i, *_segment(n, i, edits)) for i in range(edits + 1)]


def probe_keys(edits: int) -> list[Column]:
    """Keys of substrings that are not the line's own segments: other places, and segments of shorter lines."""
    out = []
    for less in range(edits + 1):
        n = F.col("n") - less
        for i in range(edits + 1):
            start, size = _segment(n, i, edits)
            low, high = max(-i, less - (edits - i)), min(i, less + edits - i)
            for shift in range(low, high + 1):
                if less or shift:
                    inside = (start + shift >= 1) & (start + shift + size - 1 <= F.col("n"))
                    out.append(F.when(inside, _key(F.col("line"), n, i, start + shift, size)))
    return out


def banded_distance(a: str, b: str, edits: int) -> str:
    """SQL: edit distance of ``a`` and ``b`` (arrays of characters, ``a`` not shorter) if it is at most ``edits``, else more than that.

    One word holds the band's vertical differences, 2 * edits + 1 rows around the diagonal; a step per character of
    ``b`` updates all of them. The distance is followed along the diagonal that ends in the last cell.
    """
    width = 2 * edits + 1
    equal = " | ".join(
        f"IF(j - {edits} + {k} BETWEEN 1 AND size({a}) AND {a}[greatest(0, least(size({a}), j - {edits} + {k}) - 1)] = {b}[j - 1], {1 << k}L, 0L)"
        for k in range(width)
    )
    goal = f"shiftleft(1L, size({a}) - size({b}) + {edits})"
    next_ = (
        "named_struct('vp', hn | ~(shiftrightunsigned(d0, 1) | hp), 'vn', shiftrightunsigned(d0, 1) & hp,"
        f" 'd', s.d + IF((d0 & {goal}) = 0, 1, 0))"
    )
    # the mask keeps the band; bits above it would carry into the sign
    mask = (1 << (width + 1)) - 1
    step = _let("x", equal, _let("d0", "(((x & s.vp) + s.vp) ^ s.vp) | x | s.vn", _let("hp", "s.vn | ~(d0 | s.vp)", _let(
        "hn", "d0 & s.vp",
        f"named_struct('vp', (hn | ~(shiftrightunsigned(d0, 1) | hp)) & {mask}L,"
        f" 'vn', shiftrightunsigned(d0, 1) & hp & {mask}L, 'd', s.d + IF((d0 & {goal}) = 0, 1, 0))",
    ))))
    start = f"named_struct('vp', {mask & ~((1 << edits) - 1)}L, 'vn', 0L, 'd', size({a}) - size({b}))"
    return f"aggregate(IF(size({b}) = 0, array(), sequence(1, size({b}))), {start}, (s, j) -> IF(s.d > {edits}, s, {step}), s -> s.d)"


def _let(name: str, value: str, body: str) -> str:
    """SQL that works out ``value`` once, whatever the optimiser makes of the rest."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _common(a: str, b: str, end: bool) -> str:
    """SQL: length of the common beginning (or end) of two texts. Steps go down by halves; those that fit add up to it."""
    piece = "right(left({0}, length({0}) - n), s)" if end else "substring({0}, n + 1, s)"
    fits = f"n + s <= least(length({a}), length({b})) AND {piece.format(a)} = {piece.format(b)}"
    return f"aggregate(transform(sequence(0, 30), k -> shiftleft(1, 30 - k)), 0, (n, s) -> IF({fits}, n + s, n))"


def verified(pairs: DataFrame, edits: int) -> DataFrame:
    """Pairs whose texts ``a`` and ``b`` are within ``edits`` edits. Common beginnings and ends don't change the distance and are cut off."""
    distance = _let(
        "p", "IF(length(a) < length(b), named_struct('a', b, 'b', a), named_struct('a', a, 'b', b))",
        _let("f", _common("p.a", "p.b", end=False), _let(
            "q", "named_struct('a', substring(p.a, f + 1), 'b', substring(p.b, f + 1))",
            _let("e", _common("q.a", "q.b", end=True), _let(
                "c", "named_struct('a', filter(split(left(q.a, length(q.a) - e), ''), x -> x <> ''), 'b', filter(split(left(q.b, length(q.b) - e), ''), x -> x <> ''))",
                banded_distance("c.a", "c.b", edits),
            )),
        )),
    )
    near = F.abs(F.length("a") - F.length("b")) <= edits
    return pairs.where(F.when(near, F.expr(distance) <= edits).otherwise(False)).drop("a", "b")


def _texts(numbers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the lines in ``wanted`` (h1, h2), each once."""
    rows = lines_of(numbers).where(F.col("n") >= MIN_CHARS).select("h1", "h2", "line")
    if wanted.limit(SENT + 1).count() <= SENT:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, ["h1", "h2"], "left_semi").distinct()


def _id(prefix: str = "") -> Column:
    return F.concat(F.hex(f"{prefix}h1"), F.lit("-"), F.hex(f"{prefix}h2"))


def _pairs(placed: DataFrame, index: DataFrame) -> DataFrame:
    p = placed.select("key", F.struct("h1", "h2").alias("u"))
    q = index.select("key", F.struct("h1", "h2").alias("v"))
    return p.join(q, "key").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _crowded(texts: DataFrame) -> DataFrame:
    """Candidate pairs, for one edit, among lines that share a segment with many others: a star per group.

    Lines that differ in the character at one place meet under that place and the rest of the line, and
    all of such a group are within one edit of each other. A line and the same with one character more meet under the
    shorter one, which is the middle of the star; a group without it has no link.
    """
    cut = "concat(left(line, i - 1), substring(line, i + 1))"
    by_place = texts.select("h1", "h2", F.explode(F.expr(f"transform(sequence(1, length(line)), i -> struct(i, xxhash64(length(line), i, {cut}) AS key))")).alias("k"))
    alike = by_place.groupBy("k").agg(F.min(F.struct("h1", "h2")).alias("u"), F.count("*").alias("m")).where("m > 1")
    swapped = by_place.join(alike, "k").select("u", F.struct("h1", "h2").alias("v")).where("u <> v")
    shorter = texts.select(F.xxhash64(F.length("line"), "line").alias("key"), F.struct("h1", "h2").alias("u"))
    longer = texts.select(
        F.explode(F.expr(f"array_distinct(transform(sequence(1, length(line)), i -> xxhash64(length(line) - 1, {cut})))")).alias("key"),
        F.struct("h1", "h2").alias("v"),
    )
    added = longer.join(shorter, "key").select("u", "v").where("u <> v")
    both = swapped.unionByName(added)
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def line_links(rows: DataFrame, edits: int = 1, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """All different lines of ``numbered`` rows with their counts and first places, and links (u, v) between lines within ``edits`` edits.

    Links need not be all such pairs: under crowded segments a star stands for a group. Their components are the same.
    """
    index, probes = index_keys(edits), probe_keys(edits)
    names = [f"i{k}" for k in range(len(index))] + [f"p{k}" for k in range(len(probes))]
    place = F.struct(row_place().alias("row"), "line_no")
    lines = (
        lines_of(rows)
        .where(F.col("n") >= max(MIN_CHARS, edits + 1))
        .select("h1", "h2", place.alias("place"), *(c.alias(x) for c, x in zip([*index, *probes], names)))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("copies"), F.min("place").alias("first"), *(F.min(x).alias(x) for x in names))
    )
    lines = stored(lines, "lines")
    own = lines.select("h1", "h2", F.explode(F.array(*names[: len(index)])).alias("key"))
    other = lines.select("h1", "h2", F.explode(F.array(*names[len(index) :])).alias("key")).where("key IS NOT NULL")
    if edits == 1:
        hot = own.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > crowd).select("key")
        hot = stored(hot, "crowded")
        calm = own.join(hot, "key", "left_anti")
        pairs = _pairs(calm, calm).unionByName(_pairs(other, calm))
        if not hot.isEmpty():
            busy = own.unionByName(other).join(hot, "key", "left_semi").select("h1", "h2").distinct()
            pairs = pairs.unionByName(_crowded(stored(_texts(rows, stored(busy, "busy")), "busy-texts")))
    else:
        pairs = _pairs(own.unionByName(other), own)
    pairs = stored(pairs.distinct(), "pairs")
    wanted = pairs.select("u.*").unionByName(pairs.select("v.*")).distinct()
    texts = stored(_texts(rows, stored(wanted, "candidates")), "texts")
    with_a = pairs.join(texts.select(F.struct("h1", "h2").alias("u"), F.col("line").alias("a")), "u")
    with_both = with_a.join(texts.select(F.struct("h1", "h2").alias("v"), F.col("line").alias("b")), "v")
    links = verified(with_both, edits).select(_id("u.").alias("u"), _id("v.").alias("v"))
    return lines, links


def line_classes(rows: DataFrame, edits: int = 1, crowd: int = CROWD) -> DataFrame:
    """Each different line (h1, h2) of ``numbered`` rows that is not alone in its class: ``class_doc``, ``class_at``, ``class_line``, ``class_size``.

    Classes are the components of lines within ``edits`` edits. ``class_doc``, ``class_at`` and ``class_line`` are the first place of any of
    its lines, by ``row_place``, then line number; ``class_size`` counts lines with repeats.
    """
    lines, links = line_links(rows, edits, crowd)
    roots = components(stored(links, "links"))
    lines = lines.select("h1", "h2", "copies", "first", _id().alias("node"))
    named = lines.join(roots, "node", "left").select("h1", "h2", "copies", "first", "node", F.coalesce("component", "node").alias("root"), F.col("component").isNotNull().alias("met"))
    named = stored(named.where("met OR copies > 1"), "classes")
    heads = named.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    return named.join(heads, "root").select(
        "h1", "h2", F.col("head.row.doc_id").alias("class_doc"), F.col("head.row.at").alias("class_at"), F.col("head.line_no").alias("class_line"), "class_size"
    )


def _marked(rows: DataFrame, edits: int, crowd: int) -> DataFrame:
    """As ``marked``, of ``numbered`` rows, with their numbers."""
    places = lines_of(rows).select("doc_id", "at", "line_no", "h1", "h2", "n")
    out = places.join(line_classes(rows, edits, crowd), ["h1", "h2"], "left")
    found = (F.col("n") >= MIN_CHARS) & F.col("class_size").isNotNull()
    first = (F.col("at") == F.col("class_at")) & (F.col("line_no") == F.col("class_line"))
    return out.select(
        "doc_id", "at", "line_no",
        F.when(found, F.col("class_doc")).otherwise(F.col("doc_id")).alias("class_doc"),
        F.when(found, F.col("class_line")).otherwise(F.col("line_no")).alias("class_line"),
        F.when(found, F.col("class_size")).otherwise(F.lit(1)).cast("long").alias("class_size"),
        (~found | first).alias("kept"),
    )


def marked(docs: DataFrame, edits: int = 1, crowd: int = CROWD) -> DataFrame:
    """One row per line of every text: ``doc_id, line_no, class_doc, class_line, class_size, kept``.

    A line stays if it is the first of its class. Lines under ``MIN_CHARS`` characters are classes of their own and stay.
    A null text has no lines, an empty one has one empty line. Every row is a document of its own, also where ids are
    null or shared: of equal rows the lines of one stay. Other columns are not read; an empty table gives no rows.
    """
    return _marked(numbered(docs.select("doc_id", "text")), edits, crowd).drop("at")


def without_repeats(docs: DataFrame, edits: int = 1, crowd: int = CROWD) -> DataFrame:
    """``docs`` without the lines that ``marked`` does not keep. A document of which no line with a word is left goes; one that had none stays.

    Every row is a document of its own, also where ids are null or shared.
    """
    numbers = numbered(docs)
    gone = _marked(numbers, edits, crowd).where("NOT kept").groupBy("at").agg(F.collect_set("line_no").alias("__gone"))
    rows = numbers.select("__row", "at", F.col("__row.text").alias("text")).join(gone, "at", "left")
    text = F.expr(
        "IF(__gone IS NULL, text, array_join(filter(split(text, '\\n'), (x, i) -> NOT array_contains(__gone, CAST(i AS BIGINT))), '\\n'))"
    )
    left = rows.withColumn("__text", text).where(F.col("__gone").isNull() | F.col("__text").rlike(NOT_SPACES))
    return unpacked(left, docs.columns, text=F.col("__text"))
