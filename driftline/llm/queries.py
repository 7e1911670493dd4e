"""Queries of the operators here, over whole tables, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: tokenizer file of the encoding queries: one of the public ones installed with Python
TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op2_token_files")
def op2(spark, sf_dir):
    from driftline.llm.token_files import written_tokens

    return written_tokens(documents(spark, sf_dir), tokenizer_path(), end_id=2)


@query("op3_bpe_round_trip")
def op3(spark, sf_dir):
    from driftline.llm.bpe import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_path())


@query("op7_simhash_groups")
def op7(spark, sf_dir):
    from driftline.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


@query(
    "op6_exact_groups",
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
         g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
)
def op6(spark, sf_dir):
    from driftline.llm.exact import exact_groups

    return exact_groups(documents(spark, sf_dir))


@query("op1_quality_rules")
def op1(spark, sf_dir):
    from driftline.llm.quality import rated

    return rated(documents(spark, sf_dir))


@query(
    "op9_source_mix",
    r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               md5(concat('mix-0:', coalesce(doc_id::VARCHAR, 'null'))) AS place
        FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
    w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY 2::DOUBLE * source_size / w, k) AS pos FROM w),
    c AS (
        SELECT *, total - coalesce(sum(2 * source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
               sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
        FROM r),
    f AS (SELECT arg_min(room, pos) AS room, arg_min(left_w, pos) AS left_w, min(pos) AS pos FROM c WHERE room * w / left_w <= 2 * source_size),
    t AS (
        SELECT c.source, c.source_size,
               CASE WHEN c.pos < f.pos THEN 2::DOUBLE * c.source_size ELSE f.room * c.w / f.left_w::DOUBLE END AS target
        FROM c, f),
    e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target)::BIGINT // source_size END AS whole FROM t),
    o AS (
        SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.whole, floor(e.target)::BIGINT - e.whole * e.source_size AS rest,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target, source,
           (size * (whole + CASE WHEN rest > before AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM o
    """,
)
def op9(spark, sf_dir):
    from driftline.llm.mix import mixed

    return mixed(documents(spark, sf_dir))


@query("op4_language_id")
def op4(spark, sf_dir):
    from driftline.llm.langid import identified

    return identified(documents(spark, sf_dir))


@query("op10_personal_data")
def op10(spark, sf_dir):
    from driftline.llm.pii import personal

    return personal(documents(spark, sf_dir))


@query(
    "op5_line_dedup",
    r"""
    WITH RECURSIVE raw AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, line_no, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw),
    d AS (
        SELECT line, length(line) AS n, count(*) AS copies, min({'d': doc_id, 'l': line_no}) AS first
        FROM l WHERE length(line) >= 20 GROUP BY line),
    c AS (
        SELECT a.line AS a, b.line AS b FROM d a JOIN d b ON left(a.line, 10) = left(b.line, 10) AND abs(a.n - b.n) <= 1 AND a.line < b.line
        UNION SELECT a.line, b.line FROM d a JOIN d b ON right(a.line, 10) = right(b.line, 10) AND abs(a.n - b.n) <= 1 AND a.line < b.line),
    e AS (
        SELECT a, b FROM c
        WHERE len(list_filter(range(0, greatest(length(a), length(b))), lambda i:
            left(a, i) = left(b, i)
            AND right(a, length(a) - i - CASE WHEN length(a) >= length(b) THEN 1 ELSE 0 END)
              = right(b, length(b) - i - CASE WHEN length(b) >= length(a) THEN 1 ELSE 0 END))) > 0),
    s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT a AS line, a AS other FROM s UNION SELECT r.line, s.b FROM r JOIN s ON r.other = s.a),
    t AS (SELECT line, min(other) AS root FROM r GROUP BY line),
    g AS (SELECT d.*, coalesce(t.root, d.line) AS root FROM d LEFT JOIN t USING (line)),
    h AS (SELECT root, min(first) AS head, sum(copies)::BIGINT AS class_size FROM g GROUP BY root)
    SELECT l.doc_id, l.line_no::BIGINT AS line_no, coalesce(h.head.d, l.doc_id) AS class_doc,
           coalesce(h.head.l, l.line_no)::BIGINT AS class_line, coalesce(h.class_size, 1)::BIGINT AS class_size,
           h.head IS NULL OR (h.head.d = l.doc_id AND h.head.l = l.line_no) AS kept
    FROM l LEFT JOIN g USING (line) LEFT JOIN h USING (root)
    """,
)
def op5(spark, sf_dir):
    from driftline.llm.lines import marked

    return marked(documents(spark, sf_dir))


@query("op8_edited_token_counts")
def op8(spark, sf_dir):
    from driftline.llm.edits import counted

    return counted(documents(spark, sf_dir), tokenizer_path())


@query(
    "op11_prefix_trie",
    r"""
    WITH crc AS (
        SELECT list_transform(range(256), lambda x: list_reduce(
            [x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
    own AS (
        SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    head AS (
        SELECT conv_id, s, conv_id - conv_id % 100 AS base,
               xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
        FROM own, crc),
    r AS (SELECT a.conv_id, coalesce(b.s[:a.h], []) || a.s[a.h + 1:] AS s FROM head a LEFT JOIN own b ON b.conv_id = a.base),
    p AS (SELECT conv_id, s[:d] AS path, d, len(s) AS n FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
    node AS (
        SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE length(path[-1].text) END) AS saved,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
        FROM p GROUP BY path, d),
    kids AS (SELECT path[:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
    full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
    under AS (
        SELECT path[:a] AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
        FROM (SELECT path, n_children, saved, unnest(range(0, d + 1)) AS a FROM full_node) GROUP BY 1)
    SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, under.n_leaves, under.saved_tokens, f.ends_sha256
    FROM full_node f JOIN under USING (path) LEFT JOIN node up ON f.d > 0 AND up.path = f.path[:f.d - 1]
    """,
)
def op11(spark, sf_dir):
    from driftline.llm.prefix_trie import grafted, sequences, trie

    return trie(grafted(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


@query(
    "op13_target_resampling",
    r"""
    WITH crc AS (
        SELECT list_transform(range(256), lambda x: list_reduce(
            [x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
    texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
    w AS (
        SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM texts),
    f AS (
        SELECT side, doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS feature FROM w),
    n AS (SELECT side, doc_id, feature, count(*) AS n FROM f GROUP BY ALL),
    names AS (
        SELECT feature, xor(list_reduce([4294967295::BIGINT] || list_transform(
                   range(0, octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
        FROM (SELECT DISTINCT feature FROM n), crc),
    b AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM n JOIN names USING (feature) GROUP BY bucket),
    a AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM b),
    g AS (
        SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE
                                       / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS gain
        FROM b, a),
    v AS (
        SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
        FROM n JOIN names USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
    x AS (
        SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               ('0x' || sha256(concat('7:', doc_id))[:8])::BIGINT AS h
        FROM w LEFT JOIN v USING (doc_id) WHERE side = 'd'),
    y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
    z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 25 // 100 AS k FROM y WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM y LEFT JOIN z USING (doc_id)
    """,
)
def op13(spark, sf_dir):
    from driftline.llm.resample import resampled

    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(
    "op12_ngram_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM w),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
    l AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
    SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(other) AS component_id FROM s JOIN r USING (doc_id) GROUP BY doc_id
    """,
)
def op12(spark, sf_dir):
    from driftline.llm.ngram_join import similar_documents

    return similar_documents(documents(spark, sf_dir))
