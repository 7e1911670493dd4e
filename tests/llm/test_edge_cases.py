"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

from collections import Counter

import corpus_pipeline
import pytest

from driftline.llm import bpe, edits, exact, langid, lines, mix, pii, quality, simhash, token_files


def by_operator(path):
    return {
        "op1": quality.rated,
        "op2": lambda d: token_files.written_tokens(d, path),
        "op3": lambda d: bpe.round_trip(d, path),
        "op4": langid.identified,
        "op5": lines.marked,
        "op6": exact.exact_groups,
        "op7": simhash.near_duplicates,
        "op8": lambda d: edits.counted(d, path),
        "op9": mix.mixed,
        "op10": pii.personal,
    }


@pytest.mark.parametrize("op", [f"op{i}" for i in range(1, 11)])
def test_operator(op, documents, odd, nothing, tokenizer):
    fn = by_operator(tokenizer)[op]
    got = fn(odd)
    rows = got.collect()
    ids = Counter(r.doc_id for r in rows)
    if op == "op5":
        assert set(ids) == {r.doc_id for r in documents.where("text IS NOT NULL").collect()}
    else:  # a row for every row
        assert ids == Counter(r.doc_id for r in documents.collect())
    empty = fn(nothing)
    assert empty.collect() == [] and empty.dtypes == got.dtypes


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, name, stage, documents, odd, nothing):
    got = stage(spark, odd, None)
    rows = got.collect()
    assert rows and stage(spark, nothing, None).collect() == []
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == odd.columns
        assert all(r["root"] == "own root" and r["fingerprint"] == "own fingerprint" for r in rows)
        before = {(r.doc_id, r.lang, r.source, r.n_chars) for r in documents.collect()}
        assert {(r.doc_id, r.lang, r.source, r.n_chars) for r in rows} <= before


def test_exact_ties(documents):
    rows = exact.exact_groups(documents).collect()
    kept = Counter((r.doc_id, r.kept) for r in rows)
    assert kept[1, True] == 1 and kept[2, False] == 1 and kept[3, False] == 1
    assert kept[10, True] == 1 and kept[10, False] == 1  # a repeated row
    nameless = [r for r in rows if r.doc_id is None]
    assert Counter((r.keep_id, r.kept) for r in nameless) == {(1, False): 1, (None, True): 1}
    assert {r.keep_id for r in rows if r.doc_id in (6, 7)} == {6}  # null is empty


def test_simhash_ties(spark, documents):
    kept = simhash.keep_first(documents).collect()
    assert Counter(r.doc_id for r in kept if r.doc_id is not None).most_common(1)[0][1] == 1
    assert 2 not in {r.doc_id for r in kept} and sum(r.doc_id is None for r in kept) == 1
    assert {6, 7, 8} & {r.doc_id for r in kept} == {6}  # without words: one group


def test_lines_repeat_first_stays(documents):
    rows = {(r.doc_id, r.line_no): r for r in lines.marked(documents).collect()}
    assert rows[1, 0].kept and not rows[2, 0].kept and not rows[10, 0].kept and not rows[10, 2].kept
    assert rows[2, 0].class_doc == 1 and rows[2, 0].class_size == rows[1, 0].class_size
    assert rows[11, 1].kept  # an empty line
    left = {r.doc_id for r in lines.without_repeats(documents).collect()}
    assert {1, 6, 7, 8} <= left and 2 not in left


def test_rows_with_null_or_shared_ids(spark):
    """A repeat in one row takes nothing from another row of the same id, and copies without an id go."""
    a, b, c, d = (f"{w} line of the text that is long enough" for w in ("first", "another", "yonder", "whichever"))
    rows = [(1, a), (None, f"{b}\n{a}"), (None, f"{c}\nown words {c}"), (7, f"{d}\n{a}"), (7, f"seven {d} seven\neight {b} eight"), (None, "x " + d * 2), (None, "x " + d * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = Counter((r.doc_id, r.text) for r in lines.without_repeats(docs).collect())
    assert left == Counter([(1, a), (None, b), rows[2], (7, d), rows[4], rows[5]])
    kept = Counter((r.doc_id, r.line_no, r.kept) for r in lines.marked(docs.where("doc_id IS NULL")).collect())
    assert kept == Counter([(None, 0, True)] * 3 + [(None, 0, False)] + [(None, 1, True)] * 2)


def test_near_duplicates_with_null_or_shared_ids(spark):
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c", "d")]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (2, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_first(docs).collect())
    assert kept == Counter([rows[0], rows[1], rows[2], rows[4]])


def test_language_rejects(documents):
    found = {r.doc_id: r for r in langid.identified(documents).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (6, 7, 8, 9))
    assert {found[i].lang_pred for i in (1, 4)} <= {"en", "de", "und"}
    blind = langid.identified(documents.withColumn("lang", documents.lang.substr(1, 0)).where("false"))
    assert blind.collect() == []
    assert langid.train(documents.where("lang IS NULL")).langs == []
