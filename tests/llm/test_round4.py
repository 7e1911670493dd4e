"""Edits whose tokens are counted together, patterns by range of characters, and joins by rare features."""

import random
from itertools import combinations

import numpy as np
import pytest

from driftline.llm import bpe, edits, ngram_join

TEXTS = ["it's 12 o'clock now, isn't it?", "Straße ½² aªb\u0085\u0085 c", "Жук ١٢ 　　x 你好'll", "\U0001f600 \U00010330\U00010331 \U0001d7d8'd ", "  \t\n a\n\n ", ""]


def test_patterns_by_range_agree():
    rng = random.Random(1)
    chars = "".join(TEXTS) + "' sdtmrevl"
    for _ in range(300):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        want = bpe.patterns()["piece"].findall(text)
        for below in (bpe.BASIC, bpe.LATIN):
            if all(ord(c) < below for c in text):
                assert bpe.patterns(below)["piece"].findall(text) == want
        assert bpe.Pieces.find(None, text) == want
    assert [bpe._below(t) for t in TEXTS] == [bpe.LATIN, bpe.LATIN, bpe.BASIC, bpe.ALL, bpe.LATIN, bpe.LATIN]


def trees_of(texts, pieces):
    out = []
    for text, (chars, tokens) in zip(texts, edits.leaves_of(texts, pieces)):
        ends = [0, *chars.cumsum().tolist()]
        out.append(edits.Tree([(text[a:b], int(n)) for a, b, n in zip(ends, ends[1:], tokens)], pieces))
    return out


def test_new_words_of_all_documents_are_encoded_together(tokenizer, monkeypatch):
    """No word that fits the cache is merged alone, and the counts are those of whole texts."""
    texts = [f"document {i} has some words{i} of its own " * 40 for i in range(20)]
    pieces = bpe.Pieces(bpe.MergeTable(tokenizer))
    trees = trees_of(texts, pieces)
    monkeypatch.setattr(pieces.table, "merge", lambda data: pytest.fail(f"{data} was merged alone"))
    for i, tree in enumerate(trees):
        tree.edit(7 * i, 3, f" fresh{i}x")
        tree.edit(9 * i + 100, 0, f"{i}other word")
    got = edits.counted_together(trees, pieces)
    monkeypatch.undo()
    whole = ["".join(leaf.text for leaf in edits.walk(tree.root)) for tree in trees]
    assert got == [len(bpe.encode(text, tokenizer)) // 4 for text in whole] and got == [tree.tokens for tree in trees]


def test_full_cache_is_filled_together(tokenizer, monkeypatch):
    """Pieces that were known before the cache was emptied are encoded with the others."""
    pieces = bpe.Pieces(bpe.MergeTable(tokenizer))
    known, more = {f" known{i}" for i in range(30)}, {f" more{i}" for i in range(30)}
    pieces.ready(known)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 150)
    monkeypatch.setattr(pieces.table, "merge", lambda data: pytest.fail(f"{data} was merged alone"))
    pieces.ready(known | more)
    assert all(t in pieces for t in known | more)


def sets_with_a_passage(rng, n):
    """Sorted feature sets that share 300 of 400 features, and one near copy of each."""
    passage = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 64, 100, dtype=np.uint64)])) for _ in range(n)]
    return passage, sets, [np.unique(np.concatenate([s[20:], rng.integers(0, 1 << 64, 20, dtype=np.uint64)])) for s in sets]


@pytest.mark.parametrize("level", [0, 1, 2])
def test_common_passages_sign_nothing(level):
    rng = np.random.default_rng(level)
    passage, sets, near = sets_with_a_passage(rng, 30)
    late = np.sort(passage), np.full(300, 30)
    signed = [set(ngram_join.signatures(s, 80, level, late).tolist()) for s in sets]
    assert all(len(x) == 81 and not x & set(passage.tolist()) for x in signed)
    assert all(x & set(ngram_join.signatures(s, 80, level, late).tolist()) for x, s in zip(signed, near))
    assert not any(a & b for a, b in combinations(signed, 2))


def test_frequent_features_are_counted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "KNOWN", 50)
    rows = [(i, "one common passage of several words that all of them have " + f"own{i} " * 6) for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    features, sets = ngram_join._frequent(docs, 40, 5)
    common = ngram_join.shingles(b"one common passage of several words that all of them have")
    assert set(common.tolist()) <= set(features.tolist()) and (np.diff(features.astype(float)) > 0).all() and sets.min() >= 3


def test_a_passage_in_all_documents_makes_few_pairs(spark, monkeypatch):
    """Pairs that are looked at do not grow with the square of the documents that share a passage, and no link is lost."""
    seen = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda docs, pairs, *rest: (seen.append(pairs.distinct().count()), verified(docs, pairs, *rest))[1])
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(150))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))) for i in range(300)]
    rows += [(1000 + i, text.rsplit(" ", 3)[0] + " a b c") for i, text in rows[:40]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(df).collect()}
    assert got == {i: i % 1000 if i >= 1000 else i for i, _ in rows}
    assert sum(seen) < 200


def test_join_without_links(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (3, None), (4, "A B c d e f g"), (None, "o p")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect()}
    assert got == {1: (3, 1), 4: (3, 1), 2: (3, 2), 3: (0, 3), None: (1, None)}


@pytest.mark.parametrize("split", [60, 25])
def test_small_sets_of_a_bucket_do_not_blunt_the_sketches(split):
    """All similar pairs are found, and large sets that are not similar are told apart beside small ones."""
    rng = np.random.default_rng(7)
    sets = []
    for n in [3, 60, 70, 130, 140, 500, 520, 2000, 2100, 300]:
        base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[int(n * d) :], rng.integers(0, 1 << 64, int(n * d), dtype=np.uint64)])) for d in (0, 0.02, 0.05, 0.08, 0.3, 0.9)]
    order = rng.permutation(len(sets))
    columns = [list(range(60)), [len(sets[i]) for i in order], list(range(60)), [ngram_join.parity(sets[i]).tolist() for i in order]]
    a, b = ngram_join._near(columns, split, 80)
    got = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    assert len(got) == len(a)
    pairs = [(i, j) for i, j in combinations(range(60), 2) if split == 60 or i < split <= j]
    shared = {(i, j): len(np.intersect1d(sets[order[i]], sets[order[j]])) for i, j in pairs}
    want = {(i, j) for (i, j), n in shared.items() if 100 * n >= 80 * (columns[1][i] + columns[1][j] - n)}
    assert want and want <= got and len(got) < len(want) + 40


def near_misses(rng, families, each):
    """Ids and texts of families whose members differ in three words each, so that two are just not similar, and a copy of every eighth with one word more."""
    rows = []
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(214)]
        for _ in range(each):
            text = list(base)
            for at in rng.sample(range(5, 209, 5), 3):
                text[at] = f"x{rng.randrange(10**9)}"
            rows.append(" ".join(text))
            if len(rows) % 8 == 0:
                rows.append(" ".join([*text, "more"]))
    return list(enumerate(rows))


def components_of(sets):
    """Smallest place that each of the sets reaches, by all pairs."""
    root = list(range(len(sets)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, j in combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[i], sets[j]))
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("limits", [{}, {"HELD": 2500}, {"CHAIN": 20, "CROWD": 30, "BLOCK": 9}])
def test_near_misses_do_not_leave_their_group(spark, monkeypatch, limits):
    """Pairs that are looked at outside a group grow with the rows, not with the square of a family, and no link is lost."""
    seen = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda docs, pairs, *rest: (seen.append(pairs.distinct().count()), verified(docs, pairs, *rest))[1])
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_misses(random.Random(9), 2, 80)
    sets = [ngram_join.shingles(text.encode()) for _, text in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect()}
    want = components_of(sets)
    assert got == {i: (len(sets[i]), want[i]) for i, _ in rows}
    assert len(rows) > len(set(want)) > len(rows) // 3
    assert max(seen) < 8 * len(rows), seen


@pytest.mark.parametrize("split", [90, 30])
def test_chains_connect_what_all_pairs_connect(split):
    """Fewer pairs than rows leave a group; they connect the same rows, with and without a look at the features."""
    sets = [ngram_join.shingles(text.encode()) for _, text in near_misses(random.Random(3), 1, 79)]
    rows = len(sets)
    columns = [list(range(rows)), [len(s) for s in sets], list(range(rows)), [ngram_join.parity(s) for s in sets]]
    everything = list(zip(*(x.tolist() for x in ngram_join._near(columns, split, 80))))
    alike = ngram_join._links(sets, 80)
    similar = [(i, j) for i, j in everything if alike(i, np.array([j]))[0]]
    assert all(alike(i, np.array([j]))[0] == (100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))) for i, j in everything)

    def groups(pairs):
        root = list(range(rows))
        for _ in range(rows):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert rows == 90 and len(everything) > 200
    for links, want in ((None, everything), (alike, similar)):
        a, b = ngram_join._near(columns, split, 80, np.arange(rows), links)
        assert 0 < len(a) < rows and set(zip(a.tolist(), b.tolist())) <= set(want)
        assert groups(list(zip(a.tolist(), b.tolist()))) == groups(want)
