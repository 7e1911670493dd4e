"""Prefix trie, n-gram join and resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftline.llm import ngram_join, prefix_trie, resample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TURNS = "conv_id long, turn long, role string, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_sequences(rows, graft=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(s)] for c, s in own.items()}
    if not graft:
        return {c: tuple(s) for c, s in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: tuple(own.get(c - c % 100, [])[: h[c]] + s[h[c] :]) for c, s in own.items()}


def plain_trie(seqs):
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        kids[p[:-1]] += bool(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1] if p else "")

    def digest(p, m):
        return hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest()

    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(p, m)) for p, m in members.items()
    )


def trie_rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("fan,texts", [(256, ["a", "bb", ""]), (2, ["a", "bb", ""]), (2, ["a"])])
def test_trie_random(spark, fan, texts):
    rng = random.Random(len(texts) + fan)
    rows = {}
    for conv in rng.sample(range(3000), 300):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows[conv, turn if turn or rng.random() < 0.9 else None] = (rng.choice(["u", None]), rng.choice(texts))
    rows = [(*k, *v) for k, v in rows.items()]
    seqs = prefix_trie.grafted(prefix_trie.sequences(spark.createDataFrame(rows, TURNS)))
    assert trie_rows(prefix_trie.trie(seqs, fan)) == plain_trie(plain_sequences(rows))


def test_trie_hot_and_stairs(spark):
    """One conversation held by a third of all ids, and prefixes of one long conversation, spread over all partitions."""
    rows = [(i, t, "u", f"same {t}") for i in range(400) for t in range(3)]
    rows += [(1000 + n, t, "u", f"step {t}") for n in range(60) for t in range(n + 1)]
    rows += [(2000, t, None, None) for t in range(500)] + [(None, 0, "u", "no id")] * 5
    df = spark.createDataFrame(rows, TURNS).withColumns({c: df_lit(c) for c in ("key", "lens", "d", "part", "seq", "base", "h")})
    got = prefix_trie.shared_prefixes(df)
    want = plain_trie(plain_sequences(rows, graft=False))
    assert trie_rows(got) == want
    texts = prefix_trie.node_turns(got, df).where("conv_id = 1000").collect()
    assert [(r.depth, r.text) for r in sorted(texts, key=lambda r: r.depth)] == [(1, "step 0")]


def df_lit(name):
    from pyspark.sql import functions as F

    return F.lit(f"own {name}")


def test_trie_odd_rows(spark):
    rows = [(7, None, "u", "first"), (7, 3, "u", None), (7, 3, "u", None), (7, 3, None, ""), (107, 0, "u", "x"), (None, 1, "u", "x")]
    df = spark.createDataFrame(rows, TURNS)
    seqs = {r.conv_id: len(r.lens) for r in prefix_trie.sequences(df).collect()}
    assert seqs == {7: 4, 107: 1}
    nodes = prefix_trie.shared_prefixes(df).collect()
    assert len(nodes) == 6 and sum(r.depth == 0 and r.n_convs == 2 and r.parent_conv_id is None for r in nodes) == 1
    nothing = prefix_trie.shared_prefixes(df.where("false"))
    assert nothing.collect() == [] and nothing.dtypes == prefix_trie.shared_prefixes(df).dtypes
    turnless = prefix_trie.trie(prefix_trie.grafted(prefix_trie.sequences(spark.createDataFrame([(301, 0, "u", "x")], TURNS)))).collect()
    h = zlib.crc32(b"301") % 6
    assert len(turnless) == (1 if h else 2)


def plain_set(text, words=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def plain_components(rows, words=5, percent=80):
    sets = {i: plain_set(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_texts(rng, n):
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(n):  # near copies of one text, more than fit any bucket that is compared at once
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 5])):
            copy[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(base[:80] + [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 90]))]) for _ in range(n)]  # a common passage
    for _ in range(n):
        short = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 9, 10, 12, 15, 20, 30]))]
        texts += [" ".join(short), " ".join([*short[:-1], "end"]), " ".join([*short, "end"]).upper()]
    return texts


def test_join_against_all_pairs(spark):
    rows = list(enumerate(near_texts(random.Random(2), 80)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect()}
    want = plain_components(rows)
    assert got == want and sum(c != i for i, (_, c) in want.items()) > 100


@pytest.mark.parametrize("percent", [50, 80, 95])
@pytest.mark.parametrize("level", [0, 1, 2])
def test_similar_sets_share_a_signature(percent, level):
    rng = np.random.default_rng(percent + level)
    for n in [*range(1, 40), 60, 111, 400, 3000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            lost = int(rng.integers(0, n + 1))
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 64, int(rng.integers(0, n + 1)), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
                x, y = (set(ngram_join.signatures(s, percent, level).tolist()) for s in (a, b))
                assert x & y


def test_join_odd_rows(documents, odd, nothing):
    rows = ngram_join.similar_documents(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in documents.collect())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by[i].component_id for i in (1, 2, 3, 15)} == {1}
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (6, 7, 8)) and by[9].n_shingles == 1
    assert {r.component_id for r in rows if r.doc_id is None} == {1, None}
    empty = ngram_join.similar_documents(nothing)
    assert empty.collect() == [] and [t for _, t in empty.dtypes] == ["bigint"] * 3


def test_words_across_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    whole = ngram_join.shingles(text)
    monkeypatch.setattr(ngram_join, "PIECE", 100)
    assert (ngram_join.shingles(text) == whole).all() and len(whole) == 4996


def test_span_crcs():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    spans = [(s := rng.randrange(150_000), s + rng.choice([1, 2, 5, 63, 64, 65, 127, 128, 129, 700])) for _ in range(500)]
    spans += [(0, 200_000), (1, 199_999), (7, 131_079)]
    starts, ends = (np.array(x) for x in zip(*spans))
    got = resample.span_crcs(np.frombuffer(data, dtype=np.uint8), starts, ends)
    assert got.tolist() == [zlib.crc32(data[s:e]) for s, e in spans]
    assert resample.length_constants(np.array([0, 1, 1000])).tolist() == [zlib.crc32(bytes(n)) for n in (0, 1, 1000)]


def plain_draw(docs, target, buckets=10_000, percent=25, least=20, seed=7):
    def hashed(text):
        w = TERM.findall(lower(text))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    rows = [(i, *hashed(t)) for i, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in hashed(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, words, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        ranks[r].append(k + 1)
    return Counter((r[0], *r[2:], ranks[r].pop() if ranks[r] else None) for r in out)


def test_resampling(spark, documents, odd, nothing, monkeypatch):
    target = spark.createDataFrame([("The quick brown fox",), (None,), ("old bridge, at night! x9",)], "text string")
    texts = [r.text for r in target.collect()]
    for options in ({}, {"percent": 60, "least_words": 1, "seed": 3, "buckets": 50}):
        plain = {k.replace("least_words", "least"): v for k, v in options.items()}
        want = plain_draw([(r.doc_id, r.text) for r in documents.collect()], texts, **plain)
        got = resample.resampled(odd, target, **options)
        assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == want
    assert resample.resampled(nothing, target).collect() == []
    kept = resample.keep_drawn(odd, target, percent=60, least_words=1)
    assert kept.columns == odd.columns and kept.count() >= 9
    assert resample.resampled(documents, target.where("false")).count() == documents.count()


def test_pieces_of_long_texts(monkeypatch):
    text = ("Straße 12,x y_z " * 3000).encode()
    whole = resample._features([text, b"", b"a b"], 997)
    monkeypatch.setattr(resample, "PIECE", 64)
    parts = resample._features([text, b"", b"a b"], 997)
    assert all((x == y).all() for x, y in zip(whole, parts))
    assert whole[2].tolist() == [15000, 0, 2]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 40, 64, 65, 500, 3000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 64, n // 10, dtype=np.uint64)]))
        x, y = (ngram_join._folded(ngram_join.parity(s), min(len(ngram_join.parity(a)), len(ngram_join.parity(b)))).view(np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_join_in_blocks_and_levels(spark, monkeypatch):
    """Small blocks and crowds, so that buckets are cut and sets are signed three times."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "CROWD", 12)
    rows = list(enumerate(near_texts(random.Random(4), 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df).collect()}
    assert got == plain_components(rows)
