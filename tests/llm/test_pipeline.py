"""Each stage of the pipeline against a plain version of it, on what the stage before kept."""

import hashlib
import re
import struct
from collections import Counter

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from driftline.llm import langid, mix
from driftline.llm.common import stored
from tests.llm.test_methods import plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Documents before and after each stage, by its name."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def groups(items, near):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if near(a, b):
                root[find(a)] = find(b)
    return {x: find(x) for x in items}


def test_columns_and_order(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "source_mix", "bpe_round_trip"]
    for n in names[:-1]:
        assert steps[n][1].columns == steps[n][0].columns


def test_language(steps):
    before, after = steps["language_id"]
    model = langid.train(before)
    want = {r.doc_id for r in before.collect() if model.predict(r.text)[1] >= 0.5}
    assert {r.doc_id for r in after.collect()} == want and want


def test_lines(steps):
    before, after = steps["line_dedup"]
    rows = {r.doc_id: r.text for r in before.collect()}
    norm = {(d, i): re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ") for d, t in rows.items() for i, x in enumerate(t.split("\n"))}
    long = sorted({x for x in norm.values() if len(x) >= 20})

    def near(a, b):  # one edit: what is not common at both ends has at most one character
        if abs(len(a) - len(b)) > 1:
            return False
        n = min(len(a), len(b))
        p = next((i for i in range(n) if a[i] != b[i]), n)
        s = next((i for i in range(n - p) if a[-1 - i] != b[-1 - i]), n - p)
        return max(len(a), len(b)) - p - s <= 1

    root = groups(long, near)
    first: dict = {}
    for place in sorted(norm):
        if norm[place] in root:
            first.setdefault(root[norm[place]], place)
    want = {}
    for d, t in rows.items():
        lines = t.split("\n")
        left = [x for i, x in enumerate(lines) if norm[d, i] not in root or first[root[norm[d, i]]] == (d, i)]
        if len(left) == len(lines) or re.search(r"[^\x20\x09-\x0D]", "\n".join(left)):
            want[d] = "\n".join(left)
    assert {r.doc_id: r.text for r in after.collect()} == want and len(want) < len(rows)


def test_near_duplicates(steps):
    before, after = steps["simhash_near_dedup"]
    fps = {r.doc_id: plain_fingerprint(r.text) for r in before.collect()}
    root = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    heads: dict = {}
    for d in sorted(fps):
        heads.setdefault(root[d], d)
    assert sorted(r.doc_id for r in after.collect()) == sorted(heads.values())


def test_mix(steps):
    before, after = steps["source_mix"]
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in before.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    goal, want = mix.targets(list(sizes.items())), Counter()
    for source, size in sizes.items():
        whole, rest = divmod(int(goal[source]), size)
        before_ = 0
        own = [(hashlib.md5(f"mix-0:{d}".encode()).hexdigest(), n, d) for d, s, n in rows if s == source]
        for _, n, d in sorted(own):
            want[d] += whole + (before_ < rest and 2 * before_ + n <= 2 * rest)
            before_ += n
    assert Counter(r.doc_id for r in after.collect()) == +want


def test_encoding(steps, tokenizer):
    before, after = steps["bpe_round_trip"]
    library = Tokenizer.from_file(tokenizer)
    want = Counter()
    for r in before.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect()) == want
