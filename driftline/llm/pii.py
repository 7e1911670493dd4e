"""Personal data by weak supervision (operator 10).

Patterns propose spans. Labelers then vote on each: its pattern, a checksum or format test, a gazetteer, the
words before it, and how it is set in the text. Expectation-maximisation over the counts of vote patterns, for each
kind of span, estimates the labelers' reliabilities; its posteriors are the soft labels on which a
logistic regression over kinds and votes is trained, the final classifier of spans. Spans of the base
patterns stay whatever it says; it decides on the others.

One pass over the texts leaves a short row per document; models are fitted on counts of patterns, of which there is a
fixed number, and a second pass over the short rows applies them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import short_batches, slices, stored
from driftline.llm.quality import estimate

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
LABELERS = ["pattern", "test", "gazetteer", "context", "setting"]
#: least share of true spans on which a labeler's vote is right
TRUST = np.array([0.6, 0.98, 0.6, 0.6, 0.9])
#: code points before a span in which context words count
BEFORE = 40

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails at the first digit of a run fails at the others too, so only first digits are tried
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

SPOKEN_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?(?:\(at\)|\[at\])[\x20]?[A-Za-z0-9-]{1,63}"
    r"(?:[\x20]?(?:\(dot\)|\[dot\]|\.)[\x20]?[A-Za-z0-9-]{1,63}){1,4}"
)
IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
BARE_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])")
SECRET = re.compile(r"([A-Za-z_]{2,32})[\x20]?[=:][\x20]?[\"']([A-Za-z0-9+/_=-]{16,512})[\"']")

ENDINGS = frozenset("com org net edu gov mil int info io biz de fr es it uk eu nl be ch at us ca au jp cn in br ru pl se".split())
COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split())
SECRET_NAMES = re.compile(r"(?i)token|secret|passw|api_?key|auth|credential")
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|contact|write|reply|from|to)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|client)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|cell|whatsapp)\b"),
    "secret": SECRET_NAMES,
}
COUNTER = re.compile(r"(?i)\b(?:version|release|isbn|order|invoice|page|section|build|serial|ticket)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def octets(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base pattern that do not overlap, in time linear in the text."""
    done, at, seen = 0, text.find("@"), -1
    while at >= 0:
        left = text[max(done, seen + 1) : at][::-1]
        local, domain = LOCAL.match(left), DOMAIN.match(text, at + 1)
        if local and domain:
            yield at - local.end(), domain.end()
            done = domain.end()
        seen, at = at, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base patterns that pass their tests, by kind and start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = only_digits(m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def more_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates beyond the base: looser patterns, and what failed a base test."""
    if "at" in text and ("(at)" in text or "[at]" in text):
        yield from (("email", *m.span()) for m in SPOKEN_EMAIL.finditer(text))
    if DIGIT.search(text):
        if "." in text:
            yield from (("ip", *m.span()) for m in IP.finditer(text) if not octets(m[0]))
        if ":" in text:
            yield from (("ip", *m.span()) for m in IP6.finditer(text))
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(only_digits(m[0])) <= 19:
                yield ("card", *m.span())
        yield from (("phone", *m.span()) for m in BARE_PHONE.finditer(text))
    if '"' in text or "'" in text:
        yield from (("secret", *m.span(2)) for m in SECRET.finditer(text))


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def votes(text: str, kind: str, a: int, b: int, base: bool) -> list[int]:
    """What each labeler says of a span: 1 personal, -1 not, 0 nothing."""
    span, before = text[a:b], text[max(0, a - BEFORE) : a]
    digits = only_digits(span) if kind in ("card", "phone") else ""
    if kind == "email":
        ending = re.split(r"[.)\]\x20]+", span)[-1].lower()
        test = 1 if ending.isalpha() and 2 <= len(ending) <= 24 else -1
        known = 1 if ending in ENDINGS else 0
    elif kind == "ip":
        test = 1 if ":" in span or octets(span) else -1
        known = -1 if span.startswith(("0.", "127.")) else 0
    elif kind == "card":
        test = 1 if luhn(digits) else -1
        known = 1 if digits[0] in "3456" else -1
    elif kind == "phone":
        test = 1 if 10 <= len(digits) <= 15 else -1 if len(digits) < 7 else 0
        known = 1 if span[0] != "+" or any(digits.startswith(c) for c in COUNTRIES) else -1
    else:
        test = 1 if entropy(span) >= 3 else -1
        known = 1 if SECRET_NAMES.search(before) else 0
    context = 1 if CONTEXT[kind].search(before) else -1 if COUNTER.search(before) else 0
    edge = (before[-1:].isalnum() and span[:1].isalnum()) or text[b : b + 1].isalnum()
    return [1 if base else 0, test, known, context, -1 if edge else 1]


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """Kind, start, end, whether it is a base span, and its vote pattern. Others never overlap a base span; they may overlap each other."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    out = [(kind, a, b, True) for kind, a, b in base]
    others = sorted(set(more_spans(text)) - set(base), key=lambda s: (s[1], -s[2], s[0]))
    i = 0
    for kind, a, b in others:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not any(x < b and a < y for x, y in taken[i : i + 4]):
            out.append((kind, a, b, False))
    out.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return [(KINDS.index(k), a, b, f, pattern(KINDS.index(k), votes(text, k, a, b, f))) for k, a, b, f in out]


def settled(spans: list[dict], chance: dict[int, float], threshold: float) -> list[dict]:
    """Base spans, and of the others that reach ``threshold`` those that no likelier one overlaps; of equals the longer, then the earlier."""
    likely = [s for s in spans if not s["base"] and chance[s["code"]] >= threshold]
    likely.sort(key=lambda s: (-chance[s["code"]], s["start"] - s["stop"], s["start"], s["kind"]))
    starts, stops, out = [], [], {(s["kind"], s["start"], s["stop"]) for s in spans if s["base"]}
    for s in likely:
        i = bisect_right(stops, s["start"])
        if i == len(starts) or starts[i] >= s["stop"]:
            starts.insert(i, s["start"])
            stops.insert(i, s["stop"])
            out.add((s["kind"], s["start"], s["stop"]))
    return [s for s in spans if (s["kind"], s["start"], s["stop"]) in out]


def pattern(kind: int, v: list[int]) -> int:
    out = kind
    for x in v:
        out = out * 3 + x + 1
    return out


def unpacked(code: int) -> tuple[int, list[int]]:
    v = []
    for _ in LABELERS:
        code, x = divmod(code, 3)
        v.append(x - 1)
    return code, v[::-1]


def features(code: int) -> np.ndarray:
    """For the classifier: the kind, each vote for and against, and each vote for together with the kind."""
    kind, v = unpacked(code)
    one = np.zeros(len(KINDS))
    one[kind] = 1
    v = np.array(v)
    return np.concatenate((one, v > 0, v < 0, np.outer(one, v > 0).ravel())).astype(float)


def classifier(codes: list[int], counts: np.ndarray) -> dict[int, float]:
    """Probability of each vote pattern by the final classifier, trained on the posteriors of the labelers' model."""
    if not codes:
        return {}
    kinds = np.array([unpacked(c)[0] for c in codes])
    votes_ = np.array([unpacked(c)[1] for c in codes])
    soft = np.zeros(len(codes))
    for k in set(kinds.tolist()):
        own = kinds == k
        soft[own] = estimate(votes_[own], counts[own], TRUST).posterior(votes_[own])
    x, weight = np.array([features(c) for c in codes]), counts / counts.sum()
    w, penalty = np.zeros(x.shape[1]), 1e-4
    for _ in range(50):  # Newton steps of the penalised log-likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (soft - p)) - penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


CANDIDATES = "array<struct<kind: int, start: long, stop: long, base: boolean, code: long>>"


def found(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the candidate spans of the whole text; a null text has none."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("code", pa.int64())]))
    names = ["kind", "start", "stop", "base", "code"]

    def work(batches):
        for batch in slices(batches):
            spans = [[dict(zip(names, c)) for c in candidates(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, f"doc_id long, spans {CANDIDATES}")


def personal(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: base counts by kind, a digest of the base spans, all spans, and how many were added.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind as in KINDS, then start. Null and empty texts
    have none. Repeated rows get equal results; an empty table gives none; other columns are not read.
    """
    rows = stored(found(docs), "spans")
    seen = rows.select(F.explode("spans.code").alias("code")).groupBy("code").count().collect()  # kinds times 3 ** labelers at most
    seen.sort(key=lambda r: r["code"])
    chance = classifier([r["code"] for r in seen], np.array([r["count"] for r in seen], dtype=float))

    def work(batches):
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                kept = [(s["base"], KINDS[s["kind"]], f"{KINDS[s['kind']]}:{s['start']}:{s['stop']}") for s in settled(spans, chance, threshold)]
                base = [x for x in kept if x[0]]
                counts = Counter(x[1] for x in base)
                digest = hashlib.sha256(",".join(x[2] for x in base).encode()).hexdigest()
                out.append((*(counts[k] for k in BASE_KINDS), digest, ",".join(x[2] for x in kept), len(kept) - len(base)))
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"],
            )

    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return rows.mapInArrow(work, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
