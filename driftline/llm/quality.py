"""Quality by weak supervision (operator 1).

Rules look at figures of a text and vote good or bad, or abstain. Expectation-maximisation over the counts of all
vote patterns estimates how often each rule is right about good and about bad documents, with no labels;
the posterior probability of being good then decides, not the number of rules passed. The figures
come from one pass over the texts; the patterns are at most three to the power of the number of rules.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import short_batches, slices, stored

BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: characters looked at at a time
BLOCK = 1 << 18

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_letters", "n_upper", "n_distinct_words", "n_lines", "n_ended_lines"]


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds, else abstains. SQL over the figures.

    ``trust`` is the least share of good documents on which a vote of the rule is right: what its
    author knows of it. Without such bounds the likeliest two classes need not be good and bad.
    """

    name: str
    good: str
    bad: str
    trust: float = 0.98


#: shares are compared by products so that empty texts divide by nothing
RULES = [
    Rule("symbols", "n_words >= 20 AND 50 * n_symbols <= n_words", "10 * n_symbols > n_words", 0.998),
    Rule("letters", "n_words >= 20 AND 100 * n_letters >= 75 * n_chars", "100 * n_letters < 60 * n_chars OR n_letters = 0", 0.995),
    Rule("capitals", "n_letters > 0 AND 10 * n_upper <= n_letters", "n_words >= 5 AND 10 * n_upper > 4 * n_letters", 0.998),
    Rule("lines", "n_lines >= 3 AND n_dup_lines = 0", "2 * n_dup_lines > n_lines"),
    Rule("repeats", "n_words >= 40 AND 20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule(
        "distinct",
        "n_words BETWEEN 20 AND 500 AND 20 * n_distinct_words >= 9 * n_words",
        "n_words >= 8 AND (n_words <= 500 AND 4 * n_distinct_words < n_words OR 20 * n_distinct_words < n_words)",
        0.995,
    ),
    Rule("word_length", "2 * word_chars BETWEEN 8 * n_words AND 15 * n_words", "n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)"),
    Rule("line_ends", "n_lines >= 2 AND 10 * n_ended_lines >= 8 * n_lines", "n_lines >= 4 AND 10 * n_ended_lines < 2 * n_lines", 0.9),
]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point 0, 1 for a letter, 2 for a capital letter."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = 2 if kind == "Lu" else 1
    return out


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words found at two or more places.

    Runs are numbered exactly, by pairs of numbered runs of half their length; ``window`` is a power of two.
    """
    if len(words) <= window:
        return 0
    number: dict = {}
    runs = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    size = 1
    while size < window:
        pairs = runs[:-size] * (runs.max() + 1) + runs[size:]
        values, runs = np.unique(pairs, return_inverse=True)
        if len(values) == len(pairs):
            return 0
        size *= 2
    again = np.bincount(runs)[runs] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[: len(again)] += again
    edge[window : window + len(again)] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def figures(text: str | None) -> list[int]:
    """FIGURES and MORE of a whole text; a null text has no words and no lines."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    counts = np.zeros(3, dtype=np.int64)
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        counts += np.bincount(_kinds()[points], minlength=3)
    return [
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text),
        int(counts[1] + counts[2]),
        int(counts[2]),
        len(set(words)),
        len(lines),
        sum(x.rstrip(BLANKS)[-1] in ".!?\"'»”)" for x in lines),
    ]


def figures_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the figures, a row for every row."""
    names = [*FIGURES, *MORE]

    def work(batches):
        for batch in slices(batches):
            table = np.array([figures(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, table.T.copy())], ["doc_id", *names])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def vote(rule: Rule) -> Column:
    """1 good, -1 bad, 0 abstains."""
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


@dataclass
class Estimate:
    """Share of good documents, and how often each rule that votes is right about good and about bad ones."""

    good: float
    right_on_good: np.ndarray
    right_on_bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        a, b = self.right_on_good, self.right_on_bad
        good = np.log(self.good) + np.where(votes > 0, np.log(a), np.where(votes < 0, np.log(1 - a), 0)).sum(axis=1)
        bad = np.log(1 - self.good) + np.where(votes < 0, np.log(b), np.where(votes > 0, np.log(1 - b), 0)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def estimate(votes: np.ndarray, counts: np.ndarray, trust: np.ndarray, rounds: int = 200, tolerance: float = 1e-10) -> Estimate:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how many documents have them.

    ``trust`` bounds from below how often a rule is right about good documents, so the classes can't swap.
    """
    m = votes.shape[1]
    # the start: a vote is mostly right about good documents; one rule seldom sees all bad ones
    now = Estimate(0.8, trust.copy(), np.full(m, 0.5))
    if not counts.sum():
        return now
    for _ in range(rounds):
        p = now.posterior(votes)
        g, b = counts * p, counts * (1 - p)
        voted = votes != 0
        right_g = (g @ (votes > 0) + 1.9) / (g @ voted + 2)
        right_b = (b @ (votes < 0) + 1) / (b @ voted + 2)
        new = Estimate(
            float(np.clip((g.sum() + 4) / (counts.sum() + 5), 0.02, 0.98)),
            np.clip(right_g, trust, 1 - 1e-4),
            np.clip(right_b, 1e-3, 1 - 1e-4),
        )
        moved = max(abs(new.good - now.good), np.abs(new.right_on_good - now.right_on_good).max(), np.abs(new.right_on_bad - now.right_on_bad).max())
        now = new
        if moved < tolerance:
            break
    return now


def rated(docs: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the base figures, ``base_failed``, ``quality`` and ``kept``.

    ``quality`` is the posterior probability of being good. ``base_failed`` (fewer than 20 words, or over 30
    of 100 words in repeated windows) settles the matter; else ``kept`` is quality >= ``threshold``. Null and empty
    texts have no words and fail. Repeated rows get equal results; an empty table gives none; columns other than
    ``doc_id`` and ``text`` are not read.
    """
    rules = RULES if rules is None else rules
    spark = docs.sparkSession
    names = [f"vote_{r.name}" for r in rules]
    pattern = F.lit(0).cast("long")
    for r in rules:
        pattern = pattern * 3 + vote(r) + 1
    rows = stored(figures_of(docs).withColumns({**{n: vote(r) for n, r in zip(names, rules)}, "pattern": pattern}), "figures")
    found = rows.groupBy("pattern").count().collect()  # at most 3 ** len(rules) rows
    votes = np.array([_votes(r["pattern"], len(rules)) for r in found]).reshape(-1, len(rules))
    model = estimate(votes, np.array([r["count"] for r in found], dtype=float), np.array([r.trust for r in rules]))
    quality = model.posterior(votes).tolist() if found else []
    table = spark.createDataFrame([(r["pattern"], q) for r, q in zip(found, quality)], "pattern long, quality double")
    base_failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words")
    return rows.join(F.broadcast(table), "pattern").select(
        "doc_id", *FIGURES, base_failed.alias("base_failed"),
        (~base_failed & (F.col("quality") >= threshold)).alias("kept"), "quality", *names,
    )


def _votes(pattern: int, rules: int) -> list[int]:
    return [pattern // 3 ** (rules - 1 - i) % 3 - 1 for i in range(rules)]
