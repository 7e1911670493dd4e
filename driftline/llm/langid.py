"""Language identification (operator 4).

A text becomes the TF-IDF vector of its character n-grams (one to three letters, words parted by one blank), hashed
to a fixed number of features. A multinomial logistic regression is trained on it with
follow-the-regularised-leader steps per coordinate, whose elastic-net penalty leaves most weights at zero; a
temperature fitted on held-back rows of the sample then turns scores into probabilities.

Document frequencies are counted over all labelled training documents. The classifier is fitted on a
bounded sample: about ``per_language`` documents of each language, chosen by a hash of ``doc_id``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import short_batches, slices

BITS = 16
FEATURES = 1 << BITS
ORDERS = (1, 2, 3)
BLOCK = 1 << 16
#: documents of each language in the sample that the classifier is fitted on, about
PER_LANGUAGE = 500
UNKNOWN = "und"
_MULTIPLY = np.uint32(2654435761)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point that is a letter, else 32."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = c
    return out


def n_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and their counts in the whole text; none if it has no letter."""
    counts = np.zeros(FEATURES, dtype=np.int64)
    table = _letters()
    text = text.lower()
    tail = np.array([32], dtype=np.uint32)
    any_letter = False
    for at in range(0, len(text), BLOCK):
        points = table[np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        points = np.concatenate((tail, points))
        if at + BLOCK >= len(text):
            points = np.append(points, np.uint32(32))
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        fresh = len(tail)  # n-grams that end in the tail have been counted
        any_letter = any_letter or bool((points != 32).any())
        key = np.zeros(len(points), dtype=np.uint32)
        for n in ORDERS:
            if len(points) < n:
                break
            key = key[: len(points) - n + 1] * np.uint32(31 * 65537) + points[n - 1 :] + np.uint32(n)
            new = key[max(0, fresh - n + 1) :]
            if n == 1:
                new = new[points[len(points) - len(new) :] != 32]
            counts += np.bincount(((new * _MULTIPLY) >> np.uint32(32 - BITS)).astype(np.intp), minlength=FEATURES)
        tail = points[-(ORDERS[-1] - 1) :]
    if not any_letter:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """Languages, weights (features by languages; sparse, held dense), biases, inverse document frequencies, temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[at]
        return x / np.sqrt((x * x).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = n_grams(text) if text else (np.zeros(0), None)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax((self.vector(at, counts) @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Ftrl:
    """Follow the regularised leader, per coordinate, with penalties l1 and l2."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = softmax(x @ w)
        slope[label] -= 1
        g = np.outer(x, slope)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, str, bool]], idf: np.ndarray, epochs: int = 5,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002, seed: int = 7,
) -> Model:
    """Fit on sample rows (features, counts, language, held back). Rows that are held back fit the temperature only."""
    langs = sorted({lang for _, _, lang, _ in rows})
    model = Model(langs, np.zeros((len(idf), len(langs))), np.zeros(len(langs)), idf)
    if not langs:
        return model
    number = {lang: i for i, lang in enumerate(langs)}
    own = [r for r in rows if not r[3]] or rows
    back = [r for r in rows if r[3]] or rows
    learner = Ftrl(len(idf) + 1, len(langs), alpha, beta, l1, l2)
    data = [(np.append(at, len(idf)), np.append(model.vector(at, c), 1.0), number[lang]) for at, c, lang, _ in own]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            learner.step(*data[i])
    w = learner.weights()
    model.weights, model.bias = w[:-1], w[-1]
    z = np.array([model.vector(at, c) @ model.weights[at] + model.bias for at, c, _, _ in back])
    y = np.array([number[lang] for _, _, lang, _ in back])
    model.temperature = temperature(z, y)
    return model


def temperature(z: np.ndarray, y: np.ndarray, low: float = 0.05, high: float = 20.0) -> float:
    """The temperature with the least log loss, by golden section on its logarithm.

    A normal prior on the logarithm, worth one row, keeps it finite where all rows are right.
    """

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean() + log_t**2 / (2 * len(y)))

    a, b, g = np.log(low), np.log(high), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


# Spark


def fold() -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts. A row per task and feature is shuffled."""

    def work(batches):
        seen, n = np.zeros(FEATURES + 1, dtype=np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen[n_grams(text)[0]] += 1
                n += 1
        seen[FEATURES] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["feature", "n"])

    counted = docs.select("text").mapInArrow(work, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in counted.collect():  # at most one row per feature
        df[r["feature"]] = r["n"]
    return df[:FEATURES], int(df[FEATURES])


def sample(docs: DataFrame, per_language: int) -> list[tuple[np.ndarray, np.ndarray, str, bool]]:
    """Features of about ``per_language`` documents of each language, chosen by a hash of the id."""
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row per language
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    back = F.pmod(F.xxhash64(F.lit("held back"), "doc_id"), F.lit(5)) == 0

    def work(batches):
        for batch in slices(batches, 64):
            found = [n_grams(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                    pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())),
                    *batch.columns[1:],
                ],
                ["at", "counts", "lang", "back"],
            )

    rows = docs.where(draw < chance).select("text", "lang", back.alias("back"))
    found = rows.mapInArrow(work, "at array<int>, counts array<int>, lang string, back boolean")
    rows = [(np.array(r["at"]), np.array(r["counts"]), r["lang"], r["back"]) for r in found.toLocalIterator() if r["at"]]
    return sorted(rows, key=lambda r: (r[2], len(r[0]), r[0].tolist(), r[1].tolist()))  # whatever the order of tasks


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``text`` and ``lang`` of the documents with a language that are not in the held-out fold."""
    short_batches(docs.sparkSession)
    own = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold() != 2)
    df, n = document_frequencies(own)
    idf = np.log((1 + n) / (1 + df)) + 1
    return fit(sample(own.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), per_language), idf)


def with_language(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``. The model has a fixed number of features; it is sent to each worker once."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def work(batches):
        model = sent.value
        for batch in slices(batches):
            found = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    rows = docs.select(*keep, F.col("text").alias("__text"))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(work, schema)


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per row of ``docs``.

    ``und`` with score 0 for a null text, a text without letters, and wherever no labelled document is there to learn
    from. Repeated rows get equal results; an empty table gives none.
    """
    model = train(docs, per_language)
    rows = docs.select(F.col("doc_id").cast("long"), (fold() == 2).alias("held_out"), "text")
    return with_language(rows, model, ["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Rows of ``docs`` whose language is known with a probability of at least ``least``; all columns.

    Where nothing could be learned, only texts without letters are rejected.
    """
    model = train(docs, per_language)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sent.value.predict(t)[1]).astype("float64")

    return docs.where(score("text") >= least)
