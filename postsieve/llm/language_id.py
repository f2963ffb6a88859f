"""Language of texts by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are put in lower case, everything else becomes one blank, and runs of one to ``ORDERS`` characters are
hashed to ``SLOTS`` slots. A text's weights are log(1 + count) times the slot's inverse document frequency over all
learning texts, scaled to length one. The regression is trained with follow-the-regularised-leader (proximal, step
sizes per coordinate, L1 and L2 penalties), which leaves most weights at zero. A temperature is then
fitted on a part of the sample that was not trained on, so that scores are chances.

Document frequencies come from every learning text. The regression is fitted on a sample: the documents whose
hashed doc_id is lowest, about ``per_language`` (2,000) of each language and all where there are fewer, each as a
whole and once more as a short passage. The share to take follows from the languages' counts, so choosing the
sample moves no texts, and one task trains on it.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when nothing could be
learned. Rows with null lang or null doc_id teach nothing. Languages that tie in a prediction go by name. Other
columns are kept as they are; columns named lang_pred and score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, count_rows, free_name, releasing, rows_of, short_batches, summed

SLOTS = 1 << 15
ORDERS = 3
PER_LANGUAGE = 2000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0001
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_ASCII = np.array([c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)], np.uint32)


def slots_of(text: str, slots: int = SLOTS) -> np.ndarray:
    """The slot of every n-gram of the text, in no order."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    chars = np.where(chars < 128, _ASCII[np.minimum(chars, 127)], chars)
    chars = np.concatenate([[np.uint32(32)], chars, [np.uint32(32)]])
    chars = chars[np.append(True, (chars[1:] != 32) | (chars[:-1] != 32))].astype(np.uint64)
    bits, value, found = np.uint64(64 - (slots.bit_length() - 1)), chars, []
    for order in range(1, ORDERS + 1):
        if order > 1:
            value = value[:-1] * np.uint64(0x100000001B3) + chars[order - 1 :]
        found.append((value + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) >> bits)
    return np.concatenate(found).astype(np.int64)


def counts_of(text: str, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(slots_of(text, slots), minlength=slots)
    present = np.flatnonzero(counts)
    return present, counts[present]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        present, counts = counts_of(text, len(self.idf))
        values = np.log1p(counts) * self.idf[present]
        norm = np.sqrt(values @ values)
        return present, values / norm if norm else values

    def logits(self, text: str) -> np.ndarray:
        present, values = self.features(text)
        return values @ self.weights[present] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        chance = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(chance))
        return self.languages[best], float(chance[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


# --- learning ------------------------------------------------------------------------------------------


class Leader:
    """Follow-the-regularised-leader, proximal, for several classes."""

    def __init__(self, slots: int, classes: int):
        self.z, self.n = np.zeros((slots + 1, classes)), np.zeros((slots + 1, classes))

    def weights(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        step = (BETA + np.sqrt(n)) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / step)

    def learn(self, rows: np.ndarray, values: np.ndarray, target: int) -> None:
        w = self.weights(rows)
        error = softmax(values @ w)
        error[target] -= 1
        g = values[:, None] * error
        square = g * g
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + square) - np.sqrt(n)) / ALPHA * w
        self.n[rows] = n + square


def fit(sample: list[tuple[str, str]], idf: np.ndarray) -> Model:
    """``sample``: (text, language), in a random order. Every fifth text is for the temperature."""
    slots = len(idf)
    languages = sorted({lang for _, lang in sample})
    number = {lang: k for k, lang in enumerate(languages)}
    model = Model(languages, idf, np.zeros((slots, len(languages))), np.zeros(len(languages)))
    rng = np.random.default_rng(0)
    learnt, held = [], []
    for k, (text, lang) in enumerate(sample):
        words = text.split()
        begin = int(rng.integers(0, max(1, len(words))))
        for part in (text, " ".join(words[begin : begin + int(rng.integers(2, 13))])):
            if _LETTER.search(part):
                present, values = model.features(part)
                row = np.append(present, slots), np.append(values, 1.0), number[lang]
                (held if k % 5 == 4 else learnt).append(row)
    leader = Leader(slots, len(languages))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(learnt)).tolist():
            leader.learn(*learnt[k])
    weights = leader.weights(slice(None))
    model.weights, model.bias = weights[:-1], weights[-1]
    if held:
        logits = np.array([values @ weights[rows] for rows, values, _ in held])
        model.temperature = temperature(logits, np.array([target for _, _, target in held]))
    return model


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """Minimises the loss of ``softmax(logits / t)`` by golden section over log t."""

    def loss(log_t: float) -> float:
        chance = softmax(logits / np.exp(log_t))[np.arange(len(targets)), targets]
        return -np.log(np.maximum(chance, 1e-12)).mean()

    ratio, low, high = (np.sqrt(5) - 1) / 2, -3.0, 3.0
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame, slots: int = SLOTS) -> tuple[int, np.ndarray]:
    """The number of texts and, per slot, of those that have it; the texts without letters left out."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * slots, np.int64)  # one slot of the upper half counts the texts
        for (text,) in rows_of(batches, "text"):
            if text is not None and _LETTER.search(text):
                counts[:slots] += np.bincount(slots_of(text, slots), minlength=slots) > 0
                counts[slots] += 1
        yield batch_of(schema, list(count_rows(counts)))

    found = summed(texts.select("text").mapInArrow(releasing(run), "part int, counts binary"), 2 * slots)
    return int(found[slots]), found[:slots]


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, slots: int = SLOTS) -> Model:
    """A model from ``rows`` (doc_id, text, lang). The driver gets the languages' counts, the document frequencies and
    the model, whose size is ``slots`` times the number of languages."""
    short_batches(rows.sparkSession)
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    rows = rows.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.ones(slots), np.zeros((slots, 0)), np.zeros(0))
    n, df = document_frequencies(rows, slots)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, per_language / c)])
    place = F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5
    sample = rows.withColumn("place", place).where(F.col("place") < F.element_at(share, F.col("lang")))
    schema = pa.schema([("languages", pa.list_(pa.string())), ("weights", pa.binary()), ("bias", pa.binary()), ("temperature", pa.float64())])
    sent = rows.sparkSession.sparkContext.broadcast(idf)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((p, t, lang) for p, t, lang in rows_of(batches, "place", "text", "lang"))
        if held:
            m = fit([(t, lang) for _, t, lang in held], sent.value)
            yield batch_of(schema, [[m.languages], [m.weights.tobytes()], [m.bias.tobytes()], [m.temperature]])

    found = sample.select("place", "text", "lang").repartition(1).mapInArrow(releasing(train), "languages array<string>, weights binary, bias binary, temperature double")
    row = found.first()
    if row is None:
        return Model([], idf, np.zeros((slots, 0)), np.zeros(0))
    weights = np.frombuffer(row["weights"]).reshape(slots, -1)
    return Model(list(row["languages"]), idf, weights, np.frombuffer(row["bias"]), row["temperature"])


# --- prediction ----------------------------------------------------------------------------------------


def with_language(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its chance under ``names``; columns of these two names are replaced."""
    short_batches(docs.sparkSession)
    # plain values only: a class in a broadcast would have to be installed on the executors
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.weights, model.bias, model.temperature))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = Model(*sent.value)
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    found = free_name(docs, "language")
    rows = docs.withColumn(found, predict(F.col(text).cast("string")))
    own = [c for c in docs.columns if c not in names]
    return rows.select(*own, F.col(found)["lang_pred"].alias(names[0]), F.col(found)["score"].alias(names[1]))
