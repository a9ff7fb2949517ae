"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text are the distinct hashes of its words, of its pairs of
neighbouring words and of its skip-grams (pairs with one word between). Only
labelled rows whose crc32(doc_id) is not divisible by the number of folds are
learned from, at most ``max_rows`` of them: those with the least hash of
doc_id, whose ids are broadcast, so no other text moves. Texts become
coordinates where they lie; these stream through one task in hash order,
``epochs`` times, so its memory is the model and one row. L1 leaves few
weights other than zero; they are broadcast, at most 12 bytes for each of
2**BITS coordinates.

Defined cases: a null or empty text has no features and gets the score of the
bias; a null doc_id is scored, never learned from, and not held out; rows that
repeat a doc_id are scored each for itself, and each is learned from; without
a learnable label of both kinds every score is the share of label 1 (0 if
there are none); of several labels of a doc_id the largest counts; a very long
text has at most 2**BITS coordinates; an empty table gives an empty result; a
column named as the score is replaced, other columns are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import whole

BITS = 22
FOLDS = 5
MAX_ROWS = 16_000
EPOCHS = 4
#: Rates and penalties of the learner, and what a row of label 1, the rarer one, weighs.
ALPHA, BETA, L1, L2, ONES_WEIGHT = 2.0, 1.0, 15.0, 1.0, 1.5
#: Hashes of words that a worker remembers.
REMEMBERED_WORDS = 200_000

_WORDS = re.compile(r"[^\W_]+")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word.encode())
        if len(self) < REMEMBERED_WORDS:
            self[word] = value
        return value


_hashes = _WordHashes()


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Sorted distinct coordinates of a text."""
    words = _WORDS.findall(text.lower())
    one = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    turned = one * np.uint64(0x9E3779B97F4A7C15)
    parts = [one]
    for gap, salt in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        parts.append((turned[:-gap] ^ (one[gap:] + np.uint64(salt))) * np.uint64(0xE7037ED1A0B428DB))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal with a rate for each coordinate; the last coordinate is the bias, free of L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.rows = self.ones = 0

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def bias(self) -> float:
        return float(-self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA))

    def learn(self, at: np.ndarray, label: int) -> None:
        w, bias = self.weights(at), self.bias()
        gap = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
        gap *= ONES_WEIGHT if label else 1.0
        self.rows, self.ones = self.rows + 1, self.ones + label
        for where, old in ((at, w), (slice(-1, None), bias)):
            n = self.n[where]
            self.z[where] += gap - (np.sqrt(n + gap * gap) - np.sqrt(n)) / ALPHA * old
            self.n[where] = n + gap * gap


def held_out(doc_id, folds: int = FOLDS):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) learned from ``labels.toxic``."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # At most max_rows ids and labels, so the broadcast is bounded.
    texts = docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("tie"), "label", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            at = pa.array([features(t.as_py()).astype(np.int32) for t in given.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*given.columns[:3], at], ["h", "tie", "label", "at"])

    rows = texts.mapInArrow(hashed, "h long, tie long, label int, at array<int>")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(1 << BITS)
        for given in batches:
            for label, at in zip(given.column(0).to_pylist(), given.column(1)):
                model.learn(at.values.to_numpy(zero_copy_only=False), label)
        if 0 < model.ones < model.rows:
            w = model.weights(slice(0, -1))
            bias = model.bias()
        else:
            w = np.zeros(0)
            bias = float(np.log((model.ones + 1e-9) / (model.rows - model.ones + 1e-9))) if model.rows else -35.0
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["at", "weight"]
        )

    model = (
        rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
        .repartition(1)
        .sortWithinPartitions("epoch", "h", "tie")
        .select("label", "at")
        .mapInArrow(learned, "at long, weight double")
        .toPandas()
    )
    bias = float(model.weight[model["at"] < 0].iloc[0]) if len(model) else -35.0
    model = model[model["at"] >= 0]
    return model["at"].to_numpy(), model.weight.to_numpy(np.float32), bias


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """``docs`` with all its columns and ``toxicity_score``; rows stay where they are."""
    at, weights, bias = train(docs, labels, max_rows, epochs)
    docs = docs.drop("toxicity_score")
    sent = docs.sparkSession.sparkContext.broadcast((at, weights, bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, bias = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weights
        for given in batches:
            texts = given.column("text")
            sums = np.array([dense[features(t.as_py() or "")].sum(dtype=np.float64) for t in texts]) + bias
            scores = pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([*given.columns, scores], [*given.schema.names, "toxicity_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType())])
    return docs.mapInArrow(scored, schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    return score(docs.select("doc_id", "text"), labels, max_rows, epochs).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"),
    )
