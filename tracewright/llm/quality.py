"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Texts are cut into words and runs of signs, case kept; a token equal to the one before it
counts as one special token, so that repetition is seen whatever is repeated.
One- and two-grams are hashed to ``2**BITS`` places, and a document is the vector of its
n-gram frequencies. The score is the logistic function of a sparse dot product.

Training takes at most ``TRAIN_ROWS`` labelled documents of ``TRAIN_BYTES`` in all (the bounds
are parameters; those with the least hash of their id, one text for each id), never one that is
held out, and runs in one task on these rows. Only the weights come back, ``2**BITS`` floats.
Scoring reads every whole text once and shuffles nothing.

Cases: a null text counts as empty, and an empty one scores what the bias alone
gives; an id with contradicting labels takes their majority, ties count as 1; null
labels and ids are not learned from; with no labelled rows every score is 0.5;
repeated rows score alike; columns beside doc_id and text play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common
from tracewright.llm.hashing import U64, WordHashes, ngrams

BITS = 18
TRAIN_ROWS = 8_000
TRAIN_BYTES = 64_000_000
EPOCHS = 3
#: FTRL: learning rate, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
#: Frequencies are small; they enter multiplied by this.
SCALE = 10.0
LEAST = 0.3
HELD_OUT = 5
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_SAME = U64(0x5A17)


def places(text: str, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Places of all n-grams of a text, repeats included."""
    words = hashes(_TOKENS.findall(text))
    if len(words) > 1:
        words = np.where(np.concatenate(([False], words[1:] == words[:-1])), _SAME, words)
    grams = np.concatenate([ngrams(words, 1), ngrams(words, 2)])
    return (grams >> U64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression over hashed places, with a bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    @staticmethod
    def _weights(z, n, l1=L1, l2=L2):
        small = np.abs(z) <= l1
        return np.where(small, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One example: unique places, their values, 0 or 1."""
        z, n = self.z[at], self.n[at]
        w, b = self._weights(z, n), float(self._weights(self.bias_z, self.bias_n, 0.0, 0.0))
        wrong = 1 / (1 + np.exp(-np.clip(b + w @ x, -35, 35))) - label
        g = wrong * x
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_z += wrong - (np.sqrt(self.bias_n + wrong * wrong) - np.sqrt(self.bias_n)) / ALPHA * b
        self.bias_n += wrong * wrong

    def fitted(self) -> tuple[np.ndarray, float]:
        return self._weights(self.z, self.n).astype(np.float32), float(self._weights(self.bias_z, self.bias_n, 0.0, 0.0))


def fit(examples: list[tuple[str, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled texts, in the given order."""
    hashes, model, rows = WordHashes(), Ftrl(bits), []
    for text, label in examples:
        at, counts = np.unique(places(text, hashes, bits), return_counts=True)
        rows.append((at, SCALE * counts / max(1, counts.sum()), label))
    for _ in range(epochs):
        for at, x, label in rows:
            model.update(at, x, label)
    return model.fitted()


def score_text(text: str, weights: np.ndarray, bias: float, hashes: WordHashes, bits: int = BITS) -> float:
    at = places(text, hashes, bits)
    total = bias + (SCALE * float(weights[at].mean(dtype=np.float64)) if len(at) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Fit on the bounded sample of labelled documents that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    voted = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("__label"))
    sample = voted.withColumn("__h", F.xxhash64("doc_id")).orderBy("__h", "doc_id").limit(rows)
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # of an id that repeats one text is learned from, so there are at most ``rows`` of them
    texts = found.groupBy("__h", "doc_id", "__label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    texts = common.stored(texts.withColumn("__size", F.octet_length("text")), "training")
    chosen, size = [], 0
    for row in texts.select("__h", "doc_id", "__size").orderBy("__h", "doc_id").collect():  # at most ``rows`` slim rows
        if size + row["__size"] <= most:  # a text that doesn't fit is passed over
            chosen.append(row["__h"])
            size += row["__size"]
    texts = texts.join(F.broadcast(documents.sparkSession.createDataFrame([(h,) for h in chosen], "__h long")), "__h", "left_semi")

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples = [(t, int(y)) for b in batches for t, y in zip(b["text"], b["__label"], strict=True)]
        weights, bias = fit(examples, bits)
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    one = texts.repartition(1).sortWithinPartitions("__h", "doc_id").select("text", "__label")  # at most ``rows`` rows of ``most`` bytes
    model = one.mapInPandas(in_task, "weights binary, bias double").first()
    if model is None:
        return np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def score(documents: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """``documents`` with a score for each text; a column of that name is replaced."""
    shared, bits = documents.sparkSession.sparkContext.broadcast(model), int(len(model[0])).bit_length() - 1

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, (weights, bias) = WordHashes(), shared.value
        for texts in batches:
            yield pd.Series([score_text(t or "", weights, bias, hashes, bits) for t in texts], dtype="float64")

    return documents.withColumn(column, scored(F.col("text")))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, columns unchanged."""
    scored = score(documents, train(documents, labels), "__quality")
    return scored.filter(F.col("__quality") >= LEAST).drop("__quality")
