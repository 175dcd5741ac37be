"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisegrid.llm._common import held_out

BITS = 20
THRESHOLD = 0.3
#: Letters in lower case, ASCII punctuation as gaps.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word -> 64-bit hash, kept for words seen before; emptied when it grows large."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def features(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Hashed words, neighbouring pairs and pairs around one word of the whole text, repeats included."""
    words = (text or b"").translate(_TABLE).split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams = np.concatenate([h * _SKIP, (h[:-1] * _PAIR) ^ h[1:], (h[:-2] * _SKIP) ^ (h[2:] * _PAIR)])
    return (grams >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    """Sparse weights: places and values, at most 2**BITS of each, and the bias."""

    places: np.ndarray
    values: np.ndarray
    bias: float
    trained: bool

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.values
        return out


def train_ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 4.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0, epochs: int = 5) -> Model:
    """FTRL-proximal over rows of (distinct places, label) with values 1: per-coordinate rates, L1 sparsity."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            places, label = rows[k]
            i = np.append(places, 1 << BITS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    places = np.flatnonzero(w[:-1])
    return Model(places.astype(np.int32), w[places].astype(np.float32), float(w[-1]), bool(rows))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 5000) -> Model:
    """A model of labels.toxic from at most most_rows labelled documents, those with the least hash of their id.

    Labels teach only where crc32(doc_id) mod 4 is not 2. Null labels and labels without a document are ignored; of
    several labels of one document the largest counts, of several texts the least. Without labels nothing is learned.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [np.unique(features(t.as_py(), hashes)).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "places"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y {labels.schema['toxic'].dataType.simpleString()}, places binary"
    sample = rows.mapInArrow(run, schema).toPandas().sort_values("doc_id")
    return train_ftrl([(np.frombuffer(p, np.int32), int(y)) for p, y in zip(sample["places"], sample["y"], strict=True)])


def score(text: Column, model: Model, session) -> Column:
    """The probability of label 1 for a text, null as empty; 0 if nothing was learned. The weights are broadcast."""
    sent = session.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        weights, hashes = model.dense(), WordHashes()
        for texts in batches:
            out = np.zeros(len(texts))
            for k, t in enumerate(texts):
                i = features(t, hashes)
                i = np.unique(i[weights[i] != 0])
                out[k] = weights[i].sum() + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))) if model.trained else out)

    return run(F.coalesce(text, F.lit("")).cast("binary"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; predicted is 1 from THRESHOLD on."""
    model = train(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), score(F.col("text"), model, docs.sparkSession).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject."""
    model = train(docs, labels)
    return docs.where(score(F.col("text"), model, docs.sparkSession) < THRESHOLD)
