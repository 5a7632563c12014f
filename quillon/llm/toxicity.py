"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct buckets of its words (ASCII lower case, punctuation at the
ends taken off), of neighbouring pairs and of pairs around one word. FTRL-proximal keeps a
gradient sum and a squared-gradient sum per coordinate, which gives each its own rate and, by
the L1 term, leaves most weights at exactly 0. What remains is bounded by the number of
buckets, so it may be sent to every task.

The fit reads at most about ``max_train`` labelled documents (a documented bound: a share of
the labels by hash of doc_id, in the order of that hash); scoring reads every whole text.

Edge cases: a null or empty text has no features and gets the score of the bias alone; labels
other than 0 and 1 are left out, the largest of several labels for one doc_id counts; of rows
that share a labelled doc_id the smallest text is learned, once; rows with a null doc_id are
scored and never held out; where the documents learned from don't have both labels nothing is
learned, every score is 0 (predicted 0) and no document is rejected; repeated rows are scored
alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, as_bytes, pair, portions, table, tidy

ENDS = b".,;:!?\"'()[]{}<>*#%&$|-_"


class _Words(WordHash):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower().strip(ENDS) or word, self.seed)
        return value


_words = _Words(seed=3)


@dataclass(frozen=True)
class Rates:
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.05
    epochs: int = 5


@dataclass(frozen=True)
class Weights:
    """bits: log2 of the buckets; bucket 2**bits is the bias. Without any weight nothing was
    learned, and every score is 0."""

    bits: int
    buckets: np.ndarray
    values: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << self.bits) + 1)
        out[self.buckets] = self.values
        return out

    def score(self, text: bytes, dense: np.ndarray) -> float:
        if not len(self.buckets):
            return 0.0
        i = buckets_of(text, self.bits)
        i = np.unique(i[dense[i] != 0])
        return logistic(float(dense[i].sum() + dense[-1]))


def logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


def buckets_of(text: bytes, bits: int) -> np.ndarray:
    h = _words.of(text.split())
    all_ = np.concatenate([h, pair(h[:-1], h[1:]), pair(h[:-2] ^ np.uint64(0x5BD1E995), h[2:])])
    return (all_ >> np.uint64(64 - bits)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, rates: Rates) -> np.ndarray:
    """Weights after ``epochs`` passes in the given order; the last one is the bias, without L1."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, rates.l1)
    l1[-1] = 0.0

    def weight(i):
        over = np.abs(z[i]) - l1[i]
        return np.where(over > 0, -np.sign(z[i]) * over / ((rates.beta + np.sqrt(n[i])) / rates.alpha + rates.l2), 0.0)

    for _ in range(rates.epochs):
        for i, y in rows:
            w = weight(i)
            g = logistic(float(w.sum())) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / rates.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(size))


def _fit(bits: int, rates: Rates):
    def fit(batches):
        rows = []
        for batch in portions(batches):
            for text, y in zip(as_bytes(batch.column("text")), batch.column("y").to_pylist()):
                rows.append((np.append(np.unique(buckets_of(text, bits)), 1 << bits).astype(np.int32), y))
        both = len({y for _, y in rows}) == 2
        w = ftrl(rows, bits, rates) if both else np.zeros(0)
        found = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(w[found])], ["bucket", "weight"])

    return fit


def _score(model: Weights):
    def score(batches):
        dense = model.dense()
        for batch in portions(batches):
            out = [model.score(text, dense) for text in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(out, pa.float64())], [*(c for c in batch.schema.names if c != "text"), "score"])

    return score


def held_out(doc_id=None):
    return F.coalesce(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 16_000, bits: int = 20, rates: Rates = Rates()) -> Weights:
    """Weights from labelled documents that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    there = known.count()
    share = min(1.0, 0.95 * max_train / max(1, there))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about max_train rows of two numbers, so this side may go to every task
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"))
    ordered = texts.repartition(1).sortWithinPartitions(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id")
    found = ordered.select("text", "y").mapInArrow(tidy(_fit(bits, rates)), "bucket long, weight double").toPandas()
    return Weights(bits, found["bucket"].to_numpy(np.int64), found["weight"].to_numpy(float))


def score_toxicity(docs: DataFrame, model: Weights) -> DataFrame:
    """doc_id and score of every row."""
    return docs.select("doc_id", "text").mapInArrow(tidy(_score(model)), "doc_id long, score double")


def _reject(model: Weights, threshold: float):
    def reject(batches):
        dense = model.dense()
        for batch in batches:
            rows = batch.column("row")
            texts = pa.RecordBatch.from_arrays([rows.field("text"), rows], ["text", "row"])
            for part in portions([texts]):
                good = [model.score(text, dense) < threshold for text in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("row").filter(pa.array(good, pa.bool_()))], ["row"])

    return reject


def reject_toxic(docs: DataFrame, model: Weights, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged. A row and its
    text travel once."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.mapInArrow(tidy(_reject(model, threshold)), rows.schema).select("row.*")


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
