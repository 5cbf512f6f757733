"""Hashed word n-gram logistic regression, trained with follow-the-regularised-leader (FTRL-proximal) updates.

Tokens are runs of word characters and runs of other visible characters, A-Z in lower case. A text's features are its
hashed unigrams and bigrams, and back references: a unigram or bigram that says "the same token as one (two) before".
With ``prefixes``, they are words and word beginnings instead, for languages that inflect or join words.
Training takes a sample of labelled rows, bounded in rows and in features, in one task and returns one dense weight vector
(4 bytes x 2^bits); scoring is a sparse dot product per text, without a shuffle.

Defined cases, of both classifiers: null and empty texts have no features and score what the bias alone says; without labels
every score is 0.5; a text of any length is scored whole, and in training a text that would exceed the bound of features
is left out of the sample, not cut; repeated rows score alike, and in training an id counts once, with its least text and its
largest label; ties in the order of the sample go by id; labels that are null or of ids that no document has are ignored; of
columns with clashing names those of the documents stay, but for the score's own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.common import bucket_of, small_batches, with_arrow_columns

TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+|[^\s0-9a-z_\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    epochs: int = 3
    max_train: int = 12_000  #: bound of the labelled sample, in rows
    max_features: int = 24_000_000  #: and in features of all its texts, 8 bytes each
    swap_penalty: float = 0.0
    prefixes: tuple[int, ...] = ()  #: lengths in bytes of word beginnings
    min_docs: int = 1  #: features of fewer training texts are left out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings
    trained_on: int


def tokens(text: str | None) -> list[bytes]:
    return TOKEN.findall((text or "").encode("utf-8", "replace").lower())


def features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0)
    if s.prefixes:
        own = set(words)
        parts = [np.fromiter(map(zlib.crc32, own), np.uint64, len(own)) * np.uint64(0x9E3779B97F4A7C15)]
        for k in s.prefixes:
            begin = {w[:k] for w in own if len(w) > k}
            parts.append((np.fromiter(map(zlib.crc32, begin), np.uint64, len(begin)) + np.uint64(1 << 33)) * np.uint64(0x9E3779B97F4A7C15))
        index = np.unique((np.concatenate(parts) >> np.uint64(64 - s.bits)).astype(np.int64))
        return index, np.ones(len(index))
    h = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    odd = np.uint64(0x9E3779B97F4A7C15)
    parts = [h * odd]
    if n > 1:
        same = h[1:] == h[:-1]
        parts += [(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[1:]) * odd, np.full(int(same.sum()), 0x51ED270B0A1F39C1, np.uint64) * odd]
    if n > 2:
        same = h[2:] == h[:-2]
        parts.append(np.full(int(same.sum()), 0x2545F4914F6CDD1D, np.uint64) * odd)
    index, counts = np.unique((np.concatenate(parts) >> np.uint64(64 - s.bits)).astype(np.int64), return_counts=True)
    return index, np.sqrt(counts / n)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


class Ftrl:
    """State of FTRL-proximal: per-coordinate z and n; weights follow from them."""

    def __init__(self, s: Settings):
        self.s = s
        self.z, self.n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
        self.z0 = self.n0 = 0.0

    def weights(self, index=slice(None)) -> np.ndarray:
        z, n, s = self.z[index], self.n[index], self.s
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def bias(self) -> float:
        return -self.z0 / ((self.s.beta + math.sqrt(self.n0)) / self.s.alpha)

    def step(self, index: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        n = self.n[index]
        after = n + gradient * gradient
        self.z[index] += gradient - (np.sqrt(after) - np.sqrt(n)) / self.s.alpha * w
        self.n[index] = after

    def learn(self, index: np.ndarray, x: np.ndarray, y: float) -> None:
        w, b = self.weights(index), self.bias()
        error = sigmoid(b + w @ x) - y
        self.step(index, error * x, w)
        after = self.n0 + error * error
        self.z0 += error - (math.sqrt(after) - math.sqrt(self.n0)) / self.s.alpha * b
        self.n0 = after

    def agree(self, index: np.ndarray, x: np.ndarray) -> None:
        """One step against the squared difference of the scores of a text and its counterfactual; x: how their features differ."""
        w = self.weights(index)
        self.step(index, 2 * self.s.swap_penalty * (w @ x) * x, w)


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features in which a and b differ, and by how much."""
    index = np.union1d(a[0], b[0])
    x = np.zeros(len(index))
    x[np.searchsorted(index, a[0])] += a[1]
    x[np.searchsorted(index, b[0])] -= b[1]
    moved = np.flatnonzero(x)
    return index[moved], x[moved]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents that aren't held out: those of the least hashed ids.

    Of several labels of an id the largest counts, of several texts the least. The chosen labels, at most ``limit`` narrow rows, are broadcast.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (bucket_of(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))


def train(sample: DataFrame, s: Settings, swap: Callable[[list[bytes], int], list[bytes] | None] | None = None) -> Model:
    """Train in one task on a bounded sample (doc_id, text, y), one row per id. swap makes a text's counterfactual."""
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        seen = np.zeros(1 << s.bits, np.int64)
        small = lambda f: (f[0].astype(np.int32), f[1].astype(np.float32))
        for batch in batches:
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = tokens(text)
                own = features(words, s)
                if total + len(own[0]) > s.max_features:
                    continue
                total += len(own[0])
                seen[own[0]] += 1
                moved = None
                if swap and (other := swap(words, len(rows))):
                    moved = difference(own, features(other, s))
                    seen[moved[0][moved[1] < 0]] += 1  # what the counterfactual has and the text has not
                rows.append((small(own), y, small(moved) if moved else None))
        if s.min_docs > 1:
            often = seen >= s.min_docs
            cut = lambda f: (f[0][often[f[0]]], f[1][often[f[0]]])
            rows = [(cut(own), y, moved and cut(moved)) for own, y, moved in rows]
        ftrl = Ftrl(s)
        for _ in range(s.epochs):
            for own, y, moved in rows:
                ftrl.learn(*own, y)
                if moved:
                    ftrl.agree(*moved)
        w = ftrl.weights().astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(w.tobytes())], pa.binary()), pa.array([ftrl.bias()]), pa.array([len(rows)], pa.int64())], names=["w", "b", "n"])

    one = sample.select("doc_id", "text", "y").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    got = one.mapInArrow(run, "w binary, b double, n long").collect()
    if not got:
        return Model(np.zeros(1 << s.bits, "<f4"), 0.0, s, 0)
    return Model(np.frombuffer(zlib.decompress(bytes(got[0].w)), "<f4"), got[0].b, s, got[0].n)


def score_text(words: list[bytes], model: Model) -> float:
    index, x = features(words, model.settings)
    return sigmoid(model.bias + float(model.weights[index] @ x))


def scored(docs: DataFrame, model: Model, text_col: str = "text", at_least: float | None = None, name: str = "score") -> DataFrame:
    """docs with a score column of that name (an old one is replaced); with at_least, only rows that score so much."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes x 2^bits

    def make():
        m = shared.value
        return lambda texts: [[score_text(tokens(t), m) for t in texts]]

    return with_arrow_columns(docs, [text_col], make, f"`{name}` double", (lambda scores: [x >= at_least for x in scores]) if at_least is not None else None)


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id) == 2
