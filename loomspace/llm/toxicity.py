"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each text gives binary features: its lower-cased words, pairs of neighbours and pairs with one word between, hashed to
2^20 coordinates. FTRL-proximal (McMahan et al., 2013) keeps a rate per coordinate, and its L1 term leaves most weights
at exactly zero, so what is broadcast for scoring is a short list of (coordinate, weight). A text's log-odds is the bias plus
the sum of the weights of its distinct features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, id_text, labelled_sample

BITS = 20
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: learning rate per coordinate; l1, l2: penalties; passes over the sample."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    passes: int = 8


class Hasher:
    """Distinct hashed features of texts. The hash of a word is remembered while there are not too many words."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, int] = {}

    def features(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.encode()) + 1
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x100000001B3)) ^ h[1:] ^ np.uint64(1 << 40)
        skips = (h[:-2] * np.uint64(0x1000193)) ^ h[2:] ^ np.uint64(1 << 41)
        return np.unique((np.concatenate((h, pairs, skips)) * _MIX) >> self.shift).astype(np.int32)


@dataclass(frozen=True)
class ToxicModel:
    """Non-zero weights only."""

    bits: int
    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.at] = self.weight
        return out


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, p: Ftrl | None = None) -> ToxicModel:
    """FTRL-proximal over (features, label) rows in a fixed shuffled order; without rows of both labels the score is the share of label 1."""
    p = p or Ftrl()
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    bias = bias_n = 0.0
    bias = float(np.log(share / (1 - share)))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= p.l1, 0.0, -(zz - np.sign(zz) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    if 0 < sum(y for _, y in rows) < len(rows):
        order = np.random.default_rng(5)
        for _ in range(p.passes):
            for k in order.permutation(len(rows)).tolist():
                at, y = rows[k]
                w = weights(at)
                g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
                z[at] += g - sigma * w
                n[at] += g * g
                bias_n += g * g
                bias -= 0.1 * g / (1 + np.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > p.l1)
    return ToxicModel(bits, at, weights(at), bias)


def hashed_rows(texts: DataFrame, bits: int = BITS) -> list[tuple[np.ndarray, int]]:
    """(features, label) of a bounded table (text, y), in its order; texts are hashed where they are read, and none comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for part in batches:
            found = [hasher.features(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), part.column("y")], ["features", "y"])

    return [(np.frombuffer(r.features, np.int32), r.y) for r in bounded(texts).mapInArrow(run, "features binary, y int").collect()]


def toxicity(docs: DataFrame, labels: DataFrame, train, sample: int = 2000, most_bytes: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, score, predicted.

    train: condition on doc_id, true for rows whose labels may be learnt. sample, most_bytes: bounds of what is fitted on the driver
    (rows of either label, bytes of a text). Null and empty texts have no features, so they score the bias; a text of any length is scored whole. Repeated rows
    each give a row; an empty table gives none, empty labels a score of 0.5. Only doc_id and text of docs are looked at.
    """
    model = fit(hashed_rows(labelled_sample(docs, labels, "toxic", train, sample, most_bytes, "toxic")))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, hasher = held.value.dense(), held.value.bias, Hasher(held.value.bits)
        for part in blocks(batches):
            logit = np.array([bias + weight[hasher.features(t)].sum() for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], ["doc_id", "score"])

    scored = bounded(id_text(docs)).mapInArrow(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
