"""Quality classifier: a convolutional network over bytes, in numpy.

A document is cut into chunks of 512 bytes that overlap by 64, so that together they cover it and every window of a
filter lies in a chunk. Learned filters look at 8 embedded bytes each, every 2 bytes; their rectified values are
max-pooled over a chunk. The maximum and the mean of a document's chunk vectors, and how much of a chunk a short text
fills, go through one hidden layer to a probability. Max-pooling lets the gradient of a filter flow through one window of a chunk only, so training stays cheap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded, id_text, labelled_sample, text_bytes

WIDTH, STRIDE, CHUNK, STEP = 8, 2, 512, 448
EMBED, FILTERS, HIDDEN = 6, 32, 16
#: Bytes that go through the network at once.
BLOCK = 64 << 10


@dataclass
class Cnn:
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # WIDTH * EMBED x FILTERS
    conv_bias: np.ndarray
    hidden: np.ndarray  # 2 * FILTERS + 2 x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray

    @staticmethod
    def fresh(seed: int, share: float) -> Cnn:
        r = np.random.default_rng(seed)
        draw = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        return Cnn(draw(256, EMBED, by=0.5), draw(WIDTH * EMBED, FILTERS, by=0.3), np.zeros(FILTERS, np.float32), draw(2 * FILTERS + 2, HIDDEN, by=0.15), np.zeros(HIDDEN, np.float32), draw(HIDDEN, by=0.2), np.array([np.log(share / (1 - share))], np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes in a row, each padded by zeros to an even length of 8 or more; per chunk its first and last window
    (windows start at every second byte of the row) and its text."""
    pieces, first, last, owner, at = [], [], [], [], 0
    for k, t in enumerate(texts):
        size = max(WIDTH, len(t) + (len(t) & 1))
        pieces.append(t.ljust(size, b"\0"))
        for begin in range(0, max(1, size - (CHUNK - STEP)), STEP):
            first.append((at + begin) // STRIDE)
            last.append((at + min(begin + CHUNK, size) - WIDTH) // STRIDE)
            owner.append(k)
        at += size
    return np.frombuffer(b"".join(pieces), np.uint8), np.array(first), np.array(last), np.array(owner)


def windows(model: Cnn, flat: np.ndarray) -> np.ndarray:
    x = model.embed[flat]
    n = (len(flat) - WIDTH) // STRIDE + 1
    return np.lib.stride_tricks.as_strided(x, (n, WIDTH * EMBED), (x.strides[0] * STRIDE, x.strides[1]))


def pooled(model: Cnn, flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk the largest value of each filter, before and after rectification; and the values of all windows."""
    values = windows(model, flat) @ model.conv
    values = np.concatenate((values, np.full((1, FILTERS), -np.inf, np.float32)))
    cuts = np.stack((first, last + 1), axis=1).ravel()
    most = np.maximum.reduceat(values, cuts, axis=0)[::2] + model.conv_bias
    return most, np.maximum(most, 0), values


def filled(texts: list[bytes]) -> np.ndarray:
    """Two features of length: the share of one chunk that a text fills, and the same on a logarithmic scale."""
    share = np.minimum(np.fromiter(map(len, texts), np.float32, len(texts)) / CHUNK, 1)
    return np.stack((share, -np.log(share + 1 / CHUNK) / 6), axis=1)


def document_vectors(chunks: np.ndarray, owner: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Maximum and mean of each document's chunk vectors, and its length; owner is sorted and has every document."""
    begin = np.searchsorted(owner, np.arange(len(texts)))
    count = np.bincount(owner, minlength=len(texts))[:, None]
    return np.concatenate((np.maximum.reduceat(chunks, begin, axis=0), np.add.reduceat(chunks, begin, axis=0) / count, filled(texts)), axis=1), count


def head(model: Cnn, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner = np.maximum(vectors @ model.hidden + model.hidden_bias, 0)
    return 1 / (1 + np.exp(-np.clip(inner @ model.out + model.out_bias[0], -30, 30))), inner


def scores(model: Cnn, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for whole texts. A text longer than a block goes through piece by piece, cut at chunk starts."""
    top = np.zeros((len(texts), FILTERS), np.float32)
    total = np.zeros((len(texts), FILTERS), np.float64)
    count = np.zeros(len(texts))
    piece = BLOCK // STEP * STEP
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        flat, first, last, owner = laid_out([b for _, b in held])
        chunks = pooled(model, flat, first, last)[1]
        doc = np.array([k for k, _ in held])[owner]
        np.maximum.at(top, doc, chunks)
        np.add.at(total, doc, chunks)
        np.add.at(count, doc, 1)
        held.clear()

    size = 0
    for k, t in enumerate(texts):
        for begin in range(0, max(1, len(t) - (CHUNK - STEP)), piece):
            part = t[begin : begin + piece + CHUNK - STEP]
            held.append((k, part))
            size += len(part)
            if size >= BLOCK:
                flush()
                size = 0
    if held:
        flush()
    return head(model, np.concatenate((top, total / np.maximum(count, 1)[:, None], filled(texts)), axis=1))[0]


def fit(rows: list[tuple[str, int]], epochs: int = 10, batch: int = 64, rate: float = 4e-3, share: float = 0.7, seed: int = 11, least_steps: int = 600) -> Cnn:
    """Adam on the weighted log-loss, with label 1 weighing `share` in all; without rows of both labels the score is the share of label 1."""
    y = np.array([v for _, v in rows], float)
    if not len(y) or y.min() == y.max():
        model = Cnn.fresh(seed, (y.sum() + 0.5) / (len(y) + 1))
        model.out[:] = 0
        return model
    model = Cnn.fresh(seed, share)
    texts = [t.encode() for t, _ in rows]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    order = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()]
    per_epoch = -(-len(rows) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))  # few rows are seen more often
    step, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        shuffled = order.permutation(len(rows))
        for k in range(0, len(rows), batch):
            at = shuffled[k : k + batch]
            grads = _gradients(model, [texts[i] for i in at], y[at], weight[at])
            step += 1
            lr = rate * (1 - step / (steps + 1))
            for p, g, (m, v) in zip(model.parts(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def _gradients(model: Cnn, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    flat, first, last, owner = laid_out(texts)
    most, chunks, values = pooled(model, flat, first, last)
    vectors, count = document_vectors(chunks, owner, texts)
    p, inner = head(model, vectors)
    d_logit = ((p - y) * weight / len(y)).astype(np.float32)
    d_inner = np.outer(d_logit, model.out) * (inner > 0)
    d_vectors = d_inner @ model.hidden.T
    top = vectors[:, :FILTERS][owner]
    ties = (chunks == top) & (chunks > 0)
    per_doc = np.add.reduceat(ties, np.searchsorted(owner, np.arange(len(texts))), axis=0, dtype=np.float32)
    d_chunks = ties * (d_vectors[:, :FILTERS] / np.maximum(per_doc, 1))[owner] + (d_vectors[:, FILTERS : 2 * FILTERS] / count)[owner]
    d_chunks = d_chunks * (most > 0)
    c_at, f_at = np.nonzero(d_chunks)
    best = np.zeros(chunks.shape, np.int64)
    for c in np.unique(c_at).tolist():
        best[c] = first[c] + values[first[c] : last[c] + 1].argmax(axis=0)
    g = d_chunks[c_at, f_at]
    where = best[c_at, f_at]
    read = flat[where[:, None] * STRIDE + np.arange(WIDTH)]
    x = model.embed[read].reshape(len(g), -1)
    d_conv = np.zeros_like(model.conv)
    d_embed = np.zeros_like(model.embed)
    by_filter = np.argsort(f_at, kind="stable")
    edges = np.searchsorted(f_at[by_filter], np.arange(FILTERS + 1))
    for f in range(FILTERS):
        rows = by_filter[edges[f] : edges[f + 1]]
        d_conv[:, f] = g[rows] @ x[rows]
    back = (g[:, None] * model.conv[:, f_at].T).reshape(-1, EMBED)
    flat_read = read.ravel()
    for e in range(EMBED):
        d_embed[:, e] = np.bincount(flat_read, weights=back[:, e], minlength=256)
    return [d_embed, d_conv, d_chunks.sum(0), vectors.T @ d_inner, d_inner.sum(0), d_logit @ inner, d_logit.sum(keepdims=True)]


def quality_scores(docs: DataFrame, labels: DataFrame, train, sample: int = 2500, most_bytes: int = 8_000, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, score, predicted.

    train: condition on doc_id, true for rows whose labels may be learnt. sample, most_bytes: bounds of what is fitted on the driver
    (rows of either label, bytes of a text); a text of any length is scored whole, piece by piece. Null and empty texts are scored as padding alone. Repeated rows
    each give a row; an empty table gives none; without labels of both kinds the score is a constant. Only doc_id and text of docs are looked at.
    """
    rows = labelled_sample(docs, labels, "quality", train, sample, most_bytes, "quality").collect()
    held = docs.sparkSession.sparkContext.broadcast(fit([(r.text, r.y) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(held.value, text_bytes(part.column("text"))).astype(float))], ["doc_id", "score"])

    return bounded(id_text(docs)).mapInArrow(run, "doc_id bigint, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
