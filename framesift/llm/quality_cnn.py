"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of its bytes.  Over each chunk run learned filters (a
filter is one weight per byte value and tap, so a convolution is a sum of table rows), each filter keeps its
largest response in the chunk, and a document is the mean of its chunks' maxima, which a logistic unit
turns into one probability.

It learns on the driver, from a bounded sample: at most about `sample_docs` labelled documents of each
class and `sample_bytes` bytes of them, chosen by a hash of their id, each with all its chunks.  A labelled document of more
than a hundredth of `sample_bytes` is scored like any other but not learned from.
Scoring runs in Arrow batches on the executors; the weights are a broadcast of some hundred kilobytes.

Defined results: a null or empty text is one chunk of padding and gets the score of that; without a
labelled row, or with one class only, every score is the share of label 1 (0.5 without rows); a document
labelled several times counts once, with the mean label rounded up; null labels are left out; a null id
counts as the empty text for the held-out rule; repeated rows give repeated rows; empty input gives empty
output; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framesift.llm.common import fold
from framesift.llm.text import buffers, slices
from framesift.session import materialise

TAPS = 5
FILTERS = 16
CHUNK = 256
OVERLAP = 32
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 32 << 20
EPOCHS = 12
BATCH = 64
RATE = 0.01
THRESHOLD = 0.3
#: Chunks that are convolved together.
TOGETHER = 64


@dataclass
class Network:
    taps: np.ndarray    # (TAPS, 256, FILTERS)
    bias: np.ndarray    # (FILTERS,)
    out: np.ndarray     # (FILTERS,)
    shift: float

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maxima, their places) of chunks of equal length, both (chunks, FILTERS)."""
        n = chunks.shape[1] - TAPS + 1
        value = self.taps[0][chunks[:, :n]]
        for j in range(1, TAPS):
            value += self.taps[j][chunks[:, j:j + n]]
        at = value.argmax(axis=1)
        return np.maximum(np.take_along_axis(value, at[:, None], 1)[:, 0] + self.bias, 0), at

    def maxima(self, chunks: np.ndarray) -> np.ndarray:
        n = chunks.shape[1] - TAPS + 1
        best = np.empty((len(chunks), FILTERS), np.float32)
        for a in range(0, len(chunks), TOGETHER):
            part = chunks[a:a + TOGETHER]
            value = self.taps[0][part[:, :n]]
            for j in range(1, TAPS):
                value += self.taps[j][part[:, j:j + n]]
            value.max(axis=1, out=best[a:a + TOGETHER])
        return np.maximum(best + self.bias, 0)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled.astype(np.float64) @ self.out + self.shift, -30, 30)))


def cut(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte) of the chunks of texts of these lengths; the last chunk ends with its text."""
    step = CHUNK - OVERLAP
    n = np.maximum(1, -(-(length - OVERLAP) // step))
    row = np.repeat(np.arange(len(length)), n)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
    return row, np.minimum(first, np.maximum(length[row] - CHUNK, 0))


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The chunks that begin at `start` and have `length` bytes, padded with zero bytes."""
    at = start[:, None] + np.arange(CHUNK)
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    out = data[np.minimum(at, len(data) - 1)]
    out[np.arange(CHUNK) >= length[:, None]] = 0
    return out


def score_texts(column: pa.Array, net: Network) -> np.ndarray:
    data, offsets = buffers(column)
    score = np.zeros(len(column))
    for lo, hi in slices(offsets):
        begin, length = offsets[lo:hi], np.diff(offsets[lo:hi + 1])
        row, first = cut(length)
        total = np.zeros((hi - lo, FILTERS))
        for a in range(0, len(row), 4096):
            r, f = row[a:a + 4096], first[a:a + 4096]
            best = net.maxima(gather(data, begin[r] + f, np.minimum(length[r] - f, CHUNK)))
            edge = np.flatnonzero(np.diff(r, prepend=-1))
            total[r[edge]] += np.add.reduceat(best.astype(np.float64), edge, axis=0)
        score[lo:hi] = net.probability(total / np.bincount(row, minlength=hi - lo)[:, None])
    return score


def fit(chunks: np.ndarray, row: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Learn from chunks (n, CHUNK), the document of each (sorted) and the documents' labels, by Adam."""
    rng = np.random.default_rng(seed)
    share = float(label.mean()) if len(label) else 0.5
    net = Network((rng.standard_normal((TAPS, 256, FILTERS)) * 0.3).astype(np.float32), np.zeros(FILTERS, np.float32),
                  rng.standard_normal(FILTERS) * 0.1, 0.0)
    if not (len(label) and 0 < share < 1):
        net.out[:] = 0
        net.shift = 30.0 * (share - 0.5) * 2
        return net
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))  # both classes weigh the same
    begin = np.searchsorted(row, np.arange(len(label) + 1))
    params = [net.taps, net.bias, net.out, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(label))
        for a in range(0, len(order), BATCH):
            docs = order[a:a + BATCH]
            n = begin[docs + 1] - begin[docs]
            picked = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), n)
            part = chunks[picked]
            best, at = net.pooled(part)
            mean = np.zeros((len(docs), FILTERS))
            np.add.at(mean, own, best)
            mean /= n[:, None]
            p = net.probability(mean)
            error = (p - label[docs]) * weight[docs] / len(docs)
            inner = (error[:, None] * net.out / n[:, None])[own] * (best > 0)
            grads = [np.zeros_like(net.taps), inner.sum(axis=0), mean.T @ error + 1e-4 * net.out, np.array([error.sum()])]
            filters = np.broadcast_to(np.arange(FILTERS), at.shape)
            for j in range(TAPS):
                np.add.at(grads[0][j], (part[np.arange(len(part))[:, None], at + j], filters), inner)
            step += 1
            for k, (param, grad) in enumerate(zip(params, grads)):
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.001 * (grad * grad - second[k])
                param -= (rate * (first[k] / (1 - 0.9 ** step))
                          / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(param.dtype)
            net.shift = float(params[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Learn from docs (doc_id, text) and labels (doc_id, label), of documents that are not held out."""
    labels = (labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(fold() != 0)
              .groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label")))
    size = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    labels = materialise(labels.join(size, "doc_id").where(F.col("bytes") <= sample_bytes // 100)
                         .groupBy("doc_id", "label").agg(F.sum("bytes").alias("bytes")), "labels")
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()  # a row a class
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("label") == r["label"], min(1.0, sample_docs / r["n"], sample_bytes / max(r["bytes"], 1))).otherwise(share)
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # Bounded by sample_docs for each class, so it may be broadcast.
    chosen = labels.where(chance < share).select("doc_id", "label")
    sample = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes // 100).join(
        F.broadcast(chosen), "doc_id")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            length = np.diff(offsets)
            row, first = cut(length)
            for k in range(0, len(row), 2000):
                r, f = row[k:k + 2000], first[k:k + 2000]
                body = gather(data, offsets[r] + f, np.minimum(length[r] - f, CHUNK))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(r)), batch.column("label").take(pa.array(r)),
                     pa.array([x.tobytes() for x in body], pa.binary())], ["doc_id", "label", "chunk"])
    kind = sample.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(some, f"doc_id {kind}, label int, chunk binary").toPandas()
    if not len(found):
        return fit(np.zeros((0, CHUNK), np.uint8), np.zeros(0, np.int64), np.zeros(0))
    found = found.sort_values(["doc_id", "chunk"], kind="stable")
    row = found.groupby("doc_id", sort=True).ngroup().to_numpy()
    label = found.groupby("doc_id", sort=True)["label"].first().to_numpy()
    return fit(np.frombuffer(b"".join(found["chunk"]), np.uint8).reshape(-1, CHUNK), row, label)


def predict(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    slim = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(batch.column(2), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
