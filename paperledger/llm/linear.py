"""Logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are counts of hashed n-grams of its words and of its word shapes (runs of letters,
digits and each other character, and whether the word repeats the one before it), divided by the
number of its words. A score is the sparse dot product of these with the weights.

Training rows are dealt into a fixed number of shards by the hash of their id. Every shard makes its
passes of updates, and the shards' weights are averaged with Spark. The weights are of fixed size
(2**bits doubles), whatever the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, ship_package
from . import bytesops as B
from .common import ddl

#: Features are hashed to 2**BITS weights: 2 MB in all.
BITS = 18
#: At most this many labelled rows are used: those with the smallest hashes of their ids.
MOST_LABELS = 50_000
SHARDS = 8
EPOCHS = 3
#: Weights in one row on their way from the shards to their mean.
PIECE = 1 << 15

# Classes of bytes in a word's shape: letters of either case (bytes over 127 count as lower case),
# digits, and every other byte for itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3


def _shape_hashes(w: B.Words) -> np.ndarray:
    """Hash of each word's run-length-free shape, and of whether it repeats the word before it."""
    if not len(w.start):
        return np.zeros(0, B.U)
    kind = _CLASS[w.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    where = np.concatenate(([0], np.cumsum(new)))
    h = B.rolling_bytes(kind[new]).stretch(where[w.start], where[w.end])
    again = np.zeros(len(h), B.U)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    return B.mix(h + again)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature number and text number of every n-gram (with repeats), and the words of each text."""
    w = B.Words(data, offsets)
    shapes = _shape_hashes(w)
    index, text = [], []
    for h, salt, most in ((w.hash, 0x100, 2), (shapes, 0x200, 3)):
        gram = h
        for n in range(1, most + 1):
            if n > 1:
                gram = B.mix(gram[:-1] * B.U(0x9E3779B97F4A7C15) + h[n - 1 :])
            ok = w.text[: len(gram)] == w.text[n - 1 :]
            index.append((B.mix(gram[ok] ^ B.U(salt + n)) >> B.U(64 - bits)).astype(np.int64))
            text.append(w.text[: len(gram)][ok])
    return np.concatenate(index), np.concatenate(text), w.counts


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.02) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.n, self.z = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - y) * x
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


#: Share of a text's mass in one feature is multiplied by this before it enters the model.
SCALE = 20.0

ROWS = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])


def _vectors(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            index, text, words = features(*B.utf8(batch.column("text")), bits)
            key, count = np.unique(text << bits | index, return_counts=True)
            text, at = key >> bits, (key & ((1 << bits) - 1)).astype("<i4")
            x = (SCALE * count / words[text]).astype("<f4")
            edges = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            cut = lambda v: pa.array([v[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "doc_id", "label")), cut(at), cut(x)], schema=ROWS)

    return run


def _passes(size: int, classes: int, epochs: int):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("doc_id").to_pylist(), group.column("label").to_pylist(), group.column("at").to_pylist(), group.column("x").to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
        models = [Ftrl(size) for _ in range(classes)]
        for epoch in range(epochs):
            np.random.default_rng(epoch).shuffle(rows)
            for _, label, at, x in rows:
                at = np.append(np.frombuffer(at, "<i4"), size - 1)
                x = np.append(np.frombuffer(x, "<f4").astype(float), 1.0)
                for c, m in enumerate(models):
                    m.update(at, x, float(label == c) if classes > 1 else float(label))
        w = np.stack([m.weights() for m in models]).astype("<f4").ravel()
        pieces = [w[a : a + PIECE].tobytes() for a in range(0, len(w), PIECE)]
        return pa.table({"piece": pa.array(range(len(pieces)), pa.int32()), "w": pa.array(pieces, pa.binary())})

    return run


def _mean(group: pa.Table) -> pa.Table:
    w = np.mean([np.frombuffer(x, "<f4") for x in group.column("w").to_pylist()], axis=0, dtype=np.float64).astype("<f4")
    return pa.table({"piece": group.column("piece").slice(0, 1), "w": pa.array([w.tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, classes: int = 1, bits: int = BITS, most_labels: int = MOST_LABELS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (one row for each class, one against the rest, or a single row for labels 0 and 1; the
    last column is the bias) from ``labels`` (doc_id, label).

    At most ``most_labels`` labelled rows are used, those with the smallest hashes of their ids, so
    what is broadcast to find their texts has a fixed bound. Null labels, null ids and labels of
    unknown documents are left out; a document with several labels has the smallest. Without any
    label all weights are 0.
    """
    ship_package(docs.sparkSession)
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = materialize(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels), "labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "label", "text")
    rows = rows.mapInArrow(_vectors(bits), ddl(ROWS))
    size = (1 << bits) + 1
    passed = rows.groupBy("shard").applyInArrow(_passes(size, classes, epochs), "piece int, w binary")
    pieces = sorted(map(tuple, passed.groupBy("piece").applyInArrow(_mean, "piece int, w binary").collect()))
    if not pieces:
        return np.zeros((classes, size), np.float32)
    return np.frombuffer(b"".join(w for _, w in pieces), "<f4").reshape(classes, size)


def _scores(weights: np.ndarray, with_text: bool):
    bits = (weights.shape[1] - 1).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            index, text, words = features(*B.utf8(batch.column("text")), bits)
            out = []
            for w in weights:
                total = np.bincount(text, weights=w[index], minlength=batch.num_rows) if len(index) else np.zeros(batch.num_rows)
                logit = float(w[-1]) + SCALE * total / np.maximum(words, 1)
                out.append(1.0 / (1.0 + np.exp(-np.clip(logit, -35, 35))))
            scores = np.stack(out, axis=1)
            sizes = np.full(batch.num_rows, len(weights))
            flat = pa.array(scores.ravel())
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            keep = [batch.column(k) for k in range(batch.num_columns) if with_text or batch.schema.names[k] != "text"]
            names = [n for n in batch.schema.names if with_text or n != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(words, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=[*names, "n_words", "scores"])

    return run


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns ``keep``, n_words, and scores (one sigmoid for each row of ``weights``) of every text;
    ``with_text`` returns the texts too, without shuffling them.

    Null texts count as empty; empty ones have the score of the bias alone. Columns named n_words or
    scores can't be kept: that is an error."""
    if {"n_words", "scores"} & {k.lower() for k in keep}:
        raise ValueError("n_words and scores are columns of the result")
    ship_package(docs.sparkSession)
    rows = docs.select(*dict.fromkeys((*keep, "text")))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if with_text or f.name != "text")
    return rows.mapInArrow(_scores(weights, with_text), f"{shape}, n_words bigint, scores array<double>")


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
