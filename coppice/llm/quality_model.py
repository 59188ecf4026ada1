"""Quality classifier: similarity-weighted votes of the nearest labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices

TRIGRAMS, BYTES, SHAPES = 1024, 256, 8
WIDTH = TRIGRAMS + BYTES + SHAPES
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def features(texts: list[str | None]) -> np.ndarray:
    """float32 [texts, WIDTH]: roots of the shares of hashed character trigrams, of bytes and of word shapes.

    Empty texts are zero vectors.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    n = len(raw)
    sizes = np.fromiter(map(len, raw), np.int64, n)
    b = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    low = _FOLD[b].astype(np.uint32)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    low[space] = 32
    before, after = np.concatenate([[32], low[:-1]]).astype(np.uint32), np.concatenate([low[1:], [32]]).astype(np.uint32)
    h = (before * np.uint32(0x9E3779B1)) ^ (low * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    h = h * np.uint32(0x27D4EB2F)
    keep = ~space
    tri = np.bincount(doc[keep] * TRIGRAMS + (h[keep] >> np.uint32(22)).astype(np.int64), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    byte = np.bincount(doc * BYTES + b, minlength=n * BYTES).reshape(n, BYTES)
    byte[:, 10] -= 1  # the line end added above
    begins = keep.copy()
    begins[1:] &= space[:-1]
    at = np.flatnonzero(begins)
    shape = np.zeros((n, SHAPES), np.float64)
    if len(at):
        word_doc = doc[at]
        mixed = (h.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B185EBCA87)
        mixed[space] = 0
        word = np.add.reduceat(mixed, at)
        count = lambda x, d=word_doc: np.bincount(d, weights=x, minlength=n)
        words = np.maximum(count(np.ones(len(at))), 1)
        same = np.zeros(len(at))
        same[1:] = (word[1:] == word[:-1]) & (word_doc[1:] == word_doc[:-1])
        upper = np.add.reduceat(((b >= 65) & (b <= 90)).astype(np.int64), at)
        letters = np.add.reduceat((((low >= 97) & (low <= 122)) | (b >= 128)).astype(np.int64), at)
        order = np.lexsort((word, word_doc))
        again = np.zeros(len(at))
        again[order[1:]] = (word[order][1:] == word[order][:-1]) & (word_doc[order][1:] == word_doc[order][:-1])
        shape[:, 0], shape[:, 1] = count(same) / words, count(again) / words
        shape[:, 2], shape[:, 3] = count((upper > 1).astype(float)) / words, count((letters == 0).astype(float)) / words
        shape[:, 4] = 1 / np.sqrt(words)
    size = np.maximum(sizes - 1, 1)[:, None]
    out = np.concatenate([np.sqrt(tri / np.maximum(tri.sum(1, keepdims=True), 1)), np.sqrt(np.maximum(byte, 0) / size), np.sqrt(shape)], axis=1).astype(np.float32)
    return out


@dataclass(frozen=True)
class Model:
    basis: np.ndarray  # float32 [WIDTH, rank]
    vectors: np.ndarray  # float32 [labelled, rank], unit rows
    labels: np.ndarray
    prior: float
    neighbours: int
    power: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """In [0, 1]; the share of label 1 where no neighbour has a positive similarity."""
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        z = self.embed(features(texts))
        for i in range(0, len(z), 256):
            sim = z[i : i + 256] @ self.vectors.T
            near = nearest(sim, k)
            w = np.maximum(np.take_along_axis(sim, near, 1), 0).astype(np.float64) ** self.power
            total = w.sum(1)
            vote = (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
            out[i : i + 256] = np.where(total > 1e-9, vote, self.prior)
        return np.clip(out, 0, 1)


def nearest(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest values of each row, in order; of equal ones at the border, the first."""
    least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k, None]
    above, equal = sim > least, sim == least
    taken = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(taken)[1].reshape(len(sim), k)


def latent_basis(x: np.ndarray, rank: int, seed: int = 0, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of x by subspace iteration, scaled by their values' inverse roots."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    return ((q @ vt.T)[:, :rank] / np.sqrt(np.maximum(s[:rank], 1e-6))).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 6000, rank: int = 64, neighbours: int = 15, power: float = 24.0, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most ``most_labelled`` labelled documents, drawn by a hash of the id from ``labels``.

    Null labels, null ids and ids without a document are left out; of labels that contradict one
    another within an id the greater counts, of documents that repeat an id the one whose
    text has the least hash.  Of neighbours that are equally near, those whose id has the least hash
    count.  Without labels every score is 0.5.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")  # at most ``most_labelled`` rows
    drawn = drawn.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label", F.xxhash64("id").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=512):
            x = features(b.column("text").to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "h", "x"])

    got = drawn.mapInArrow(run, "label int, h long, x binary").toArrow()
    y = np.asarray(got["label"].to_pylist(), np.float64)
    if not len(y):
        return Model(np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5, neighbours, power)
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(len(y), WIDTH).astype(np.float32)
    order = np.lexsort((y, got["h"].to_numpy()))
    x, y = x[order], y[order]
    basis = latent_basis(x, min(rank, len(y)))
    model = Model(basis, np.zeros((0, 1)), y, float(y.mean()), neighbours, power)
    return Model(basis, model.embed(x), y, model.prior, neighbours, power)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=1024):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def training_labels(labels: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    return labels.where(fold(id_col, folds) != 0)
