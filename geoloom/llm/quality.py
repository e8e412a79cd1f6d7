"""Quality classifier by nearest-neighbour voting among latent-semantic vectors.

A text is a bag of hashed features of its writing: runs of three and five
character kinds (capital, small letter, digit, space, line end, or the sign
itself), whether a word repeats the one before or one seen shortly before, and
word lengths. Damped by log(1 + rate), weighted by rarity and projected on the
leading singular vectors of a labelled sample they are its latent-semantic
vector. The sample's vectors are broadcast; every document's cosine with every
one of them is computed exactly, in blocks, and the nearest vote with their
similarity.

Neighbours equally near as the last that votes have the same weight; which of them
votes is not fixed. Very long texts count whole. Rows that repeat are scored
each. No rows give no rows; columns other than id, text and label play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from geoloom.llm.common import fresh, octets, small_batches

#: Labelled rows the model is fitted on at most, chosen by hash of the id. This bounds the broadcast and the driver's share.
SAMPLE = 4000
BUCKETS = 2048
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8.0  # power of the similarity in a vote
CUT = 0.3
KINDS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else 10 if c in (10, 13) else 32 if c in (9, 11, 12, 32) else c for c in range(256))
WORD_BUCKETS = 64  # further ones, for features of words


def features(text: bytes | None) -> np.ndarray:
    """Rates per thousand of hashed features; all nought for a text without bytes."""
    text = text or b""
    out = np.zeros(BUCKETS + WORD_BUCKETS, np.float32)
    if not text:
        return out
    kind = np.frombuffer(text.translate(KINDS), np.uint8)
    kind = kind[np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | ((kind[1:] != 97) & (kind[1:] != 65))))]  # letters of a kind in a row count once
    kind = np.concatenate((np.full(2, 10, np.uint8), kind, np.full(2, 10, np.uint8))).astype(np.uint32)
    n = len(kind) - 4
    three = (kind[1:-3] * np.uint32(0x9E3779B1) + kind[2:-2] * np.uint32(0x85EBCA77) + kind[3:-1] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)
    five = ((kind[:-4] * np.uint32(0x27D4EB2F) ^ kind[4:] * np.uint32(0x165667B1)) + three * np.uint32(0x9E3779B1)) >> np.uint32(22)
    out[:1024] = np.bincount(three, minlength=1024)
    out[1024:2048] = np.bincount(five, minlength=1024)
    out *= 1000.0 / n
    words = text.lower().split()
    if words:
        rate = 1000.0 / len(words)
        out[BUCKETS] = 4 * rate * sum(map(bytes.__eq__, words, words[1:]))
        recent: dict[bytes, int] = {}
        near = 0
        for i, w in enumerate(words):
            if len(w) > 8:
                near += i - recent.get(w, -100) <= 50
                recent[w] = i
        out[BUCKETS + 1] = 4 * rate * near
        out[BUCKETS + 2 : BUCKETS + 32] = rate * np.bincount(np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 29), minlength=30)
    return out


@dataclass
class Model:
    weight: np.ndarray  # of each feature
    axes: np.ndarray  # features x dimensions
    vectors: np.ndarray  # of the labelled sample, of length one
    labels: np.ndarray
    prior: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = (np.log1p(x) * self.weight) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by cosine. A text without features has the prior."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(x), block):
            cosine = self.embed(x[at : at + block]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** SHARPNESS
            out[at : at + block] = (w * self.labels[near]).sum(1) / w.sum(1)
        out[~x.any(1)] = self.prior
        return np.clip(out, 0.0, 1.0)


def _solve(x: np.ndarray, labels: np.ndarray, dimensions: int) -> Model:
    """Rarity weights, leading right singular vectors by subspace iteration, the sample's vectors."""
    if not len(x):
        return Model(np.ones(BUCKETS + WORD_BUCKETS, np.float32), np.zeros((BUCKETS + WORD_BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    weight = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    a = np.log1p(x) * weight
    q = np.random.default_rng(7).standard_normal((a.shape[1], min(dimensions + 16, *a.shape))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, s, vt = np.linalg.svd(a @ q, full_matrices=False)
    axes = (q @ vt.T)[:, :dimensions].astype(np.float32)
    model = Model(weight, axes, np.zeros((0, axes.shape[1]), np.float32), labels, float(labels.mean()))
    model.vectors = model.embed(x).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """A model of at most ``sample`` labelled rows, those of the smallest id hash.

    Labels other than 0 and 1 are not used. Of repeated labels of an id the
    smallest counts, of repeated documents the one of smallest features. Without
    labelled documents every score is a half.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2):
            rows = [features(t) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            packed = [i.astype("<u2").tobytes() + r[i].astype("<f4").tobytes() for i, r in zip(at, rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["i", "y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("i"), octets(text_col).alias("t")).join(F.broadcast(chosen), "i").select("i", "y", "t")
    rows = texts.mapInArrow(run, "i long, y int, x binary").groupBy("i").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("i").collect()
    x = np.zeros((len(rows), BUCKETS + WORD_BUCKETS), np.float32)
    for row, r in zip(x, rows):
        n = len(r.x) // 6
        row[np.frombuffer(r.x, "<u2", n)] = np.frombuffer(r.x, "<f4", n, 2 * n)
    return _solve(x, np.array([r.y for r in rows], np.float64), dimensions)


def _scored(docs: DataFrame, model: Model, at: int, out: str, keep_from: float | None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, at):
            texts = b.column(at).to_pylist()
            score = np.concatenate([held.value.scores(np.stack([features(t) for t in texts[i : i + 512]])) for i in range(0, len(texts), 512)]) if texts else np.empty(0)
            columns = [c for i, c in enumerate(b.columns) if i != at]
            if keep_from is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], [*(n for i, n in enumerate(b.schema.names) if i != at), out])
            else:
                yield b.filter(pa.array(score >= keep_from))

    kinds = StructType([f for i, f in enumerate(docs.schema) if i != at])
    return docs.mapInArrow(run, kinds.add(out, DoubleType()) if keep_from is None else docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id score`` of every row, by its whole text. Null and empty texts have the share of label 1 in the sample."""
    return _scored(docs.select(F.col(id_col).alias("doc_id"), octets(text_col).alias("t")), model, 1, "score", None)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score ``cut`` or more, unchanged. No shuffle."""
    (text,) = fresh(docs, "t")
    return _scored(docs.withColumn(text, octets(text_col)), model, len(docs.columns), "", cut).drop(text)
