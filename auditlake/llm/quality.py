"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become hashed TF-IDF vectors (case-sensitive byte n-grams, word shapes, repeats) with document frequencies
over all documents. A truncated SVD of a bounded sample of labelled rows gives ``rank`` latent dimensions; the
sample's latent vectors and labels are broadcast (at most ``max_labelled`` rows of ``rank`` floats, 1 MB), and each
document is compared with all of them by exact blocked cosine products. The ``neighbours`` nearest vote with their
similarity to the power 8 as weight.

Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2; lang, source and doc_id are no features.
Defined cases: null and empty texts get the share of label 1 among the sample (1.0 if there are no labels, so that
nothing is rejected unseen); labels that are null or neither 0 nor 1 are passed over, and so
are ids that have both labels; a null id is not held out and
gives no label; repeated rows each get a score; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as T
from ._features import Features, idf, tfidf

MAX_LABELLED, RANK, NEIGHBOURS, THRESHOLD = 4000, 64, 15, 0.7


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """What the scan needs: idf, latent directions, the labelled vectors, their labels and the prior."""

    def __init__(self, features: Features, weights: np.ndarray, directions: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int) -> None:
        self.features, self.weights, self.directions, self.vectors, self.labels = features, weights, directions, vectors, labels
        self.neighbours, self.prior = min(neighbours, len(labels)), float(labels.mean()) if len(labels) else 1.0

    def latent(self, column: pa.Array) -> np.ndarray:
        z = tfidf(self.features.counts(column), self.weights) @ self.directions
        norm = np.sqrt((z * z).sum(axis=1))
        return z / np.where(norm > 0, norm, 1)[:, None]

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.prior)
        if not len(self.labels):
            return out
        z, k = self.latent(column), self.neighbours
        for at in range(0, len(z), 256):
            like = z[at : at + 256] @ self.vectors.T
            near = np.argpartition(-like, k - 1, axis=1)[:, :k] if k < like.shape[1] else np.broadcast_to(np.arange(k), like.shape)
            weight = np.maximum(np.take_along_axis(like, near, 1), 0).astype(np.float64) ** 8
            out[at : at + 256] = ((weight * self.labels[near]).sum(axis=1) + 1e-6 * self.prior) / (weight.sum(axis=1) + 1e-6)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Fit on the ``max_labelled`` labelled rows with the least hash of their id, a sample that is alike on every run."""
    features = Features(12, (1, 2, 3), fold=False, style=True)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull()).filter(~held_out("id"))
    clear = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("id", "label")
    some = clear.orderBy(F.xxhash64("id"), "id").limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, most=1 << 20):
            x = np.minimum(features.counts(batch.column(0)), 65504).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary()), batch.column(1), batch.column(2)], names=["x", "label", "h"])

    joined = texts.join(F.broadcast(some), "id").select("text", "label", F.xxhash64("id", "text").alias("h")).orderBy("h", "label").limit(max_labelled)
    rows = joined.mapInArrow(run, "x binary, label int, h long").orderBy("h", "label").toArrow()
    weights = idf(texts, features)
    y = rows.column("label").to_numpy().astype(np.float64)
    if not len(y):
        return Model(features, weights, np.zeros((features.dim, 1), np.float32), np.zeros((0, 1), np.float32), y, neighbours)
    a = np.empty((len(y), features.dim), np.float32)
    for i, x in enumerate(rows.column("x")):
        a[i] = np.frombuffer(zlib.decompress(x.as_py()), np.float16)
    a = tfidf(a, weights)
    # Truncated SVD by subspace iteration.
    basis = np.random.Generator(np.random.PCG64(3)).standard_normal((a.shape[1], rank + 16)).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(a.T @ (a @ basis))
    _, _, turn = np.linalg.svd(a @ basis, full_matrices=False)
    model = Model(features, weights, np.ascontiguousarray((basis @ turn.T)[:, :rank]).astype(np.float32), np.zeros((0, rank), np.float32), y, neighbours)
    z = a @ model.directions
    norm = np.sqrt((z * z).sum(axis=1))
    model.vectors = (z / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, most=1 << 20):
            s = shared.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, text_col, most=1 << 20):
            yield batch.filter(pa.array(shared.value.score(batch.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
