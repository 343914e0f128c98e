"""Operator 2: quality by votes of the nearest labelled documents in a latent-semantic space.

The terms of a document describe how it is written, not what language it is in: runs of
four character kinds, and words that repeat the word before them or the one before that.
A bounded sample of labelled documents gives the term weights and, by a singular value
decomposition, the latent space; their vectors and labels form a block of bounded size
that is broadcast. Every document is met with all of them in blocks of exact cosine
products, and the labels of the nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .shingles import word_hashes

#: Labelled documents used at most: the smallest of a hash of their ids, so any order gives the same.
SAMPLE = 4096
RANK = 64
NEIGHBOURS = 9
#: Votes count as a power of the cosine.
SHARPNESS = 8
THRESHOLD = 0.7
KINDS = 12
TERMS = 2048
#: Weight of the two terms for repeated words.
REPEAT_WEIGHT = 2.0


def kind_table() -> np.ndarray:
    """Kind of each byte: blank, break, small, capital, digit, five groups of marks, other, beyond ASCII."""
    kinds = np.full(256, 10, np.uint32)
    for n, chars in enumerate([" \t", "\n\r\f\v", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", "|<>", "#*$%&"]):
        kinds[[ord(c) for c in chars]] = n
    kinds[128:] = 11
    return kinds


KIND = kind_table()


def terms(text: str | None) -> np.ndarray:
    """Square roots of the shares of all terms; zeros for a text without terms."""
    out = np.zeros(TERMS + 2, np.float32)
    data = np.frombuffer((text or "").encode(), np.uint8)
    if len(data):
        kind = KIND[data]
        if len(kind) < 4:
            kind = np.append(np.ones(4 - len(kind), np.uint32), kind)
        gram = ((kind[:-3] * KINDS + kind[1:-2]) * KINDS + kind[2:-1]) * KINDS + kind[3:]
        gram = (gram * np.uint32(2654435761)) >> np.uint32(21)
        out[:TERMS] = np.sqrt(np.bincount(gram, minlength=TERMS) / len(gram))
        words = word_hashes(data)
        for n in (1, 2):
            if len(words) > n:
                out[TERMS + n - 1] = np.sqrt(np.count_nonzero(words[n:] == words[:-n]) / len(words))
    return out


@dataclass
class Model:
    """Term weights, latent axes (terms x rank), and the labelled vectors with their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        out = (rows * self.weights) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Weighted share of label 1 among the nearest; the share of all labels without any."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosine = self.latent(rows) @ self.vectors.T
        n = min(neighbours, len(self.labels))
        near = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.labels.mean())


def fit_rows(rows: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    seen = np.count_nonzero(rows, axis=0)
    weights = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
    weights[TERMS:] *= REPEAT_WEIGHT
    scaled = rows * weights
    values, axes = np.linalg.eigh(scaled.T.astype(np.float64) @ scaled.astype(np.float64)) if len(rows) else (np.zeros(1), np.zeros((TERMS + 2, 1)))
    axes = axes[:, ::-1][:, :rank].astype(np.float32)
    model = Model(weights, np.ascontiguousarray(axes), np.zeros((0, axes.shape[1]), np.float32), labels.astype(float))
    model.vectors = model.latent(rows)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold.

    The sample is drawn from ``labels`` by a hash of the id; ids that ``docs`` lacks are
    passed over, of rows that repeat an id one is used. Terms are computed where the texts
    are; one task gathers the sample's term vectors (sample x TERMS half floats, 16 MB)
    and does the decomposition.
    """
    usable = labels.filter(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = usable.withColumn("_h", F.xxhash64(F.lit(5), "doc_id")).orderBy("_h", "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text")).orderBy("doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t.as_py()).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["quality", "terms"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [np.zeros((0, TERMS + 2), np.float32)], []
        for batch in batches:
            rows += [np.frombuffer(t.as_py(), np.float16).astype(np.float32)[None] for t in batch.column(1)]
            labels += batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows(np.concatenate(rows), np.array(labels)))], pa.binary())], ["model"])

    rows = chosen.select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(vectors, "quality int, terms binary")
    found = rows.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit_rows(np.zeros((0, TERMS + 2), np.float32), np.zeros(0))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def score(self, rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Weighted share of label 1 among the nearest; the share of all labels without any."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosine = self.latent(rows) @ self.vectors.T
        n = min(neighbours, len(self.labels))
        near = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, votes / np.where(total > 0, total, 1), self.labels.mean())


def fit_rows(rows: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    seen = np.count_nonzero(rows, axis=0)
    weights = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
    weights[TERMS:] *= REPEAT_WEIGHT
    scaled = rows * weights
    values, axes = np.linalg.eigh(scaled.T.astype(np.float64) @ scaled.astype(np.float64)) if len(rows) else (np.zeros(1), np.zeros((TERMS + 2, 1)))
    axes = axes[:, ::-1][:, :rank].astype(np.float32)
    model = Model(weights, np.ascontiguousarray(axes), np.zeros((0, axes.shape[1]), np.float32), labels.astype(float))
    model.vectors = model.latent(rows)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold.

    The sample is drawn from ``labels`` by a hash of the id; ids that ``docs`` lacks are
    passed over, of rows that repeat an id one is used. Terms are computed where the texts
    are; one task gathers the sample's term vectors (sample x TERMS half floats, 16 MB)
    and does the decomposition.
    """
    usable = labels.filter(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = usable.withColumn("_h", F.xxhash64(F.lit(5), "doc_id")).orderBy("_h", "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text")).orderBy("doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t.as_py()).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["quality", "terms"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [np.zeros((0, TERMS + 2), np.float32)], []
        for batch in batches:
            rows += [np.frombuffer(t.as_py(), np.float16).astype(np.float32)[None] for t in batch.column(1)]
            labels += batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows(np.concatenate(rows), np.array(labels)))], pa.binary())], ["model"])

    rows = chosen.select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(vectors, "quality int, terms binary")
    found = rows.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit_rows(np.zeros((0, TERMS + 2), np.float32), np.zeros(0))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents outside the held-out fold, one row per document id."""
    usable = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality").dropDuplicates(["doc_id"])
    return docs.select("doc_id", "text").join(usable, "doc_id")


def score(docs: DataFrame, model: Model, block: int = 512) -> DataFrame:
    """``docs`` with score and predicted for every row; a null text counts as an empty one.

    An empty text has no terms, so all labels vote. Rows are independent, other columns
    pass through (own ones named ``score`` or ``predicted`` are replaced). The broadcast model holds at
    most SAMPLE vectors of RANK and the axes, about 2 MB.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(shared.value)
        for batch in batches:
            texts, scores = batch.column("text"), [np.zeros(0)]
            for start in range(0, len(texts), block):
                rows = np.stack([terms(t.as_py()) for t in texts.slice(start, block)])
                scores.append(own.score(rows))
            value = np.concatenate(scores)
            columns = [*batch.columns, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
