"""Operator 12: whitening of embeddings by a bidiagonal qd solver.

Entries become integers, so sums per dimension and deviations are exact. Every task reduces
its centred rows to one triangular factor, batch after batch; factors of 64 tasks at a time
are stacked and reduced again until one is left, whose size is that of the dimensions. Its
right singular vectors, found on the driver (``bidiagonal.py``), are the components, and all
rows are projected on them where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import EPS, right_vectors
from .common import written

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Factors that one task stacks.
STACKED = 64
#: Singular values below this share of the largest, times the dimensions, are rounding.
LEAST = 1e5 * EPS
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Model(NamedTuple):
    """What whitens a row: counts, exact sums, mean in two parts, directions over their deviation."""

    n: int
    sums: list[int]
    base: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    explained: np.ndarray


def vectors_of(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length in a column; null and empty ones are left out."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.astype(float).reshape(len(rows), size)


def integers(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x`` of the usable rows: x = floor(64 c) + 1000000 of every entry c."""
    schema = f"{id} long, x array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in vectors_of(batch.column(1)):
                fits = (np.abs(SCALE * values) < 2.0**62).all(axis=1)  # false for nan, inf and null
                x = np.floor(SCALE * values[fits]).astype(np.int64) + OFFSET
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                lists = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[fits])), lists], [id, "x"])

    return vectors.select(F.col(id).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def exact_sum(matrix: np.ndarray, axis: int) -> np.ndarray:
    """Sums of integers; beyond 63 bits as Python integers."""
    if matrix.size and matrix.dtype != object and int(np.abs(matrix).max()) * matrix.shape[axis] >= 2**63:
        matrix = matrix.astype(object)
    return matrix.sum(axis=axis)


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(1)
    return column.flatten().to_numpy().reshape(len(column), -1)


def column_sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every dimension; one row a dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, object), 0
        for batch in batches:
            if len(batch):
                total, n = total + exact_sum(matrix_of(batch), 0).astype(object), n + len(batch)
        sums = pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), sums, pa.array([n] * size, pa.int64())], ["at", "s", "n"])

    found = rows.mapInArrow(run, "at long, s decimal(38,0), n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    kept = sorted(found.collect())
    return (kept[0].n, [int(r.s) for r in kept]) if kept else (0, [])


def centred(x: np.ndarray, model: Model) -> np.ndarray:
    return (x - model.base).astype(float) - model.rest


def triangular(blocks: np.ndarray) -> np.ndarray:
    """Factor R of a QR decomposition, square."""
    size = blocks.shape[1]
    factor = np.linalg.qr(blocks, mode="r")
    return np.vstack([factor, np.zeros((size - len(factor), size))])


def blockwise_factor(rows: DataFrame, model: Model) -> np.ndarray:
    """R of all centred rows: one factor a task, then stacks of them."""
    size = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, any_rows = np.zeros((size, size)), False
        for batch in batches:
            if len(batch):
                factor, any_rows = triangular(np.vstack([factor, centred(matrix_of(batch), model)])), True
        if any_rows:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([factor.ravel().tolist()])], ["part", "r"])

    def stack(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("part")
        factor = np.zeros((size, size))
        for row in held["r"]:
            factor = triangular(np.vstack([factor, np.asarray(row).reshape(size, size)]))
        return pd.DataFrame({"part": [int(held["part"].iloc[0]) // STACKED], "r": [factor.ravel()]})

    schema = "part long, r array<double>"
    factors = written(rows.mapInArrow(run, schema), "factors")
    while factors.count() > 1:
        groups = factors.groupBy(F.floor(F.col("part") / STACKED))
        factors = written(groups.applyInPandas(stack, schema), "factors")
    return np.array(factors.first().r).reshape(size, size)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The whitening of ``rows`` (id, x of one length); None without rows."""
    first = rows.select(F.size("x")).first()
    if first is None:
        return None
    n, sums = column_sums(rows, first[0])
    base = [s // n for s in sums]
    rest = np.array([(s - n * b) / n for s, b in zip(sums, base, strict=True)])
    model = Model(n, sums, np.array(base, np.int64), rest, np.zeros((first[0], 0)), np.zeros(0))
    factor = blockwise_factor(rows, model)
    squares, axes = right_vectors(factor)
    size = len(squares)
    usable = int((squares > squares.max(initial=0) * (LEAST * size) ** 2).sum()) if squares.any() else 0
    kept = slice(0, min(components, usable))
    axes = axes[:, kept]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return model._replace(axes=axes / np.sqrt(squares[kept] / n), explained=squares[kept] / (factor**2).sum())


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of the whitened rows, less the identity."""
    k = model.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if len(batch):
                z = centred(matrix_of(batch), model) @ model.axes
                products, sums = products + z.T @ z, sums + z.sum(axis=0)
        flat = np.append(products.ravel(), sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "s"])

    found = rows.mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s"))
    flat = np.array([s for _, s in sorted(map(tuple, found.collect()))]) / model.n
    mean = flat[k * k :]
    return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, model: Model) -> np.ndarray:
    """Sum over the dimensions of (n x - S)^2, exact; an error if it passes 63 bits."""
    small = np.abs(x).max() if x.size else 0
    if model.n * int(small) + max(map(abs, model.sums)) < 2**62:
        difference = model.n * x - np.array(model.sums, np.int64)
        if (float(np.abs(difference).max()) + 1) ** 2 * x.shape[1] < 2.0**62:
            return (difference**2).sum(axis=1)
    difference = model.n * x.astype(object) - np.array(model.sums, object)
    return np.array([int(s) for s in (difference**2).sum(axis=1)], np.int64)


def whitened(vectors: DataFrame, components: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component: n, deviation, whitened, explained, identity_error.

    A vector that is null or holds a null, infinite or undefined entry (or one whose integer
    passes 62 bits) is left out, and so are the vectors that have another length than most
    (of equally frequent lengths the longest counts). A null id stays null; repeated rows
    count and come out each for itself. Directions without variance are no components, so
    equal vectors, a single one or none give no rows. Other columns are not read. A deviation
    of more than 63 bits ends the job with an error rather than with a wrong number.
    """
    spark = vectors.sparkSession
    rows = written(integers(vectors, id, vector), "integers").withColumnRenamed(id, "vec_id")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], OUT)
    rows = rows.filter(F.size("x") == sizes[0])
    model = fit(rows, components)
    if not model.axes.shape[1]:
        return spark.createDataFrame([], OUT)
    return rows.mapInArrow(projection(model, identity_error(rows, model)), OUT)


def projection(model: Model, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = model.axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix_of(batch)
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n, np.int64)),
                pa.array(deviations(x, model)[each]),
                pa.array((centred(x, model) @ model.axes).ravel()),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in OUT.split(", ")])

    return run
