"""Whitening against LAPACK and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from storytrends.llm import bidiagonal, queries, whiten

RNG = np.random.default_rng(3)
TURN = np.linalg.qr(RNG.standard_normal((40, 40)))[0]
MATRICES = {
    "one": np.array([[2.0]]),
    "two": RNG.standard_normal((2, 2)),
    "random": np.linalg.qr(RNG.standard_normal((500, 40)), mode="r"),
    "equal values": TURN @ np.diag([5.0] * 20 + [1.0] * 20) @ TURN.T,
    "nearly equal values": TURN @ np.diag(1 + 1e-13 * np.arange(40)) @ TURN.T,
    "close values": TURN @ np.diag(1 + 1e-7 * np.arange(40)) @ TURN.T,
    "few rows": np.vstack([RNG.standard_normal((9, 40)), np.zeros((31, 40))]),
    "constant columns": np.hstack([RNG.standard_normal((40, 35)), np.zeros((40, 5))]),
    "identity": np.eye(12) * 3,
    "zero": np.zeros((5, 5)),
    "Wilkinson": np.linalg.cholesky(np.diag(np.abs(np.arange(-10.0, 11)) + 3) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)).T,
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_vectors_equal_lapack(name):
    matrix = MATRICES[name]
    squares, axes = bidiagonal.right_vectors(matrix)
    expected = np.linalg.svd(matrix, compute_uv=False) ** 2
    scale = max(expected[0], 1e-300)
    assert np.abs(squares - expected).max() <= 1e-13 * scale
    kept = expected > 1e-16 * scale
    size = int(kept.sum()) if expected[0] else 0
    assert np.abs((axes.T @ axes - np.eye(len(matrix)))[:size, :size]).max(initial=0) < 1e-10
    assert np.abs(matrix.T @ (matrix @ axes) - squares * axes).max() <= 1e-11 * scale


def test_small_singular_values_are_accurate():
    """A graded bidiagonal matrix: values from 1 to 1e-12 keep their relative accuracy."""
    diagonal, upper = 10.0 ** -np.arange(13.0), 10.0 ** -np.arange(0.5, 12.5)
    found = np.sqrt(bidiagonal.dqds(diagonal, upper))
    expected = np.linalg.svd(np.diag(diagonal) + np.diag(upper, 1), compute_uv=False)
    assert found[:4] == pytest.approx(expected[:4], rel=1e-13)
    assert np.prod(found) == pytest.approx(np.prod(diagonal), rel=1e-12)


def check(found, vectors: dict, components=32):
    """``vectors``: usable rows by id."""
    ids = sorted(vectors)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in vectors[i]] for i in ids], np.int64)
    n, sums = len(x), x.sum(axis=0)
    covariance = np.cov((x - 1_000_000).T.astype(float), bias=True).reshape(x.shape[1], -1)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    rank = min(components, int((values > 1e-9 * values[0]).sum()))
    table = {(r.vec_id, r.component): r for r in found}
    assert set(table) == {(i, c + 1) for i in ids for c in range(rank)} and len(found) == len(table)
    whitened = np.array([[table[i, c + 1].whitened for c in range(rank)] for i in ids])
    expected = (x - sums / n) @ axes[:, :rank] / np.sqrt(values[:rank])
    assert np.abs(np.cov(whitened.T, bias=True).reshape(rank, rank) - np.eye(rank)).max() < 1e-8
    gaps = np.abs(values[:rank, None] - values[None, :]) + np.eye(rank, len(values)) * values[0]
    for c in range(rank):
        if gaps[c].min() > 1e-4 * values[0]:
            sign = np.sign(whitened[:, c] @ expected[:, c])
            assert np.abs(whitened[:, c] - sign * expected[:, c]).max() < 1e-6
    for (i, c), r in table.items():
        row = x[ids.index(i)]
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
        assert r.explained == pytest.approx(values[c - 1] / np.trace(covariance), rel=1e-6)
        assert r.identity_error < 1e-6
    assert len({r.identity_error for r in found}) <= 1


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n int, component string")


def test_rows_that_cannot_be_used_and_other_columns(spark):
    vectors = {i: [float(np.float32(v)) for v in row] for i, row in enumerate(RNG.standard_normal((60, 5)) * [5, 3, 2, 1, 0.5])}
    rows = [(i, v, 1, "x", 2, "c") for i, v in vectors.items()]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [1e30, 0.0, 0.0, 0.0, 0.0]]
    rows += [(1000 + i, v, None, None, None, None) for i, v in enumerate(bad)]
    check(whiten.whitened(frame_of(spark, rows)).collect(), vectors)


def test_query_equals_lapack(spark, tables):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()}
    check(queries.op12_whitening(spark, tables).collect(), vectors)


def test_blocks_of_many_tasks_give_one_factor(spark, monkeypatch):
    monkeypatch.setattr(whiten, "STACKED", 3)
    vectors = {i: row.tolist() for i, row in enumerate(RNG.integers(-40, 40, (300, 6)).astype(float))}
    rows = [(i, v, 1, "x", 2, "c") for i, v in vectors.items()]
    check(whiten.whitened(frame_of(spark, rows).repartition(40)).collect(), vectors)


def test_equal_vectors_constant_entries_and_empty_tables(spark):
    same = [(i, [1.0, 2.0], 0, "", 0, "") for i in range(5)]
    assert whiten.whitened(frame_of(spark, same)).collect() == []
    assert whiten.whitened(frame_of(spark, [])).collect() == []
    assert whiten.whitened(frame_of(spark, [(1, None, 0, "", 0, "")])).collect() == []
    vectors = {i: [float(i % 7), 3.0, float(i % 5)] for i in range(40)}
    check(whiten.whitened(frame_of(spark, [(i, v, 0, "", 0, "") for i, v in vectors.items()])).collect(), vectors)


def test_repeated_rows_null_ids_and_few_rows(spark):
    base = RNG.standard_normal((4, 9)).tolist()
    rows = [(i % 4 if i < 7 else None, base[i % 4], 0, "", 0, "") for i in range(8)]
    found = whiten.whitened(frame_of(spark, rows)).collect()
    assert len(found) == 8 * 3 and sum(r.vec_id is None for r in found) == 3
    assert all(r.n == 8 and r.identity_error < 1e-6 for r in found)


def test_large_entries_stay_exact(spark):
    vectors = {i: [float(2**30 + i * 2**20), float(i)] for i in range(9)}
    found = whiten.whitened(frame_of(spark, [(i, v, 0, "", 0, "") for i, v in vectors.items()])).collect()
    x = {i: [int(64 * c) + 1_000_000 for c in v] for i, v in vectors.items()}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    for r in found:
        assert r.deviation == sum((9 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
