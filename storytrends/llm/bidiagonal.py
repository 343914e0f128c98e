"""Singular values and right singular vectors of a small matrix, in double precision.

Householder reflections from both sides make the matrix bidiagonal, the differential qd
algorithm with shifts finds the squares of its singular values, and a twisted
factorization of the shifted tridiagonal product gives the vector of each of them.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
#: Values nearer than this share of their size have their vectors made orthogonal.
CLOSE = 1e-4


def reflector(x: np.ndarray) -> np.ndarray:
    """Unit vector v for which (1 - 2 v v') x lies on the first axis."""
    v = x.copy()
    v[0] += math.copysign(np.linalg.norm(x), x[0])
    size = np.linalg.norm(v)
    return v / size if size else v


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor W of a square matrix = U B W'."""
    work, size = matrix.astype(float).copy(), len(matrix)
    right = np.eye(size)
    for k in range(size):
        v = reflector(work[k:, k])
        work[k:, k:] -= 2 * np.outer(v, v @ work[k:, k:])
        if k < size - 2:
            v = reflector(work[k, k + 1 :])
            work[k:, k + 1 :] -= 2 * np.outer(work[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def inverse_trace_bound(q: list[float], e: list[float], n: int) -> float:
    """A lower bound of the least eigenvalue: one over the trace of the inverse."""
    d = q[0]
    total = 1 / d if d > 0 else math.inf
    for k in range(n - 1):
        d *= q[k + 1] / (d + e[k]) if d + e[k] > 0 else 0.0
        total += 1 / d if d > 0 else math.inf
    return (1 - 4 * n * EPS) / total


def tail_guess(q: list[float], e: list[float], n: int) -> float:
    """Least eigenvalue of the last two rows, less what couples them to the others."""
    a, c = q[n - 2] + e[n - 3], q[n - 1] + e[n - 2]
    half = (a - c) / 2
    root = math.hypot(half, math.sqrt(q[n - 2] * e[n - 2]))
    return (a + c) / 2 - root - math.sqrt(q[n - 3] * e[n - 3])


def dqds_step(q: list[float], e: list[float], n: int, shift: float) -> tuple[list[float], list[float]] | None:
    """One transform by ``shift``; None if the shift exceeds the least eigenvalue."""
    new_q, new_e, d = [0.0] * n, [0.0] * (n - 1), q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] > 0 else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
    new_q[n - 1] = d
    return (new_q, new_e) if d >= 0 else None


def two_by_two(q1: float, q2: float, e: float) -> tuple[float, float]:
    """Both eigenvalues of a qd array of two rows, the larger first."""
    high, low = max(q1, q2), min(q1, q2)
    if e <= EPS * EPS * low or not high:
        return high, low
    t = ((high - low) + e) / 2
    if not t:
        return high + e, low
    s = low * (e / t)
    s = low * (e / (t * (1 + math.sqrt(1 + s / t)))) if s <= t else low * (e / (t + math.sqrt(t) * math.sqrt(t + s)))
    top = high + (s + e)
    return top, low * (high / top)


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    q, e = (diagonal**2).tolist(), (upper**2).tolist()
    n, shift, found = len(q), 0.0, []
    small = (10 * EPS) ** 2
    while n > 2:
        if e[n - 2] <= small * (shift + q[n - 1]):
            found.append(shift + q[n - 1])
            n -= 1
            continue
        if e[n - 3] <= small * (shift + q[n - 2]):
            found += [shift + x for x in two_by_two(q[n - 2], q[n - 1], e[n - 2])]
            n -= 2
            continue
        sure = inverse_trace_bound(q, e, n)
        guess = tail_guess(q, e, n)
        tried, made = sure, None
        if guess > sure:
            tried, made = guess, dqds_step(q, e, n, guess)
        if made is None:
            tried, made = sure, dqds_step(q, e, n, sure)
        if made is None:
            tried, made = 0.0, dqds_step(q, e, n, 0.0)
        q, e = made
        shift += tried
    if n == 2:
        found += [shift + x for x in two_by_two(q[0], q[1], e[0])]
    elif n == 1:
        found.append(shift + q[0])
    return np.sort(np.array(found))[::-1]


def factors(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, ...]:
    """Stationary and progressive transforms of B'B - value: multipliers of both, and remainders at every twist."""
    n, tiny = len(a), EPS * EPS * (value + abs(a).max() ** 2)
    low, high, s, p = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0)), np.zeros(n), np.zeros(n)

    def nonzero(pivot: float) -> float:
        return pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)

    s[0] = -value
    for i in range(n - 1):
        low[i] = a[i] * b[i] / nonzero(s[i] + a[i] ** 2)
        s[i + 1] = low[i] * (b[i] / a[i]) * s[i] - value
    p[n - 1] = a[n - 1] ** 2 - value
    for i in range(n - 2, -1, -1):
        ratio = a[i] ** 2 / nonzero(b[i] ** 2 + p[i + 1])
        high[i] = (b[i] / a[i]) * ratio
        p[i] = p[i + 1] * ratio - value
    return low, high, s + p + value


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of ``value``, grown from the twist where the remainder is least."""
    low, high, left = factors(a, b, value)
    n, twist = len(a), int(np.argmin(np.abs(left)))
    z = np.zeros(n)
    z[twist] = 1
    for i in range(twist - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -high[i] * z[i]
    return z / np.linalg.norm(z)


def shifted_product(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """B'B less ``value``, moved by its rounding so that it can be solved."""
    below = np.append(0.0, b**2) + a**2
    product = np.diag(below) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    return product - (value + 4 * EPS * below.max()) * np.eye(len(a))


def apart(a: np.ndarray, b: np.ndarray, value: float, z: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``z`` made orthogonal to the vectors of close values, by inverse iteration if it lies among them."""
    rest = z - near @ (near.T @ z)
    if np.linalg.norm(rest) < 0.5:
        rest, product = rng.standard_normal(len(a)), shifted_product(a, b, value)
        for _ in range(3):
            rest -= near @ (near.T @ rest)
            rest = np.linalg.solve(product, rest / np.linalg.norm(rest))
            rest /= np.linalg.norm(rest)
            rest -= near @ (near.T @ rest)
            rest /= np.linalg.norm(rest)
    rest = rest - near @ (near.T @ rest)
    return rest / np.linalg.norm(rest)


def block_vectors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, falling, and vectors (columns) of B'B for a matrix without zeros above the diagonal."""
    values = dqds(a, b)
    columns: list[np.ndarray] = []
    first, rng = 0, np.random.default_rng(0)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * values[j - 1]:
            first = j
        z = twisted_vector(a, b, value)
        if j > first:
            z = apart(a, b, value, z, np.array(columns[first:j]).T, rng)
        columns.append(z)
    return values, np.array(columns).T


def right_vectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and the right singular vectors as columns."""
    scale = abs(matrix).max() if matrix.size else 0.0
    if not scale:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    diagonal, upper, right = bidiagonal(matrix / scale)
    floor = 1e-20 * abs(diagonal).max()
    diagonal = np.where(abs(diagonal) < floor, floor, diagonal)
    upper = np.where(abs(upper) <= EPS * (abs(diagonal[1:]) + abs(diagonal[:-1])), 0.0, upper)
    cuts = [0, *(np.flatnonzero(upper == 0) + 1), len(diagonal)]
    values, vectors = np.zeros(len(diagonal)), np.zeros(matrix.shape)
    for start, end in zip(cuts, cuts[1:], strict=False):
        values[start:end], vectors[start:end, start:end] = block_vectors(diagonal[start:end], upper[start : end - 1])
    order = np.argsort(-values, kind="stable")
    return values[order] * scale**2, right @ vectors[:, order]
