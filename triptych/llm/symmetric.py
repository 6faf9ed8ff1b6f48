"""Leading eigenvalues and eigenvectors of a symmetric matrix.

Householder reflections make the matrix tridiagonal, counts of Sturm sequences enclose each leading
eigenvalue by bisection, inverse iteration finds the vectors. Vectors of close eigenvalues are kept
at right angles.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
# Eigenvalues nearer than this share of the norm are one cluster; most inverse steps.
CLUSTER = 1e-3
STEPS = 12


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and the unit vectors as columns.

    The entry of a vector that is largest in size is positive.
    """
    matrix = np.asarray(matrix, dtype=np.float64)
    size = float(np.abs(matrix).max(initial=0.0))
    if size == 0:
        return np.zeros(count), np.eye(len(matrix), count)
    # In units of its largest entry neither very large nor very small numbers run out of range.
    diagonal, beside, reflectors = tridiagonal(matrix / size)
    values = largest_eigenvalues(diagonal, beside, count)
    vectors = tridiagonal_vectors(diagonal, beside, values)
    for k in reversed(range(reflectors.shape[1])):
        v = reflectors[:, k]
        vectors -= 2 * np.outer(v, v @ vectors)
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    top = np.abs(vectors).argmax(axis=0)
    return values * size, vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and the line beside it of the similar tridiagonal matrix, and the unit reflectors as columns."""
    a, n = matrix.copy(), len(matrix)
    reflectors = np.zeros((n, max(n - 2, 0)))
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.sqrt(v @ v)
        if not np.any(v[1:]):
            continue
        first = -np.copysign(size, v[0])
        v[0] -= first
        v /= np.sqrt(v @ v)
        reflectors[k + 1 :, k] = v
        block = a[k + 1 :, k + 1 :]
        p = 2 * block @ v
        w = p - (p @ v) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = first
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each of `at`: negative terms of the Sturm sequence."""
    least = np.finfo(np.float64).tiny * max(1.0, float(np.max(beside * beside, initial=0.0)))
    term = diagonal[0] - at
    count = (term < 0).astype(np.int64)
    for d, square in zip(diagonal[1:], beside * beside):
        term = np.where(np.abs(term) < least, -least, term)
        term = d - at - square / term
        count += term < 0
    return count


def largest_eigenvalues(diagonal: np.ndarray, beside: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, each enclosed by bisection as closely as numbers allow."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(beside)
    reach[1:] += np.abs(beside)
    norm = max(float(np.max(np.abs(diagonal) + reach)), np.finfo(np.float64).tiny)
    wanted = n - 1 - np.arange(count)
    low = np.full(count, float(np.min(diagonal - reach)) - 2 * EPS * norm)
    high = np.full(count, float(np.max(diagonal + reach)) + 2 * EPS * norm)
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high) | (high - low <= EPS * norm / 4)):
            return middle
        less = below(diagonal, beside, middle) <= wanted
        low, high = np.where(less, middle, low), np.where(less, high, middle)


def tridiagonal_vectors(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix for its falling eigenvalues, by inverse iteration."""
    n = len(diagonal)
    norm = max(float(np.max(np.abs(diagonal))) + 2 * float(np.max(np.abs(beside), initial=0.0)), np.finfo(np.float64).tiny)
    random = np.random.default_rng(11)
    vectors, cluster, shift = np.zeros((n, len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            cluster = k
        # Equal eigenvalues are moved apart, so that each has a factorisation of its own.
        shift = min(value, shift - 10 * EPS * norm)
        solve = factorised(diagonal - shift, beside, EPS * norm)
        mine = vectors[:, cluster:k]
        x = random.uniform(-1, 1, n)
        best = np.inf
        for step in range(STEPS):
            x = solve(x / np.max(np.abs(x)))
            # Twice, as one pass leaves rounding behind where the vectors were nearly parallel.
            for _ in range(2):
                x = x - mine @ (mine.T @ x)
            x = x / np.sqrt(x @ x)
            product = diagonal * x
            product[:-1] += beside * x[1:]
            product[1:] += beside * x[:-1]
            left = float(np.max(np.abs(product - value * x)))
            if left < best:
                best, vectors[:, k] = left, x
            if step >= 2 and left <= 4 * EPS * norm:
                break
    return vectors


def factorised(diagonal: np.ndarray, beside: np.ndarray, least: float):
    """A solver for the tridiagonal system: elimination with row interchanges, tiny pivots raised to `least`."""
    n = len(diagonal)
    main, upper, second = diagonal.tolist(), [*beside.tolist(), 0.0], [0.0] * n
    lower = beside.tolist()
    factors, swapped = [0.0] * max(n - 1, 0), [False] * max(n - 1, 0)
    for i in range(n - 1):
        if abs(lower[i]) > abs(main[i]):
            swapped[i] = True
            factors[i] = main[i] / lower[i]
            after = upper[i]
            main[i], upper[i], second[i] = lower[i], main[i + 1], upper[i + 1]
            main[i + 1] = after - factors[i] * upper[i]
            upper[i + 1] = -factors[i] * second[i]
        else:
            if abs(main[i]) < least:
                main[i] = least if main[i] >= 0 else -least
            factors[i] = lower[i] / main[i]
            main[i + 1] -= factors[i] * upper[i]
    if n and abs(main[-1]) < least:
        main[-1] = least if main[-1] >= 0 else -least

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.tolist()
        for i in range(n - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factors[i] * x[i]
        for i in reversed(range(n)):
            if i + 1 < n:
                x[i] -= upper[i] * x[i + 1]
            if i + 2 < n:
                x[i] -= second[i] * x[i + 2]
            x[i] /= main[i]
        return np.array(x)

    return solve
