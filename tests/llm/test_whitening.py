import math

import numpy as np
import pytest

from triptych.llm.symmetric import leading_eigenpairs, largest_eigenvalues, tridiagonal
from triptych.llm.whitening import square_sums, whiten

SCHEMA = "vec_id bigint, embedding array<float>, n int, whitened string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "w", "x") for k, v in rows], SCHEMA)


def whole(vectors):
    return [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]


def check(spark, rows, components=16, usable=None):
    """Against the eigenvectors of NumPy and sums in Python's whole numbers."""
    kept = [(k, v) for k, v in rows if usable is None or usable(v)]
    got = whiten(frame(spark, rows), components=components).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(k) for k, _ in kept)
    fit = sorted({tuple(x) for x in whole(v for _, v in kept)})
    n, total = len(fit), [sum(column) for column in zip(*fit)]
    z = np.array([[n * c - t for c, t in zip(x, total)] for x in fit], dtype=np.float64) / n
    covariance = z.T @ z / n
    values, vectors = np.linalg.eigh(covariance)
    some = min(components, int((values > np.trace(covariance) * 1e-12).sum()))
    values, vectors = values[::-1][:some], vectors[:, ::-1][:, :some]
    for r in got:
        assert len(r.whitened) == len(r.explained) == some and r.n == n
        assert r.explained == pytest.approx((values / np.trace(covariance)).tolist(), rel=1e-9)
        assert r.identity_error < 1e-9 if some else r.identity_error is None
    want = {}
    for (k, _), x in zip(kept, whole(v for _, v in kept)):
        offset = [n * c - t for c, t in zip(x, total)]
        want.setdefault(k, []).append((sum(o * o for o in offset), np.array(offset, dtype=np.float64) / n))
    apart = some and np.min(-np.diff(values), initial=np.inf) > 1e-6 * values[0]
    for r in got:
        near = [z for deviation, z in want[r.vec_id] if deviation == r.deviation]
        assert near
        if apart:
            assert any(np.abs(np.abs(z @ vectors / np.sqrt(values)) - np.abs(r.whitened)).max() < 1e-6 for z in near)
    return got


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(12, 24)) * np.linspace(3, 0.2, 12)[:, None]
    rows = [(i, (rng.normal(size=12) @ mixed).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]
    got = check(spark, rows, components=7)
    signs = {r.vec_id: tuple(np.sign(r.whitened)) for r in got}
    assert len({signs[k] for k in (5, *range(1000, 1150))}) == 1


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.25, 4.0, 1.5]), (2, [0.25, 4.0, 1.5]), (None, [-7.0, 0.0, 0.125]), (5, [1e-30, -1e-30, 0.0])]
    bad = [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 1.0]), (10, [inf, 0.0, 0.0]), (11, [1.0, 2.0]), (12, [3e30, 0.0, 0.0])]
    check(spark, good + bad, usable=lambda v: any(v is w for _, w in good))


def test_fewer_components_than_asked_for(spark):
    line = [(i, [i / 4, i / 2, 1.0]) for i in range(20)]
    assert all(len(r.whitened) == 1 for r in check(spark, line))
    alone = whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, [], [], None)] * 2


def test_empty_table(spark):
    out = whiten(frame(spark, []))
    assert out.collect() == [] and out.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_numbers_stay_exact(spark):
    rows = [(1, [2.0**50, 1.0]), (2, [-(2.0**51), 3.0]), (3, [2.0**40, -5.0])]
    check(spark, rows, components=1)
    for low, high in ((-(1 << 55), 1 << 55), (-(1 << 20), 1 << 20)):
        offset = np.random.default_rng(1).integers(low, high, (50, 130))
        assert square_sums(offset) == [sum(v * v for v in row) for row in offset.tolist()]


@pytest.mark.parametrize("kind", ["random", "identity", "two clusters", "low rank", "zero", "diagonal"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 90])
def test_eigenpairs(n, kind):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    q, _ = np.linalg.qr(a)
    low = rng.normal(size=(n, 2))
    matrix = {
        "random": a @ a.T,
        "identity": np.eye(n) * 3,
        "two clusters": (q * np.repeat([5.0, 2.0], [n // 2, n - n // 2])) @ q.T,
        "low rank": low @ low.T * 1e-8,
        "zero": np.zeros((n, n)),
        "diagonal": np.diag(rng.integers(0, 3, n).astype(float)),
    }[kind]
    matrix = (matrix + matrix.T) / 2
    count, size = min(16, n), max(np.abs(matrix).max(), 1e-300)
    values, vectors = leading_eigenpairs(matrix, count)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:count]).max() <= 1e-13 * size * max(n, 8)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(count)).max() <= 1e-12
    diagonal, beside, _ = tridiagonal(matrix)
    assert np.allclose(largest_eigenvalues(diagonal, beside, n).sum(), np.trace(matrix), atol=1e-12 * size * n)
