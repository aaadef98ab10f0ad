"""Components and whitened rows against eigenvectors by numpy, and exact integers against Python's."""

import math

import numpy as np
import pytest

from corpuscle.llm import whitening as wh


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(k, v, "x", 1.5) for k, v in rows], "vec_id long, embedding array<double>, component string, n double").repartition(parts)


@pytest.mark.parametrize("shape", [(1, 1), (5, 2), (7, 7), (40, 9), (300, 64), (3, 10)])
def test_jacobi(shape):
    rng = np.random.default_rng(sum(shape))
    a = rng.normal(size=shape) @ np.diag(10.0 ** -np.arange(shape[1]).clip(max=12))
    values, vectors = wh.jacobi(np.linalg.qr(a, mode="r"))
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(values[: len(want)], want, rtol=1e-9, atol=1e-14 * want[0])
    kept = values > 1e-13 * values[0]
    assert np.allclose(vectors[:, kept].T @ vectors[:, kept], np.eye(kept.sum()), atol=1e-12)
    assert np.allclose(np.linalg.norm(a @ vectors, axis=0), values, rtol=1e-9, atol=1e-13 * want[0])


def test_small_deviations_are_exact():
    """Columns of lengths from 1 to 1e-14, hardly correlated: squares would lose the small ones, rotations don't."""
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(50, 8)))
    values, _ = wh.jacobi(np.linalg.qr(q * 10.0 ** -np.arange(0, 16, 2), mode="r"))
    assert np.allclose(values, 10.0 ** -np.arange(0, 16, 2), rtol=1e-10)


def plain(vectors, most=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    centred = (x * n - s).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return deviation, centred, e, v[:, :most]


@pytest.mark.parametrize("n, d, parts", [(200, 12, 40), (30, 3, 2), (500, 65, 3)])
def test_against_eigenvectors(spark, n, d, parts, monkeypatch):
    monkeypatch.setattr(wh, "FAN", 3)
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(n, d)) * np.linspace(2, 0.2, d) @ rng.normal(size=(d, d))).tolist()
    rows = wh.whiten(frame(spark, enumerate(vectors), parts)).collect()
    deviation, centred, e, v = plain(vectors)
    m = min(8, d)
    assert len(rows) == n * m
    got = np.zeros((n, m))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and r.n == n and r.identity_error < 1e-9
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)
    want = centred @ v / np.sqrt(e[:m])
    assert np.allclose(np.abs((got * want).sum(axis=0)), (want * want).sum(axis=0), rtol=1e-6)
    assert np.allclose(got.T @ got / n, np.eye(m), atol=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.2, 5.0], [0.3, -0.2, 5.0], [0.3, 0.9, 5.0], [0.3, 0.9, 5.0]]
    odd = [None, [], [0.1, None, 1.0], [0.1, nan, 1.0], [inf, 0.0, 1.0], [0.1, 0.2], [1e300, 0.0, 0.0], [None, None, None]]
    rows = [(k if k else None, v) for k, v in enumerate(good)] + [(3, v) for v in odd]
    got = wh.whiten(frame(spark, rows)).collect()
    # the third dimension is constant: two components
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(k if k else None), c) for k in range(4) for c in (1, 2))
    deviation, *_ = plain(good)
    assert {str(r.vec_id): r.deviation for r in got} == {str(k if k else None): x for k, x in enumerate(deviation)}
    for empty in ([], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5]), (2, [0.5])]):
        found = wh.whiten(frame(spark, empty, 1))
        assert found.count() == 0 and found.columns[:3] == ["vec_id", "component", "n"]
    with pytest.raises(ValueError):
        wh.whiten(frame(spark, [(1, [0.0] * 4097)], 1))


def test_large_entries(spark):
    vectors = [[1e9, 2.0], [-1e9, 3.0], [1e12, 4.0]]
    rows = wh.whiten(frame(spark, enumerate(vectors))).collect()
    deviation, *_ = plain(vectors)
    assert {r.vec_id: r.deviation for r in rows} == {k: x if x < 1 << 63 else None for k, x in enumerate(deviation)}
