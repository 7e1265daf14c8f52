"""the nearest vectors that single precision singles out are those that double precision gives."""

import numpy as np
import pytest

from quillspan.operators import similarity as V


def _plain(q, v, k):
    scores = np.nan_to_num(np.round(q @ v.T, 9), nan=-np.inf)
    return {(r, c) for r, own in enumerate(scores) for c in sorted(range(len(own)), key=lambda c: (-own[c], c))[:k]}


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e9, 1e18])
def test_nearest_is_what_double_precision_gives(scale):
    rng = np.random.default_rng(4)
    for n, k in ((5, 3), (64, 1), (700, 3), (2000, 5)):
        v = rng.normal(size=(n, 24))
        q = rng.normal(size=(31, 24)) * scale
        # copies, and vectors that differ by less than single precision tells
        v[n // 2 :] = v[: n - n // 2] * (1 + 1e-8 * rng.integers(-2, 3, size=(n - n // 2, 1)))
        q[0], q[1, 3] = 0.0, 1e-300
        got = [np.concatenate(x) for x in zip(*V._nearest(q, v, k), strict=True)]
        assert set(zip(got[0].tolist(), got[1].tolist(), strict=True)) == _plain(q, v, k) and len(got[0]) == 31 * min(n, k)
        assert np.allclose(got[2], (q @ v.T)[got[0], got[1]], rtol=1e-12, atol=1e-12 * scale)


def test_numbers_that_are_not_finite_and_equal_vectors():
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(900, 8)), rng.normal(size=(9, 8))
    v[5] = np.nan
    assert {(r, c) for rows, cols, _ in V._nearest(q, v, 4) for r, c in zip(rows.tolist(), cols.tolist(), strict=True)} == _plain(q, v, 4)
    v[:] = v[0]
    assert {(r, c) for rows, cols, _ in V._nearest(q, v, 4) for r, c in zip(rows.tolist(), cols.tolist(), strict=True)} == {(r, c) for r in range(9) for c in range(4)}


def test_few_products_are_worked_out_twice(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(V, "_best", lambda *a: pytest.fail("all scores in double precision"))
    q, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(50, 64)), rng.normal(size=(5000, 64))))
    assert sum(len(x[0]) for x in V._nearest(q, v, 5)) == 250
