"""Bilateral integration in blocks against dense linear algebra that shares no code with it."""

import numpy as np
import pytest

from lumastack.operators import integrate


def plain_bilateral(n, k, rounds=10, tol=1e-5):
    """Four equations a pixel, nz (z_neighbour - z) = nz slope, weights 1/2 at first, then from squared depth steps alone."""
    h, w = n.shape[:2]
    size = h * w
    nz = np.maximum(abs(n[..., 2]), 1e-6).ravel()
    a, b = np.zeros((4 * size, size)), np.zeros(4 * size)
    for y in range(h):
        for x in range(w):
            i = y * w + x
            p, q = -n[y, x, 0] / nz[i], n[y, x, 1] / nz[i]
            for part, (u, v), sign, slope in ((0, (x - 1, y), -1, p), (1, (x + 1, y), 1, p), (2, (x, y - 1), -1, q), (3, (x, y + 1), 1, q)):
                if 0 <= u < w and 0 <= v < h:
                    a[part * size + i, v * w + u] += sign * nz[i]
                    a[part * size + i, i] -= sign * nz[i]
                    b[part * size + i] = nz[i] * slope
    weights, ones = np.full(4 * size, 0.5), np.full((size, size), 1.0 / size)  # the mean is held at 0
    energy = float(weights @ b**2)
    for _ in range(rounds):
        z = np.linalg.solve((a.T * weights) @ a + ones, (a.T * weights) @ b)
        if k == 0:
            break
        d = (a @ z) ** 2
        u = 1 / (1 + np.exp(-k * (d[size : 2 * size] - d[:size])))
        v = 1 / (1 + np.exp(-k * (d[3 * size :] - d[2 * size : 3 * size])))
        weights = np.concatenate([u, 1 - u, v, 1 - v])
        before, energy = energy, float(weights @ (a @ z - b) ** 2)
        if abs(energy - before) / before < tol:
            break
    return (z - z.mean()).reshape(h, w)


def _field(w, h, shift=0.0):
    """A curved field with a step of 4."""
    y, x = np.mgrid[:h, :w]
    z = 3 * np.sin(x / 5 + shift) + 2 * np.cos(y / 4) + np.where(x > w // 2, 4.0, 0)
    gy, gx = np.gradient(z)
    n = np.stack([-gx, gy, np.ones_like(gx)], axis=2)
    return n / np.linalg.norm(n, axis=2, keepdims=True)


def _table(spark, fields):
    rows = [(d, x, y, *map(float, n[y, x])) for d, n in fields.items() for y in range(n.shape[0]) for x in range(n.shape[1])]
    return spark.createDataFrame(rows, "dataset string, x int, y int, nx double, ny double, nz double").repartition(3)


@pytest.mark.parametrize(("k", "rounds", "block", "overlap"), [(0.0, 1, 6, 4), (2.0, 2, 6, 4), (2.0, 10, 64, 8), (0.5, 3, 13, 5)])
def test_blocks_equal_dense_algebra(spark, k, rounds, block, overlap):
    w, h = 26, 22
    fields = {"d": _field(w, h), None: _field(w, h, 1.0)}
    got = {d: np.zeros((h, w)) for d in fields}
    out = integrate.integrate_bilateral(_table(spark, fields), w, h, k, block=block, overlap=overlap, rounds=rounds)
    assert out.count() == 2 * w * h
    for r in out.collect():
        got[r["dataset"]][r["y"], r["x"]] = r["z"]
    for d, n in fields.items():
        assert abs(got[d] - plain_bilateral(n, k, rounds)).max() < 1e-3


def test_weights_come_from_depth_steps():
    """A step in depth that the normals explain still splits the sides' weights."""
    z = np.array([[0.0, 1.0, 5.0, 6.0]])
    left, right = integrate.side_weights(z, np.ones((1, 4)), 1.0)[0]
    assert np.allclose(left + right, 1) and right[0, 1] < 0.01 and left[0, 2] < 0.01


def test_narrow_and_empty_grids(spark):
    for w, h in ((9, 1), (1, 9), (1, 1), (7, 6)):
        n = _field(9, 9)[:h, :w]
        got = np.zeros((h, w))
        for r in integrate.integrate_bilateral(_table(spark, {"d": n}), w, h, block=6, overlap=2).collect():
            got[r["y"], r["x"]] = r["z"]
        assert abs(got - plain_bilateral(n, 0.0)).max() < 1e-3
    assert integrate.integrate_bilateral(_table(spark, {"d": n}).limit(0), 7, 6).count() == 0


def test_scaffold_is_not_broadcast(spark):
    """It has a row a pixel, whatever size Spark takes it to have."""
    out = integrate.integrate_tiled(_table(spark, {"d": _field(26, 22)}), 26, 22, tile=16, pad=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [dataset" in plan
    assert out.count() == 26 * 22


@pytest.mark.parametrize(("spread", "steps", "near"), [(1.5, 15, 1e-6), (1e6, 2000, 1e-3)])
@pytest.mark.parametrize("held", [(0, 0, 0, 0), (2, 2, 2, 2), (0, 2, 2, 0)])
def test_a_window_is_solved_in_few_steps(spread, steps, near, held):
    """Held at any sides, in a dozen steps where weights differ little; by the diagonal where they differ much."""
    rng, (h, w) = np.random.default_rng(3), (96, 80)
    true = rng.normal(size=(h, w)).cumsum(axis=0)
    ex, ey = (spread ** rng.random(s) for s in ((h, w - 1), (h - 1, w)))
    free = np.zeros((h, w), bool)
    free[held[0] : h - held[1], held[2] : w - held[3]] = True
    edges = ex, ex * np.diff(true, axis=1), ey, ey * np.diff(true, axis=0)
    z = integrate._relaxed(np.where(free, 0.0, true), edges, steps, free=free) - true
    z -= 0 if any(held) else z.mean()
    assert abs(z).max() < near * np.ptp(true)


def test_coarse_nodes_lie_within_blocks(spark):
    """A grid of many blocks is right after few sweeps."""
    w, h = 20, 160
    n = _field(w, h)
    got = np.zeros((h, w))
    for r in integrate.integrate_bilateral(_table(spark, {"d": n}), w, h, block=16, overlap=4, sweeps=3).collect():
        got[r["y"], r["x"]] = r["z"]
    want = integrate.solve_grid(n, steps=5000)
    assert abs(got - (want - want.mean())).max() < 1e-2
