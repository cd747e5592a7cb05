"""Fits that leave lights out, weights and projections as operators."""

import numpy as np
from conftest import SMALL

from lumastack.operators import fit, render
from lumastack.plans import fixtures as X

L = X.LIGHTS


def test_every_light_left_out(spark):
    px = X.pixels(spark, SMALL, rounded=True).cache()
    got = {(r["dataset"], r["k"]): r for r in render.leave_each_out(px, L, "ptm", 6).collect()}
    assert len(got) == 3 * 16
    for k in (0, 5, 15):
        for r in render.leave_one_out(px, L, "ptm", 6, k).collect():
            mine = got[r["dataset"], k]
            assert abs(mine["mse"] - r["mse"]) < 1e-9 and mine["elevation"] == r["elevation"] and mine["nplanes"] == r["nplanes"] and (mine["lx"], mine["ly"]) == (r["lx"], r["ly"])


def test_a_light_that_alone_holds_a_term():
    weights = np.array([[1.0, 0], [1, 0], [1, 1]])  # the last light alone tells the second term
    out = render.left_out(weights)
    for k in range(3):
        rest = [i for i in range(3) if i != k]
        assert np.allclose(out[k, rest], weights[k] @ np.linalg.pinv(weights[rest])) and out[k, k] == 0


def test_weights_of_lights_as_rows(spark):
    n = np.random.default_rng(1).normal(size=(40, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    want = fit.rbf_weights(L, n, 0.3)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(n)], "k int, nx double, ny double, nz double")
    got = {(r["k"], r["light_id"]): r["weight"] for r in fit.rbf_weight_rows(rows, L, 0.3, keys=("k",)).collect()}
    assert got.keys() == {(int(i), int(j)) for i, j in zip(*np.nonzero(want), strict=True)}
    assert all(abs(want[k] - v) < 1e-12 for k, v in got.items())
    assert fit.rbf_weight_rows(rows.limit(0), L, 0.3, keys=("k",)).count() == 0


def test_projection_in_one_row(spark):
    px, planes = X.pixels(spark, SMALL), (5, 2, 2)
    bases = fit.pca_basis_ycc(px, planes)
    got = {(r["dataset"], r["x"], r["y"]): r["c"] for r in fit.project_ycc(px, bases, planes).collect()}
    plan = fit.project_ycc(px, bases, planes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Aggregate")[0]  # nothing joins what one row holds
    for r in px.limit(20).collect():
        v = np.stack([r["r"], r["g"], r["b"]])
        co = v[0] - v[2]
        t = v[2] + co / 2
        cg = v[1] - t
        parts = [basis @ (u - mean) for u, (mean, basis) in zip((t + cg / 2, co, cg), bases, strict=True)]
        want = [parts[c][p] for c, p in fit.ycc_plane_order(planes)]
        assert np.allclose(got[r["dataset"], r["x"], r["y"]], want, atol=1e-6)


def test_errors_are_mapped_once(spark):
    """A task holds one Python worker for the errors, whatever Spark infers from what follows."""
    px = X.pixels(spark, SMALL)
    for df in (render.leave_one_out(px, L, "ptm", 6, 5), render.leave_each_out(px, L, "ptm", 6)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 3  # the packing of samples, pixels, and the errors


def test_bases_of_all_channels_in_one_pass(spark, monkeypatch):
    px, passes = X.pixels(spark, SMALL), []
    grams = fit.grams
    monkeypatch.setattr(fit, "grams", lambda *a: passes.append(1) or grams(*a))
    got = fit.pca_basis_ycc(px, (5, 2, 2))
    assert len(passes) == 1
    for c, (mean, basis), n in zip(("yl", "co", "cg"), got, (5, 2, 2), strict=True):
        m, cov = fit.covariance(fit.to_ycc_pixels(px), [c])
        assert np.allclose(mean, m) and np.allclose(basis @ cov @ basis.T, np.diag(np.linalg.eigvalsh(cov)[::-1][:n]), atol=1e-6)
