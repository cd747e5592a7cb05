"""Queries that once ran on a part of their rows only."""

import numpy as np
from conftest import SMALL
from test_integration import plain_bilateral

from lumastack.operators import fit
from lumastack.plans import fixtures, registered

QUERIES, _ = registered()


def test_positional_resampling_of_all_datasets(spark):
    got = {}
    for r in QUERIES["c7_resample_positional"](spark, SMALL).collect():
        got.setdefault((r["dataset"], r["x"], r["y"]), {})[r["p"]] = r["v"]
    pixels = fixtures.pixels(spark, SMALL).collect()
    assert got.keys() == {(r["dataset"], r["x"], r["y"]) for r in pixels} and len({k[0] for k in got}) == 3
    w, h = fixtures.sizes(spark, SMALL)
    maps = [fit.resample_map(v, 8, 0.3) for v in fit.node_lights(fixtures.POSITIONS, w, h, 0.1)]
    for r in pixels[::97]:
        u, v = 14 * r["x"] / w, 14 * r["y"] / h
        near = [(i, j, (1 - abs(u - i)) * (1 - abs(v - j))) for j in range(15) for i in range(15) if abs(u - i) < 1 and abs(v - j) < 1]
        want = sum(k * maps[j * 15 + i] @ np.stack([r["r"], r["g"], r["b"]], axis=1) for i, j, k in near).ravel()
        mine = got[r["dataset"], r["x"], r["y"]]
        assert np.allclose([mine[p] for p in range(len(want))], want, atol=1e-3)


def test_bilateral_integration_of_the_whole_grid(spark):
    got = {(r["x"], r["y"]): (r["dataset"], r["z"]) for r in QUERIES["i2_integrate_bilateral"](spark, SMALL).collect()}
    w, h = fixtures.sizes(spark, SMALL)
    n = np.zeros((h, w, 3))
    for r in fixtures.truth(spark, SMALL, "d").collect():
        n[r["y"], r["x"]] = r["nx"], r["ny"], r["nz"]
    z = plain_bilateral(n, 2.0)
    assert len(got) == w * h and {k for k, _ in got.values()} == {"d"}
    assert all(abs(z[y, x] - v) < 2e-3 for (x, y), (_, v) in got.items())
