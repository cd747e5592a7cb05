"""Blocked rasters against plain versions, on grids cut into many blocks with pixels missing."""

import math

import numpy as np
import pytest

from lumastack.operators import blocks, normals, prepare, pyramid, render, stack

W, H = 23, 17
RNG = np.random.default_rng(5)
GONE = {(3, 4), (0, 0), (22, 16), (10, 9)}


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(s, x, y, int(RNG.integers(0, 256)), int(RNG.integers(-5, 5000)), float(RNG.normal())) for s in ("a", "b", None) for y in range(H) for x in range(W) if s != "b" or (x, y) not in GONE]
    RNG.shuffle(rows)
    rows = [(s if s != "None" else None, int(x), int(y), int(r), int(g), float(z)) for s, x, y, r, g, z in rows]
    return spark.createDataFrame(rows, "dataset string, x int, y int, r int, g long, z double").repartition(5), {(s, x, y): (r, g, z) for s, x, y, r, g, z in rows}


def _clamped(x, y):
    return min(max(x, 0), W - 1), min(max(y, 0), H - 1)


@pytest.mark.parametrize("size", [4, 7, 64])
def test_neighbours(grid, size):
    df, truth = grid
    offsets = [(-2, 0), (0, 0), (1, 1), (0, -1)]
    got = sorted(map(str, stack.neighbours(df, offsets, W, H, ["r", "g", "z"], size=size).collect()))
    want = []
    for s, x, y in truth:
        for dx, dy in offsets:
            near = (s, *_clamped(x + dx, y + dy))
            if near in truth:
                r, g, z = truth[near]
                want.append(f"Row(dataset={s!r}, x={x}, y={y}, dx={dx}, dy={dy}, r={r}, g={g}, z={z})")
    assert got == sorted(want)


@pytest.mark.parametrize("size", [3, 5, 64])
def test_downsample(spark, size):
    for w, h in ((23, 17), (8, 2), (2, 9)):
        image = RNG.integers(0, 256, (h, w, 3))
        df = spark.createDataFrame([("d", x, y, *map(int, image[y, x])) for y in range(h) for x in range(w)], "dataset string, x int, y int, r int, g int, b int")
        taps = dict(pyramid.TAPS)
        half = lambda v, n: np.stack([(sum(k * v[min(max(2 * i + 1 + t, 0), n - 1)].astype(int) for t, k in taps.items()) + 8) // 16 for i in range(n // 2)])
        want = half(half(image.transpose(1, 0, 2), w).transpose(1, 0, 2), h)
        got = pyramid.downsample(df, w, h, size=size).collect()
        assert len(got) == (w // 2) * (h // 2)
        assert all(tuple(want[r["y"], r["x"]]) == (r["r"], r["g"], r["b"]) for r in got)


def test_hillshade_at_block_edges(spark, monkeypatch):
    z = RNG.normal(0, 3, (H, W))
    df = spark.createDataFrame([("d", x, y, float(z[y, x])) for y in range(H) for x in range(W)], "dataset string, x int, y int, z double")
    at = lambda x, y: z[_clamped(x, y)[::-1]]
    for size in (5, 64):
        monkeypatch.setattr(render, "stencil", lambda *a, size=size: blocks.stencil(*a, size=size))
        for r in render.hillshade(df, W, H, (0.3, 0.4, 0.8), 2.0).collect():
            x, y = r["x"], r["y"]
            gx = sum((2 if j == 0 else 1) * i * at(x + i, y + j) for i in (-1, 1) for j in (-1, 0, 1)) / 16
            gy = sum((2 if i == 0 else 1) * j * at(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 1)) / 16
            assert math.isclose(r["shade"], (-gx * 0.3 - gy * 0.4 + 0.8) / math.sqrt(gx * gx + gy * gy + 1), rel_tol=1e-9)


def _bilinear(values, sx, sy, w, h):
    """Sum of the known corners, or None."""
    fx, fy = math.floor(sx), math.floor(sy)
    out, hit = 0.0, False
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        key = (min(max(fx + dx, 0), w - 1), min(max(fy + dy, 0), h - 1))
        if key in values:
            hit = True
            out += (sx - fx if dx else 1 - sx + fx) * (sy - fy if dy else 1 - sy + fy) * values[key]
    return out if hit else None


@pytest.mark.parametrize("new", [(7, 5), (60, 40), (23, 17), (1, 1), (300, 3)])
def test_resize(spark, monkeypatch, new):
    values = {(x, y): float(RNG.normal()) for y in range(H) for x in range(W) if (x, y) not in GONE}
    df = spark.createDataFrame([("d", *k, v) for k, v in values.items()], "dataset string, x int, y int, v double")
    monkeypatch.setattr(normals, "SIZE", 6)
    got = {(r["x"], r["y"]): r["v"] for r in normals.resize_grid(df, ["v"], (W, H), new).collect()}
    rx, ry = (W - 1) / max(new[0] - 1, 1), (H - 1) / max(new[1] - 1, 1)
    want = {(x, y): v for y in range(new[1]) for x in range(new[0]) if (v := _bilinear(values, x * rx, y * ry, W, H)) is not None}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())


@pytest.mark.parametrize("angle", [0, 30, 200])
@pytest.mark.parametrize("size", [5, 64])
def test_rotation(spark, angle, size):
    values = {(x, y): float(RNG.normal()) for y in range(H) for x in range(W) if (x, y) not in GONE}
    df = spark.createDataFrame([("d", *k, v, -v, 0.5) for k, v in values.items()], "dataset string, x int, y int, nx double, ny double, nz double")
    crop = prepare.Crop(left=4, top=3, width=14, height=11, angle=angle)
    got = {(r["x"], r["y"]): r["nx"] for r in prepare.rotate_crop(df, crop, W, H, size=size).collect()}
    want = {}
    for y in range(11):
        for x in range(14):
            v = _bilinear(values, *prepare.crop_to_img(float(x), float(y), crop, W, H), W, H)
            if v is not None:
                want[x, y] = v
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())


def test_source_blocks_go_where_they_are_read(spark):
    """The blocks of a turned crop get the pixels of their boxes only."""
    n = 256
    df = spark.range(n * n).selectExpr("'d' AS dataset", "cast(id % 256 as int) AS x", "cast(id div 256 as int) AS y", "0.0D AS nx", "0.0D AS ny", "1.0D AS nz")
    crop = prepare.Crop(left=100, top=100, width=64, height=64, angle=30)
    out = prepare.rotate_crop(df, crop, n, n, size=32)
    assert out.count() == 64 * 64
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_nulls_repeats_and_strays(spark):
    rows = [("d", 0, 0, None, 1.0), ("d", 1, 0, 4, None), ("d", 1, 0, 4, None), ("d", -3, 0, 9, 9.0), ("d", 0, 99, 9, 9.0)]
    df = spark.createDataFrame(rows, "dataset string, x int, y int, r int, z double")
    got = {(r["x"], r["y"]): (r["s"], r["bad"]) for r in blocks.stencil(df, ["r", "z"], 2, 1, 1, lambda v, known: {"s": blocks.shifted(v["r"], 1, 0, 0).astype(float), "bad": np.isnan(blocks.shifted(v["z"], 1, 0, 0))}, "s double, bad boolean").collect()}
    assert got == {(0, 0): (0.0, False), (1, 0): (4.0, True)}
    assert blocks.stencil(df.limit(0), ["r"], 2, 1, 1, lambda v, known: {"s": v["r"]}, "s double").count() == 0


@pytest.mark.parametrize(("w", "h", "size"), [(37, 26, 4), (16, 41, 8)])
def test_a_pyramid_kept_up_to_date(spark, w, h, size):
    from lumastack.shared import stored

    image = RNG.integers(0, 256, (2, h, w, 3))
    table = lambda a: spark.createDataFrame([("ab"[d], x, y, *map(int, a[d, y, x])) for d in (0, 1) for y in range(h) for x in range(w)], "dataset string, x int, y int, r int, g int, b int")
    old = stored(pyramid.pyramid(table(image), w, h, 5))
    newer = image.copy()
    newer[0, 3:6, 2:7] = 255 - newer[0, 3:6, 2:7]
    newer[0, h - 1, w - 1] = 255 - newer[0, h - 1, w - 1]
    patch = [("a", x, y, *map(int, newer[0, y, x])) for y in range(h) for x in range(w) if y < 8 or (newer[0, y, x] != image[0, y, x]).any()]  # most of these are as they were
    got, touched = pyramid.refresh_pyramid(old, spark.createDataFrame(patch, "dataset string, x int, y int, r int, g int, b int"), w, h, 5, size=size)
    want = pyramid.pyramid(table(newer), w, h, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    marks = {(r["dataset"], r["level"], r["x"], r["y"]) for r in touched.collect()}
    changed = want.subtract(old.select(*want.columns)).select("dataset", "level", "x", "y").collect()
    assert marks == {tuple(r) for r in changed} and {d for d, *_ in marks} == {"a"}
    assert len([m for m in marks if m[1] == pyramid.n_levels(w, h, 5) - 1]) == 16  # of the whole image 15 and a corner have changed
