"""Alignment by transforms against exhaustive sums, and planted shifts below a pixel."""

import numpy as np
import pytest

from lumastack.operators import align

RNG = np.random.default_rng(11)


def _plain(a, ak, b, bk, reach, method):
    h, w = a.shape
    out = {}
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            pairs = [(a[y, x], b[y + dy, x + dx]) for y in range(reach, h - reach) for x in range(reach, w - reach) if ak[y, x] and bk[y + dy, x + dx]]
            if not pairs:
                continue
            u, v = np.array(pairs).T
            if method == "ncc":
                under = np.sqrt((u * u).sum() * (v * v).sum())
                out[dx, dy] = (u * v).sum() / under if under else 0.0
            else:
                joint = {}
                for p in pairs:
                    joint[p] = joint.get(p, 0) + 1
                out[dx, dy] = sum(c / len(u) * np.log(c * len(u) / ((u == p).sum() * (v == q).sum())) for (p, q), c in joint.items())
    return out


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("method", ["ncc", "mi"])
def test_surfaces(spark, method, gaps):
    h, w, reach = 12, 14, 3
    refs = {d: RNG.integers(0, 6, (h, w)) for d in "ab"}
    others = {(d, i): np.roll(refs[d], (1, -2), (0, 1)) if i else RNG.integers(0, 6, (h, w)) for d in "ab" for i in (0, 1)}
    known = lambda: RNG.random((h, w)) < (0.8 if gaps else 2)
    rk, ok = {d: known() for d in refs}, {k: known() for k in others}
    rows = lambda key, v, k: [(*key, x, y, int(v[y, x])) for y in range(h) for x in range(w) if k[y, x]]
    ref = spark.createDataFrame(sum((rows((d,), v, rk[d]) for d, v in refs.items()), []), "dataset string, x int, y int, v int")
    other = spark.createDataFrame(sum((rows(k, v, ok[k]) for k, v in others.items()), []), "dataset string, light_id int, x int, y int, v int")
    best, scores = (align.align_by_mi if method == "mi" else align.align_by_ncc)(ref, other, w, h, reach)
    got = {(r["dataset"], r["light_id"], r["dx"], r["dy"]): r["score"] for r in scores.collect()}
    top = {(r["dataset"], r["light_id"]): r for r in best.collect()}
    n = 0
    for (d, i), v in others.items():
        want = _plain(refs[d], rk[d], v, ok[d, i], reach, method)
        n += len(want)
        assert all(abs(got[d, i, *k] - s) < 1e-9 for k, s in want.items())
        first = min(want, key=lambda k: (-round(want[k], 9), k[1], k[0]))
        assert (top[d, i]["dx"], top[d, i]["dy"]) == first
    assert n == len(got)


def _scene(x, y):
    return 90 + 40 * np.sin(x / 4.3 + 0.3 * y) + 30 * np.cos(y / 3.7 - 0.2 * x) + 20 * np.sin((x + 2 * y) / 6.1)


@pytest.mark.parametrize("method", ["ncc", "mi"])
@pytest.mark.parametrize("shift", [(0.25, -0.25), (1.75, 0.5), (-2.25, 1.0), (0.0, 0.0)])
def test_planted_shifts_below_a_pixel(spark, method, shift):
    h, w = 64, 72
    y, x = np.mgrid[:h, :w]
    images = {"a": _scene(x, y), "b": _scene(x - shift[0], y - shift[1])}
    if method == "mi":
        images["b"] = 255 - 0.8 * images["b"]  # another exposure of the same scene
    rows = {k: [("d", i, j, float(v[j, i])) for j in range(h) for i in range(w)] for k, v in images.items()}
    ref = spark.createDataFrame(rows["a"], "dataset string, x int, y int, v double")
    other = spark.createDataFrame([(d, 0, *r) for d, *r in rows["b"]], "dataset string, light_id int, x int, y int, v double")
    if method == "mi":  # the integer optimum is of the values themselves, which must recur
        ref, other = (f.withColumn("v", f["v"].cast("int")) for f in (ref, other))
        start = align.refine_mi(np.floor(images["a"]), np.floor(images["b"]), *(int(np.floor(s + 0.5)) for s in shift), 4)
        assert abs(start[0] - shift[0]) < 0.05 and abs(start[1] - shift[1]) < 0.05
        return
    (r,) = align.align_by_ncc(ref, other, w, h, 4)[0].collect()
    assert abs(r["dx"] - shift[0]) <= 0.5 + 1e-9 and abs(r["dy"] - shift[1]) <= 0.5 + 1e-9
    assert abs(r["tx"] - shift[0]) < 0.05 and abs(r["ty"] - shift[1]) < 0.05


def test_gradient_of_smooth_information():
    a = RNG.integers(0, 8, 500)
    v, g = RNG.random(500) * 6 + 1, (RNG.normal(size=500), RNG.normal(size=500))
    _, slope = align.smooth_information(a, v, g, 8)
    for k in (0, 1):
        up, down = (align.smooth_information(a, v + s * 1e-5 * g[k], g, 8)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-5


def test_small_windows(spark):
    one = spark.createDataFrame([("d", 0, 0, 1)], "dataset string, x int, y int, v int")
    with pytest.raises(ValueError, match="inner part"):
        align.align_by_ncc(one, one, 4, 4, 2)
