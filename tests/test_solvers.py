"""Properties of the solvers and of what SQL cannot express."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lumastack.functions import algebra
from lumastack.operators import aggregate, fit, flatten, integrate, lights, normals, pyramid, render, robust, stack
from lumastack.operators.grids import gaussian_blur
from lumastack.plans import fixtures as X
from lumastack.sources import documents, images
from lumastack.streaming.normals_stream import streaming_normals

L = X.LIGHTS


def _worst(spark, found):
    return normals.angular_error(found, X.truth(spark, SMALL)).agg(F.max("degrees")).first()[0]


def test_robust_solvers_undo_highlights(spark):
    px = X.pixels(spark, SMALL, specular=True).cache()
    plain = normals.normals_l2(X.stack(spark, SMALL, specular=True), X.lights(spark, SMALL))
    assert _worst(spark, plain) > 3
    assert _worst(spark, robust.normals_robust(px, L, high=1000)) < 2
    assert _worst(spark, robust.normals_l1(px, L, rounds=200)) < 0.01
    assert _worst(spark, robust.normals_sbl(px, L, rounds=200)) < 0.05


def test_partitions_do_not_matter(spark):
    want = None
    for n in (1, 7, 64):
        got = sorted(map(str, normals.encode_normals(normals.normals_l2(X.stack(spark, SMALL).repartition(n), X.lights(spark, SMALL))).collect()))
        assert want is None or got == want
        want = got


def test_streaming_equals_batch(spark, tmp_path):
    X.stack(spark, SMALL).where("x < 10").write.parquet(f"file://{tmp_path}/s")
    source = spark.readStream.schema(X.stack(spark, SMALL).schema).parquet(f"file://{tmp_path}/s")
    q = streaming_normals(source, X.lights(spark, SMALL)).writeStream.outputMode("complete").format("memory").queryName("stream_normals").start()
    q.processAllAvailable()
    q.stop()
    assert normals.angular_error(spark.table("stream_normals"), X.truth(spark, SMALL)).agg(F.max("degrees"), F.count(F.lit(1))).first()[0] < 1e-4


def test_rendering_fitted_lights_gives_the_input_back(spark):
    px = X.pixels(spark, SMALL).where("x < 5")
    mean, basis = fit.pca_basis(px, 3)
    of = lambda v: np.stack([v[c * 16 + np.arange(16)] for c in range(3)], axis=1)
    rows = render.light_rows(spark, np.stack([of(b) for b in basis], axis=1).reshape(16, 9), of(mean))
    got = render.illuminate(fit.project(px, mean, basis), rows, "mrgb")
    light = render.reconstruction_error(X.stack(spark, SMALL).where("x < 5"), got)[1].collect()
    assert all(r["rmse"] < 1.01 for r in light)
    assert np.allclose(basis @ basis.T, np.eye(3), atol=1e-9)


def test_luma_planes_give_the_input_back(spark):
    from lumastack.plans import registered

    got = registered()[0]["r1_illuminate_mycc"](spark, SMALL)
    assert all(r["rmse"] < 1.5 for r in render.reconstruction_error(X.stack(spark, SMALL), got)[1].collect())


def test_weights_agree_with_columns(spark):
    from lumastack.functions import light_bases as lb

    rows = X.lights(spark, SMALL, ("d",)).orderBy("light_id")
    for basis, column in (("ptm", lb.ptm_weights(F.col("lx"), F.col("ly"), 9)), ("hsh", lb.hsh_weights(F.col("lx"), F.col("ly"), F.col("lz"))), ("sh", lb.sh_weights(F.col("lx"), F.col("ly"), F.col("lz")))):
        assert np.allclose([r["w"] for r in rows.select(column.alias("w")).collect()], fit.weights_of(L, basis, 9))


def test_positional_fit_nears_the_directional_one_for_far_lights(spark):
    px = X.pixels(spark, SMALL).where("x < 5")
    w, h = X.sizes(spark, SMALL)
    far = fit.fit_poly_3d(px, L * 1e7, "ptm", 6, width=w, height=h, pixel=0.1)
    near = fit.fit_poly(px, L, "ptm", 6).withColumnRenamed("c", "d").join(far, ["dataset", "x", "y"])
    assert max(np.abs(np.array(r["c"]) - np.array(r["d"])).max() for r in near.collect()) < 1e-3


def test_resampling_reads_back_at_the_lights():
    m = fit.resample_map(L, 8, 0.3, 1e-6, 0)
    assert np.abs(fit.grid_weights(L, 8) @ m - np.eye(16)).max() < 1e-3


def test_quantising_errs_by_less_than_a_step(spark):
    coeff = X.pixels(spark, SMALL).select("dataset", "x", "y", F.col("r").alias("c"))
    ranges = fit.planes_long(coeff).groupBy("dataset", "plane").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    planes = fit.finalize_planes(ranges)
    back = fit.dequantize(fit.quantize(coeff, planes), planes).withColumnRenamed("c", "d").join(coeff, ["dataset", "x", "y"])
    top = planes.agg(F.max("scale")).first()[0]
    assert max(np.abs(np.array(r["c"]) - np.array(r["d"])).max() for r in back.collect()) <= top + 1e-9


@pytest.mark.parametrize("n", [1000, 7])
def test_plane_ranges_have_no_limit_case(spark, n):
    rows = spark.createDataFrame([("d", p, float((i * 37 % n) if p else 5)) for p in (0, 1) for i in range(n)], "dataset string, plane int, value double")
    got = {r["plane"]: (r["vmin"], r["vmax"]) for r in aggregate.plane_ranges(rows).collect()}
    assert got[0] == (5, 5 + 1e-6)
    assert got[1] == (float(int((1 - 0.995) / 2 * n)), float(min(int((1 + 0.995) / 2 * n), n - 1)))


def test_golden_pyramid():
    assert pyramid.n_levels(2696, 2672, 256) == 5
    assert sum(-(-w // 256) * -(-h // 256) for w, h in pyramid.level_sizes(2696, 2672, 256)) == 171
    assert pyramid.tiff_side(60) == 64


def test_constant_images_stay(spark):
    rows = [("d", x, y, 77, 3, 255) for x in range(9) for y in range(7)]
    got = pyramid.downsample(spark.createDataFrame(rows, "dataset string, x int, y int, r int, g int, b int"), 9, 7).collect()
    assert len(got) == 12 and {(r["r"], r["g"], r["b"]) for r in got} == {(77, 3, 255)}


def _plane(spark, w, h, p=0.3, q=-0.2):
    n = np.array([-p, -q, 1.0]) / np.sqrt(p * p + q * q + 1)
    return spark.createDataFrame([("d", x, y, *map(float, n)) for x in range(w) for y in range(h)], "dataset string, x int, y int, nx double, ny double, nz double")


def test_integration_of_a_plane(spark):
    for z in (integrate.integrate_bilateral(_plane(spark, 20, 16), 20, 16), integrate.integrate_bilateral(_plane(spark, 20, 16), 20, 16, 2.0), integrate.integrate_tiled(_plane(spark, 40, 30), 40, 30, tile=24, pad=4)):
        got = {(r["x"], r["y"]): r["z"] for r in z.collect()}
        assert abs(got[9, 5] - got[8, 5] - 0.3) < 0.02 and abs(got[9, 6] - got[9, 5] - 0.2) < 0.02  # normals have y up, rows go down


def test_fourier_passes(spark):
    rows = _plane(spark, 16, 12)
    flat = flatten.flatten_fourier(rows, 16, 12, 2.0).agg(F.max(F.abs("nx")), F.max(F.abs("ny")), F.min("nz")).first()
    assert flat[0] < 1e-6 and flat[1] < 1e-6 and flat[2] > 0.999
    assert integrate.integrate_fft(rows, 16, 12).count() == 192
    z = gaussian_blur(rows, ["nx"], 2.0).agg(F.max("nx") - F.min("nx")).first()[0]
    assert abs(z) < 1e-6
    blurred = flatten.flatten_blur(rows, 2.0).agg(F.max(F.abs("nx"))).first()[0]
    assert blurred < 1e-6


def test_point_flattening_of_a_quadric(spark):
    w = h = 30
    pts = [(3, 4), (10, 20), (27, 9), (15, 14), (22, 26), (5, 25), (18, 3), (28, 17), (12, 8)]
    z = lambda x, y: 2.0 * ((x - w / 2) / w) ** 2 - 1.0 * ((h / 2 - y) / w) ** 2
    model = flatten.point_model([(x, y, z(x, y)) for x, y in pts], w, h, True)
    rows = spark.createDataFrame([("d", x, y, float(z(x, y))) for x in range(w) for y in range(h)], "dataset string, x int, y int, z double")
    assert flatten.flatten_points_heights(rows, model, w, h).agg(F.max(F.abs("z"))).first()[0] < 1e-9
    n = lambda x, y: (-4.0 * (x - w / 2) / w, 2.0 * (h / 2 - y) / w, 1.0)
    unit = lambda v: tuple(float(c) for c in np.array(v) / np.linalg.norm(v))
    model = flatten.point_model([(x, y, *unit(n(x, y))) for x, y in pts], w, h, False)
    rows = spark.createDataFrame([("d", x, y, *unit(n(x, y))) for x in range(w) for y in range(h)], "dataset string, x int, y int, nx double, ny double, nz double")
    assert flatten.flatten_points_normals(rows, model, w, h).agg(F.min("nz")).first()[0] > 1 - 1e-9


def test_ellipse_and_circle(spark):
    t = np.linspace(0, 2 * np.pi, 12, endpoint=False)
    rows = [("d", 0, float(3 * np.cos(a) + 5), float(2 * np.sin(a) - 1)) for a in t] + [("d", 1, x, y) for x, y in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))]
    border = spark.createDataFrame(rows, "dataset string, sphere_id int, x double, y double")
    e = {r["sphere_id"]: r for r in lights.fit_ellipse(border).collect()}
    assert np.allclose([e[0][k] for k in ("cx", "cy", "major", "minor")], [5, -1, 3, 2], atol=1e-6) and e[1]["major"] is None
    c = {r["sphere_id"]: r for r in aggregate.fit_circle(border).collect()}
    assert np.allclose([c[1][k] for k in ("cx", "cy", "radius")], [0, 0, 1])


def test_central_highlight_faces_the_camera(spark):
    s = spark.createDataFrame([("d", 0, 50.0, 40.0, 10.0)], "dataset string, sphere_id int, cx double, cy double, radius double")
    h = spark.createDataFrame([("d", 0, 0, 50.0, 40.0), ("d", 0, 1, 0.0, 0.0)], "dataset string, sphere_id int, light_id int, hx double, hy double")
    for f in (0.0, 500.0):
        got = {r["light_id"]: (r["lx"], r["ly"], r["lz"]) for r in lights.highlight_directions(h, s, width=100, height=80, focal_px=f).collect()}
        assert np.allclose(got[0], (0, 0, 1), atol=1e-9) and got[1] == (0, 0, 0)


def test_light_lists(spark):
    texts = spark.createDataFrame([("a", "2\nmy photo.jpg 0 0 2\nb.jpg 1 0 0\n"), ("b", "x\n")], "dataset string, text string")
    got = documents.parse_lp(texts, strict=False).orderBy("light_id").collect()
    assert [(r["filename"], r["lx"], r["lz"]) for r in got] == [("my photo.jpg", 0.0, 1.0), ("b.jpg", 1.0, 0.0)]
    with pytest.raises(Exception, match="bad light count"):
        documents.parse_lp(texts).collect()
    with pytest.raises(Exception, match="no direction"):
        documents.lp_texts(spark.createDataFrame([("a", 0, "f", 0.0, 0.0, 0.0)], "dataset string, light_id int, filename string, lx double, ly double, lz double")).collect()


def test_old_luma_file():
    terms = np.arange(12, dtype=np.uint8)
    data = b"PTM_1.2\nPTM_FORMAT_LRGB\n2\n1\n1 2 3 4 5 6\n0 51 102 153 204 255\n" + terms.tobytes() + bytes([100, 101, 102, 103, 104, 105])
    head, q = images.parse_legacy("x", data)
    assert head["colorspace"] == "lrgb" and head["scale"] == [6, 4, 5, 1, 3, 2] and q.shape == (1, 2, 9)
    assert q[0, 0].tolist() == [100, 101, 102, 5, 3, 4, 0, 2, 1]


def test_empty_and_degenerate_input(spark):
    none = X.stack(spark, SMALL).where("false")
    assert normals.normals_l2(none, X.lights(spark, SMALL)).count() == 0 and stack.to_pixels(none, 16).count() == 0
    two = normals.normals_l2(X.stack(spark, SMALL).where("light_id < 2"), X.lights(spark, SMALL))
    assert two.where("nx is not null").count() == 0 and normals.fix_normals(two).where("nz > 0.9").count() == two.count()
    assert algebra.gram(none.select(F.array("r").alias("v")), ["v"])[0] == 0


def test_ranges_of_a_plane_with_outliers(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1e-6, 20_000), [1e12, -1e9, 5.0]])
    rows = spark.createDataFrame([("d", p, float(x)) for p, s in ((0, v), (1, np.repeat(v[:50], 40))) for x in s], "dataset string, plane int, value double")
    got = {r["plane"]: (r["vmin"], r["vmax"]) for r in aggregate.plane_ranges(rows, small=50).collect()}
    for p, s in ((0, np.sort(v)), (1, np.sort(np.repeat(v[:50], 40)))):
        assert got[p] == (s[int((1 - 0.995) / 2 * len(s))], s[min(int((1 + 0.995) / 2 * len(s)), len(s) - 1)])


def _plain_rpca(d, rounds=100, tol=1e-6):
    """Inexact augmented Lagrangian on one matrix, sparse part first."""
    lam, sigma = 1 / np.sqrt(max(d.shape)), np.linalg.svd(d, compute_uv=False)[0]
    y, a, mu = d / max(sigma, np.abs(d).max() / lam), np.zeros_like(d), 1.25 / sigma
    most = mu * 1e7
    for _ in range(rounds):
        t = d - a + y / mu
        e = np.sign(t) * np.maximum(np.abs(t) - lam / mu, 0)
        u, s, v = np.linalg.svd(d - e + y / mu, full_matrices=False)
        a = (u * np.maximum(s - 1 / mu, 0)) @ v
        z = d - a - e
        y, mu = y + mu * z, min(mu * 1.5, most)
        if np.linalg.norm(z) / np.linalg.norm(d) < tol:
            break
    return a


def test_low_rank_normals_of_each_dataset(spark):
    px = X.pixels(spark, SMALL, specular=True).where("dataset in ('F', 'P')")
    got = {(r["dataset"], r["x"], r["y"]): (r["nx"], r["ny"], r["nz"]) for r in robust.normals_rpca(px, L).collect()}
    rows = px.collect()
    for name in ("F", "P"):
        part = [r for r in rows if r["dataset"] == name]
        n = _plain_rpca(np.array([(np.array(r["r"]) + r["g"] + r["b"]) / 3 for r in part])) @ np.linalg.pinv(L).T
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        assert np.abs(n - np.array([got[name, r["x"], r["y"]] for r in part])).max() < 1e-4


def test_positional_fit_blends_its_nodes(spark):
    w, h = X.sizes(spark, SMALL)
    px = X.pixels(spark, SMALL).collect()[::53]
    got = {(r["dataset"], r["x"], r["y"]): r["c"] for r in fit.fit_poly_3d(X.pixels(spark, SMALL), X.POSITIONS, "ptm", 6, width=w, height=h, pixel=0.1).collect()}
    for r in px:
        u, v = 14 * r["x"] / w, 14 * r["y"] / h
        want = 0
        for j in range(15):
            for i in range(15):
                k = max(0, 1 - abs(u - i)) * max(0, 1 - abs(v - j))
                if k:
                    seat = np.array([(i * w / 14 - w / 2) * 0.1, (h - 1 - j * h / 14 - h / 2) * 0.1, 0])
                    ray = X.POSITIONS - seat
                    a, b = (ray / np.linalg.norm(ray, axis=1, keepdims=True)).T[:2]
                    terms = np.column_stack([np.ones(16), a, b, a * a, a * b, b * b])
                    want = want + k * np.linalg.lstsq(terms, np.column_stack([r["r"], r["g"], r["b"]]), rcond=None)[0]
        assert np.allclose(got[r["dataset"], r["x"], r["y"]], np.ravel(want), atol=1e-6)


def test_decorrelation_stretch_equals_plain_one(spark):
    w, h = X.sizes(spark, SMALL)
    img = np.zeros((h, w, 3))
    for r in X.raster(spark, SMALL).collect():
        img[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    across, down = int(np.ceil(np.sqrt(1000) * w / h)), int(np.ceil(np.sqrt(1000) * h / w))
    picked = img[:: max(1, h // down), :: max(1, w // across)].reshape(-1, 3)
    cov = np.cov(picked.T)
    values, vectors = np.linalg.eigh(cov)
    t = np.diag(np.sqrt(np.diag(cov))) @ vectors @ np.diag(1 / np.sqrt(np.abs(values))) @ vectors.T
    out = np.trunc(np.round(img @ t.T, 9))
    lo, hi = out.min(axis=(0, 1)), out.max(axis=(0, 1))
    want = np.trunc(np.round(255 * (out - lo) / (hi - lo), 9))
    got = np.zeros_like(want)
    for r in render.dstretch(X.raster(spark, SMALL), w, h).collect():
        got[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    assert (got == want).mean() > 0.999 and np.abs(got - want).max() <= 255 / (hi - lo).min() + 1


def test_refined_highlights_equal_plain_ones(spark):
    from lumastack.plans import surfaces as S

    photos, spheres = S._photos(spark, SMALL), S._spheres(spark, SMALL)
    found = lights.detect_highlights(photos, spheres)
    got = {(r["sphere_id"], r["light_id"]): (r["hx"], r["hy"]) for r in lights.refine_highlights(photos, spheres, found).collect()}
    assert len(got) == found.count()
    img = {(r["light_id"], r["x"], r["y"]): (11 * r["r"] + 16 * r["g"] + 5 * r["b"]) // 32 for r in photos.collect()}
    ball = {r["sphere_id"]: r for r in spheres.collect()}
    for r in found.collect():
        s, hx, hy = ball[r["sphere_id"]], r["hx"], r["hy"]
        if r["threshold"]:
            inner = 12 * np.sin(np.radians(50))
            box = [int(np.floor(s["cx"] - inner)), int(np.ceil(s["cx"] + inner)), int(np.floor(s["cy"] - inner)), int(np.ceil(s["cy"] + inner))]
            lit = [(x, y, v) for (k, x, y), v in img.items() if k == r["light_id"] and v >= r["threshold"] and box[0] <= x < box[1] and box[2] <= y < box[3] and (x - s["cx"]) ** 2 + (y - s["cy"]) ** 2 <= inner**2]
            side = box[1] - box[0]
            radius, least = int(np.ceil(side / 2)), int(np.ceil(0.02 * side))
            for _ in range(6):
                near = [(x, y, v) for x, y, v in lit if abs(x - hx) <= radius and abs(y - hy) <= radius]
                total = sum(v for *_, v in near)
                if not total:
                    break
                hx, hy = sum(x * v for x, _, v in near) / total, sum(y * v for _, y, v in near) / total
                if radius <= least:
                    break
                radius = int(np.ceil(radius / 2))
        assert np.allclose(got[r["sphere_id"], r["light_id"]], (hx, hy), atol=1e-9)


def test_parallax_positions_meet_the_rays(spark):
    rng = np.random.default_rng(4)
    true, rows = rng.normal(0, 1, (9, 3)), []
    true[:, 2] = np.abs(true[:, 2])
    true *= 300 / np.linalg.norm(true, axis=1, keepdims=True)
    true[8] *= 1.05  # within a tenth of the median radius: stays
    for k, p in enumerate(true):
        for s in range(3):
            o = rng.normal(0, 20, 3)
            rows.append(("d", s, k, *map(float, (p - o) / np.linalg.norm(p - o)), *map(float, o)))
    rays = spark.createDataFrame(rows, "dataset string, sphere_id int, light_id int, lx double, ly double, lz double, ox double, oy double, oz double")
    got = {r["light_id"]: (r["px"], r["py"], r["pz"]) for r in lights.parallax_positions(rays).collect()}
    assert np.allclose([got[k] for k in range(9)], true, atol=1e-3)


def test_resample_map_equals_plain_one():
    """Guess by Gaussian weights over the lights, then regularised least squares for what reading at the lights misses."""
    res, sigma, reg = 8, 0.3, 0.1
    at = []
    for j in range(res):
        for i in range(res):
            u, v = 2 * i / (res - 1) - 1, 2 * j / (res - 1) - 1
            x, y = (u - v) / 2, (u + v) / 2
            n = np.array([x, y, 1 - abs(x) - abs(y)])
            at.append(n / np.linalg.norm(n))
    guess = np.exp(-((np.array(at)[:, None] - L[None]) ** 2).sum(axis=2) / sigma**2)
    guess /= guess.sum(axis=1, keepdims=True)
    guess[guess <= 0.005] = 0
    guess /= guess.sum(axis=1, keepdims=True)
    read = np.zeros((16, res * res))
    for k, (x, y, z) in enumerate(L):
        s = abs(x) + abs(y) + abs(z)
        u, v = ((x + y) / s + 1) / 2 * (res - 1), ((y - x) / s + 1) / 2 * (res - 1)
        for j in range(res):
            for i in range(res):
                read[k, j * res + i] = max(0, 1 - abs(u - i)) * max(0, 1 - abs(v - j))
    fixed = np.linalg.lstsq(np.vstack([read, np.sqrt(reg) * np.eye(res * res)]), np.vstack([np.eye(16) - read @ guess, np.zeros((res * res, 16))]), rcond=None)[0]
    want = guess + fixed
    want[np.abs(want) <= 0.005] = 0
    assert np.allclose(fit.resample_map(L, res, sigma, reg), want, atol=1e-9)


def test_flattening_by_points_equals_plain_model(spark):
    from lumastack.plans import registered
    from lumastack.plans import surfaces as S

    w, h = X.sizes(spark, SMALL)
    pts = np.array(S._picked(spark, SMALL))
    u, v = (pts[:, 0] - w / 2) / w, (h / 2 - pts[:, 1]) / w
    powers = flatten._slope_terms(len(pts))
    du = np.column_stack([i * u ** max(i - 1, 0) * v**j for i, j in powers])
    dv = np.column_stack([j * u**i * v ** max(j - 1, 0) for i, j in powers])
    k = np.linalg.lstsq(np.vstack([du, dv]), np.concatenate([-pts[:, 2] / pts[:, 4], -pts[:, 3] / pts[:, 4]]), rcond=None)[0]
    got = {(r["x"], r["y"]): (r["nx"], r["ny"], r["nz"]) for r in registered()[0]["f6_flatten_points_normals"](spark, SMALL).collect()}
    for r in X.truth(spark, SMALL, "d").collect()[::37]:
        a, b = (r["x"] - w / 2) / w, (h / 2 - r["y"]) / w
        m = np.array([-sum(c * i * a ** max(i - 1, 0) * b**j for c, (i, j) in zip(k, powers, strict=True)), -sum(c * j * a**i * b ** max(j - 1, 0) for c, (i, j) in zip(k, powers, strict=True)), 1.0])
        m /= np.linalg.norm(m)
        axis, n = np.cross(m, [0, 0, 1.0]), np.array([r["nx"], r["ny"], r["nz"]])
        turned = n * m[2] + np.cross(axis, n) + axis * (axis @ n) / (1 + m[2])
        assert np.allclose(got[r["x"], r["y"]], turned, atol=2e-6)


def _grid(rows, names, w, h):
    out = np.zeros((len(names), h, w))
    for r in rows:
        out[:, r["y"], r["x"]] = [r[c] for c in names]
    return out


def test_fourier_and_blur_jobs_equal_plain_ones(spark):
    w, h = X.sizes(spark, SMALL)
    rows = X.truth(spark, SMALL, "d").drop("k")
    n = _grid(rows.collect(), ("nx", "ny", "nz"), w, h)
    # integration: slopes mirrored with a changed sign along their own axis
    k, p, q = min(w, h) // 2, n[0] / n[2], -n[1] / n[2]
    mirror = lambda v, axis, s: np.concatenate([s * np.flip(v.take(range(k), axis), axis), v, s * np.flip(v.take(range(v.shape[axis] - k, v.shape[axis]), axis), axis)], axis)
    p, q = mirror(mirror(p, 1, -1), 0, 1), mirror(mirror(q, 1, 1), 0, -1)
    wy, wx = np.meshgrid(np.fft.fftfreq(h + 2 * k), np.fft.fftfreq(w + 2 * k), indexing="ij")
    z = np.fft.ifft2((-1j * wx * np.fft.fft2(p) - 1j * wy * np.fft.fft2(q)) / (wx**2 + wy**2 + 1e-12)).real[k : k + h, k : k + w] / (2 * np.pi)
    assert np.abs(_grid(integrate.integrate_fft(rows, w, h).collect(), ("z",), w, h)[0] - z).max() < 1e-6
    # high-pass of normals stretched to angles, on a grid mirrored by a fifth without its edge
    t = np.arccos(np.clip(n[2], -1, 1))
    stretch = np.where(np.sin(t) > 1e-9, t / np.maximum(np.sin(t), 1e-9), 1.0)
    kx, ky = int(w * 0.2), int(h * 0.2)
    y, x = np.arange(h + 2 * ky), np.arange(w + 2 * kx)
    fy, fx = np.meshgrid(np.minimum(y, len(y) - y), np.minimum(x, len(x) - x), indexing="ij")
    keep = 1 - np.exp(-(fx**2 + fy**2) / (2 * 3.0**2))
    low = [np.fft.ifft2(np.fft.fft2(np.pad(c * stretch, ((ky, ky), (kx, kx)), "reflect")) * keep).real[ky : ky + h, kx : kx + w] for c in n[:2]]
    a = np.hypot(*low)
    shrink = np.where(a > 1e-9, np.sin(np.minimum(a, np.pi / 2)) / np.maximum(a, 1e-9), 1.0)
    want = np.stack([low[0] * shrink, low[1] * shrink])
    got = _grid(flatten.flatten_fourier(rows, w, h, 3.0).collect(), ("nx", "ny", "nz"), w, h)
    assert np.abs(got[:2] - want).max() < 1e-9 and np.abs(got[2] - np.sqrt(np.maximum(0, 1 - (want**2).sum(axis=0)))).max() < 1e-9

    def blurred(v):  # third-order recursion there and back, along rows and then columns
        q_ = 0.98711 * 3.0 - 0.96330
        b = np.array([1.57825 + 2.44413 * q_ + 1.4281 * q_**2 + 0.422205 * q_**3, 2.44413 * q_ + 2.85619 * q_**2 + 1.26661 * q_**3, -(1.4281 * q_**2 + 1.26661 * q_**3), 0.422205 * q_**3])
        b = b[1:] / b[0]
        for _ in range(2):
            lines = []
            for line in v:
                for _ in range(2):
                    past, out = [line[0]] * 3, []
                    for e in line:
                        past = [(1 - b.sum()) * e + b @ past, *past[:2]]
                        out.append(past[0])
                    line = out[::-1]
                lines.append(line)
            v = np.array(lines).T
        return v

    got = _grid(gaussian_blur(rows, ["nx", "ny"], 3.0).collect(), ("nx", "ny"), w, h)
    assert np.abs(got - [blurred(n[0]), blurred(n[1])]).max() < 1e-9
    s = np.stack([n[0] / n[2] - blurred(n[0] / n[2]), n[1] / n[2] - blurred(n[1] / n[2]), np.ones((h, w))])
    got = _grid(flatten.flatten_blur(rows, 3.0).collect(), ("nx", "ny", "nz"), w, h)
    assert np.abs(got - s / np.linalg.norm(s, axis=0)).max() < 1e-9


def test_robust_normals_equal_plain_ones(spark):
    """Huber weights on the values in range, a pixel at a time."""
    px = X.pixels(spark, SMALL, specular=True)
    got = {(r["dataset"], r["x"], r["y"]): (r["nx"], r["ny"], r["nz"]) for r in robust.normals_robust(px, L).collect()}
    for r in px.collect()[::61]:
        v = (np.array(r["r"]) + r["g"] + r["b"]) / 3
        use = np.flatnonzero(np.maximum(v - 255, 5 - v) <= 0)
        assert len(use) > 5
        x = np.linalg.lstsq(L[use], v[use], rcond=None)[0]
        w = np.ones(len(use))
        for _ in range(10):
            res = np.abs(v[use] - L[use] @ x)
            new = np.where(res <= 5, 1.0, 5 / np.maximum(res, 1e-6))
            moved, w = np.abs(new - w).max(), new
            x = np.linalg.lstsq(np.sqrt(w)[:, None] * L[use], np.sqrt(w) * v[use], rcond=None)[0]
            if moved < 1e-4:
                break
        assert np.allclose(got[r["dataset"], r["x"], r["y"]], x / np.linalg.norm(x), atol=1e-6)


def test_least_absolute_deviations_cannot_be_improved(spark):
    px = X.pixels(spark, SMALL, specular=True)
    got = {(r["dataset"], r["x"], r["y"]): np.array([r["nx"], r["ny"], r["nz"]]) for r in robust.normals_l1(px, L, rounds=200).collect()}
    rng = np.random.default_rng(7)
    for r in px.collect()[::97]:
        v, n = (np.array(r["r"]) + r["g"] + r["b"]) / 3, got[r["dataset"], r["x"], r["y"]]
        cost = lambda m: min(np.abs(v - (L @ m) * a).sum() for a in v / (L @ m))  # noqa: B023, E731
        assert all(cost(n) <= cost((m := n + rng.normal(0, 0.01, 3)) / np.linalg.norm(m)) + 1e-3 for _ in range(20))


def test_pixels_of_packed_samples(spark):
    """Pixels of samples in any order, with repeats, nulls, places below 0 and lights beyond the last, against a plain version."""
    rng = np.random.default_rng(4)
    pick = lambda v: None if rng.random() < 0.1 else v
    rows = [(pick("d"), int(rng.integers(-1, 5)), int(rng.integers(-300, 300)) // 100 * 100, pick(int(rng.integers(-3, 3))), *(pick(float(v)) for v in rng.integers(0, 3, 3))) for _ in range(4000)]
    samples = spark.createDataFrame(rows, "dataset string, light_id int, x int, y long, r double, g double, b double").repartition(5)
    found: dict = {}
    below = lambda v: [(c is not None, c or 0.0) for c in v]
    for name, light, x, y, *v in rows:
        lights = found.setdefault((name, x, y), {})
        if light not in lights or below(v) > below(lights[light]):
            lights[light] = v
    for incomplete in ("drop", "null"):
        out = stack.to_pixels(samples, 6, incomplete=incomplete)
        assert [f.dataType.simpleString() for f in out.schema] == ["string", "int", "bigint", *["array<double>"] * 3]
        got = {(r["dataset"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in out.collect()}
        want = {}
        for key, lights in found.items():
            if incomplete == "null":
                want[key] = tuple([lights.get(i, (None,) * 3)[c] for i in range(6)] for c in range(3))
            elif len(lights) == 6:
                want[key] = tuple([lights[i][c] for i in sorted(lights)] for c in range(3))
        assert got == want and len(want)


def test_pixels_shuffle_their_values_alone(spark):
    """Tasks pack what they read: a few rows a block are dealt out, none a pixel."""
    samples = X.stack(spark, SMALL)
    plan = stack.to_pixels(samples, 16)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "_bx" in below.split("\n")[0] and "MapInArrow" in below and "Aggregate" not in below
    assert stack.to_pixels(samples, 16).count() == 1500


def test_packed_samples_are_squeezed(spark):
    """Values that come again anywhere in a part take little of the shuffle: here each pixel, after 500 others (64 KB a channel)."""
    at, light = np.repeat(np.arange(1 << 14), 16), np.tile(np.arange(16), 1 << 14)
    v = np.random.default_rng(8).random((500, 16))[at % 500, light]
    rows = pa.table({"dataset": pa.array(["d"] * len(at)), "x": at % 128, "y": at // 128, "light_id": light, "r": v, "g": v * 0.8, "b": v * 0.6})
    parts = list(stack._packed(128)(iter(rows.to_batches(max_chunksize=10_000))))
    size = sum(c.nbytes for b in parts for c in b.columns if c.type == pa.binary())
    assert size < 24 * len(at) / 10 and sum(b.num_rows for b in parts) == 1
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in stack.to_pixels(spark.createDataFrame(rows), 16).collect()}
    want = v.reshape(-1, 16)
    assert len(got) == 1 << 14 and all(np.array_equal(got[k % 128, k // 128], want[k] * np.array([[1], [0.8], [0.6]])) for k in range(1 << 14))


def test_packed_samples_in_mixed_order_take_little_beside_their_values():
    """Pixels that never repeat, four of a block in a part: places and lights add less than a twelfth to the values' 24 bytes."""
    n = 1 << 12
    pixel = np.repeat(np.random.default_rng(9).permutation(n), 16)
    x, y = pixel // 4 % 32 * 128 + pixel % 4 * 37, pixel // 128 * 128 + pixel % 4 * 29
    v = np.random.default_rng(10).random(16 * n)
    rows = pa.table({"dataset": pa.array(["d"] * len(v)), "x": x, "y": y, "light_id": np.tile(np.arange(16), n), "r": v, "g": v * 0.8, "b": v * 0.6})
    (part,) = stack._packed(128)(iter(rows.to_batches(max_chunksize=10_000)))
    size = sum(len(b) for c in part.columns if c.type == pa.binary() for b in c.to_pylist() if b is not None)
    assert part.num_rows == n // 4 and size < 26 * len(v)


def test_rounds_of_robust_pca_are_made_again(spark, monkeypatch):
    """Rows are stored once, not each round, and rounds that start from stored rows give the same normals."""
    px = X.pixels(spark, SMALL, specular=True)
    keep, writes = robust.stored, []
    monkeypatch.setattr(robust, "stored", lambda *a: writes.append(1) or keep(*a))
    whole = {(r["dataset"], r["x"], r["y"]): (r["nx"], r["ny"], r["nz"]) for r in robust.normals_rpca(px, X.LIGHTS).collect()}
    assert len(writes) == 1
    monkeypatch.setattr(robust, "REMADE", 7)
    parts = {(r["dataset"], r["x"], r["y"]): (r["nx"], r["ny"], r["nz"]) for r in robust.normals_rpca(px, X.LIGHTS).collect()}
    assert len(writes) > 2 and whole.keys() == parts.keys() and len(whole) == 1500
    assert max(abs(np.subtract(v, parts[k])).max() for k, v in whole.items()) < 1e-9
