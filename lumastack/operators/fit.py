"""Reflectance models: fitting, bases, quantising and merging."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import gram, grams, listed, matmul, pinv, sorted_eigh, stacked

CHANNELS = ("r", "g", "b")
PTM_ORDER = [5, 3, 4, 0, 2, 1]  # fixed value: the file order of polynomial terms


def weights_of(directions: np.ndarray, basis: str, n: int) -> np.ndarray:
    """The light terms of directions (rows of x, y, z): rows x n, for ptm, hsh or sh."""
    x, y, z = np.asarray(directions, float).T
    pi = math.pi
    if basis == "ptm":
        terms, degree = [], 0
        while len(terms) < n:
            terms += [x ** (degree - k) * y**k for k in range(degree + 1)]
            degree += 1
    elif basis == "hsh":
        phi = np.arctan2(y, x) % (2 * pi)
        c = np.cos(np.minimum(np.arccos(np.clip(z, -1, 1)), pi / 2 - 0.01))
        s = np.sqrt(np.maximum(c - c * c, 0))
        one = np.ones_like(c)
        terms = [one / math.sqrt(2 * pi), math.sqrt(6 / pi) * np.cos(phi) * s, math.sqrt(1.5 / pi) * (2 * c - 1), math.sqrt(6 / pi) * np.sin(phi) * s]
        terms += [math.sqrt(30 / pi) * np.cos(2 * phi) * (c * c - c), math.sqrt(30 / pi) * np.cos(phi) * (2 * c - 1) * s, math.sqrt(2.5 / pi) * (1 - 6 * c + 6 * c * c)]
        terms += [math.sqrt(30 / pi) * np.sin(phi) * (2 * c - 1) * s, math.sqrt(30 / pi) * np.sin(2 * phi) * (c * c - c)]
    else:
        phi, ct = np.arctan2(y, x), np.clip(z, -1, 1)
        st = np.sqrt(1 - ct * ct)
        a, b = 0.5 * math.sqrt(3 / pi), math.sqrt(15 / pi)
        terms = [np.full_like(ct, 0.5 / math.sqrt(pi)), a * np.sin(phi) * st, a * ct, a * np.cos(phi) * st, 0.25 * b * np.sin(2 * phi) * st**2]
        terms += [0.5 * b * st * ct * np.sin(phi), 0.25 * math.sqrt(5 / pi) * (3 * ct**2 - 1), 0.5 * b * st * ct * np.cos(phi), 0.25 * b * st**2 * np.cos(2 * phi)]
    return np.column_stack(terms[:n])


def rbf_weights(lights: np.ndarray, directions: np.ndarray, sigma: float, least: float = 0.001) -> np.ndarray:
    """Gaussian weights of the lights for each direction, small ones dropped: directions x lights."""
    d2 = ((directions[:, None, :] - lights[None]) ** 2).sum(axis=2)
    w = np.exp(-d2 / sigma**2)
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    w[w <= least] = 0
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)


def rbf_weight_rows(directions: DataFrame, lights: np.ndarray, sigma: float, least: float = 0.001, *, keys: tuple[str, ...] = ("dataset", "x", "y")) -> DataFrame:
    """(keys, light_id, weight) of rows (keys, nx, ny, nz): the lights that ``rbf_weights`` leaves for each direction."""

    @F.arrow_udf("array<double>")
    def weights(nx: pa.Array, ny: pa.Array, nz: pa.Array) -> pa.Array:
        return listed(rbf_weights(lights, np.column_stack([v.to_numpy(zero_copy_only=False) for v in (nx, ny, nz)]), sigma, least))

    rows = directions.select(*keys, F.posexplode(weights("nx", "ny", "nz")).alias("light_id", "weight"))
    return rows.where("weight > 0")


def grid_directions(res: int) -> np.ndarray:
    j, i = np.divmod(np.arange(res * res), res)
    o, p = 2 * i / (res - 1) - 1, 2 * j / (res - 1) - 1
    x, y = (o - p) / 2, (o + p) / 2
    z = np.maximum(0, 1 - np.abs(x) - np.abs(y))
    v = np.column_stack([x, y, z])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def grid_weights(directions: np.ndarray, res: int) -> np.ndarray:
    """The bilinear weights of directions on the octahedral grid: directions x res^2."""
    x, y, z = directions.T
    s = np.abs(x) + np.abs(y) + np.abs(z)
    u, v = (np.clip(((a / s) + 1) / 2 * (res - 1), 0, res - 1) for a in (x + y, y - x))
    i, j = np.minimum(np.floor(u), res - 2).astype(int), np.minimum(np.floor(v), res - 2).astype(int)
    a, b = u - i, v - j
    out, at = np.zeros((len(x), res * res)), np.arange(len(x))
    for di, dj, w in ((0, 0, (1 - a) * (1 - b)), (1, 0, a * (1 - b)), (0, 1, (1 - a) * b), (1, 1, a * b)):
        np.add.at(out, (at, (j + dj) * res + i + di), w)
    return out


def resample_map(lights: np.ndarray, res: int = 8, sigma: float = 0.125, reg: float = 0.1, least: float = 0.005) -> np.ndarray:
    """The linear map from values at the lights to values at the grid's nodes (res^2 x N).

    A Gaussian guess, corrected by regularised least squares so that reading the grid at the lights gives their values back.
    """
    n = len(lights)
    guess = rbf_weights(lights, grid_directions(res), sigma, least)
    a = grid_weights(lights, res)
    out = guess + np.linalg.solve(a.T @ a + reg * np.eye(res * res), a.T @ (np.eye(n) - a @ guess))
    out[np.abs(out) <= least] = 0
    return out


def resample(pixels: DataFrame, grid_map: np.ndarray) -> DataFrame:
    """Pixels with values at grid nodes in place of lights: one broadcast product, no shuffle."""
    return pixels.select("dataset", "x", "y", *(matmul([c], grid_map.T).alias(c) for c in CHANNELS))


def node_lights(positions: np.ndarray, width: int, height: int, pixel: float, nx: int = 15, ny: int = 15) -> np.ndarray:
    """Unit light directions as seen from the nodes of a grid over the image: nodes x lights x 3."""
    j, i = np.divmod(np.arange(nx * ny), nx)
    x, y = i * width / (nx - 1), height - 1 - j * height / (ny - 1)
    at = np.column_stack([(x - width / 2) * pixel, (y - height / 2) * pixel, np.zeros(nx * ny)])
    rel = positions[None] - at[:, None]
    return rel / np.linalg.norm(rel, axis=2, keepdims=True)


def blended(pixels: DataFrame, matrices: np.ndarray, width: int, height: int, nx: int = 15, ny: int = 15) -> DataFrame:
    """``c``: per pixel the bilinear blend of the four nearest nodes' linear maps (nodes x outputs x lights), channel after channel within an output."""

    @F.arrow_udf("array<double>")
    def apply(x: pa.Array, y: pa.Array, r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        v = np.stack([stacked(r), stacked(g), stacked(b)], axis=2)
        px, py = (nx - 1) * x.to_numpy() / width, (ny - 1) * y.to_numpy() / height
        i, j = np.minimum(px.astype(int), nx - 2), np.minimum(py.astype(int), ny - 2)
        a, d = px - i, py - j
        out = np.zeros((len(x), matrices.shape[1], 3))
        cell = j * nx + i
        for node in np.unique(cell):  # the pixels of a cell share their four maps: plain products
            at = np.flatnonzero(cell == node)
            for di, dj, w in ((0, 0, (1 - a) * (1 - d)), (1, 0, a * (1 - d)), (0, 1, (1 - a) * d), (1, 1, a * d)):
                out[at] += w[at, None, None] * (matrices[node + dj * nx + di] @ v[at])
        return listed(out.reshape(len(out), -1))

    return pixels.select("dataset", "x", "y", apply("x", "y", *CHANNELS).alias("c"))


def fit_poly(pixels: DataFrame, lights: np.ndarray, basis: str, n: int, *, keep: bool = False) -> DataFrame:
    """Least-squares coefficients (dataset, x, y, c), c = term after term with r, g, b in each (3n values).

    With ``keep`` the pixel's values stay beside them.
    """
    m = pinv(weights_of(lights, basis, n))
    full = np.zeros((3 * len(lights), 3 * n))
    for c in range(3):
        full[c * len(lights) : (c + 1) * len(lights), c::3] = m.T
    return pixels.select("dataset", "x", "y", *(CHANNELS if keep else ()), matmul(list(CHANNELS), full).alias("c"))


def fit_poly_3d(pixels: DataFrame, positions: np.ndarray, basis: str, n: int, *, width: int, height: int, pixel: float, nx: int = 15, ny: int = 15) -> DataFrame:
    """As ``fit_poly`` for lights at positions: the solutions of a grid of nodes, blended at each pixel."""
    at = node_lights(positions, width, height, pixel, nx, ny)
    return blended(pixels, np.stack([pinv(weights_of(d, basis, n)) for d in at]), width, height, nx, ny)


def fit_lrgb(pixels: DataFrame, lights: np.ndarray, n: int) -> DataFrame:
    """Base colour and luma terms: c = r, g, b of the base, then n polynomial terms of (r + g + b) / luma.

    The base is the mean weighted by 0.25 - (asin(lz) / (pi / 2) - 0.5)^2, favouring lights halfway up.
    """
    w = 0.25 - (np.arcsin(np.clip(lights[:, 2], -1, 1)) / (math.pi / 2) - 0.5) ** 2
    w = w / w.sum()
    m = pinv(weights_of(lights, "ptm", n))
    base = pixels.select("dataset", "x", "y", *CHANNELS, *(F.element_at(matmul([c], w[:, None]), 1).alias("b" + c) for c in CHANNELS))
    total = F.zip_with(F.zip_with("r", "g", lambda a, b: a + b), "b", lambda a, b: a + b)
    luma = F.nullif((F.col("br") + F.col("bg") + F.col("bb")) / 255, F.lit(0.0))
    rows = base.withColumn("rel", F.transform(total, lambda v: F.coalesce(F.try_divide(v, luma), F.lit(0.0))))
    return rows.select("dataset", "x", "y", F.concat(F.array("br", "bg", "bb"), matmul(["rel"], m.T)).alias("c"))


def fit_ycc(coeff: DataFrame, n: int) -> DataFrame:
    """RGB terms to Y terms and one chroma: every term / 255 to YCbCr; c = n luma terms, then mean Cb and Cr of the first three.

    Chroma is around 0.5; terms beyond the first three carry none.
    """
    y = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: (0.299 * F.get("c", 3 * p) + 0.587 * F.get("c", 3 * p + 1) + 0.114 * F.get("c", 3 * p + 2)) / 255)
    few = min(3, n)
    luma = lambda p: (0.299 * F.get("c", F.lit(3 * p)) + 0.587 * F.get("c", F.lit(3 * p + 1)) + 0.114 * F.get("c", F.lit(3 * p + 2))) / 255
    cb = sum(((F.get("c", F.lit(3 * p + 2)) / 255 - luma(p)) / 1.772 + 0.5 for p in range(few)), F.lit(0.0)) / few
    cr = sum(((F.get("c", F.lit(3 * p)) / 255 - luma(p)) / 1.402 + 0.5 for p in range(few)), F.lit(0.0)) / few
    return coeff.select("dataset", "x", "y", F.concat(y, F.array(cb, cr)).alias("c"))


def sample_pixels(pixels: DataFrame, width: int, height: int, ram_mb: float, dims: int, seed: int = 1) -> DataFrame:
    """A fixed pseudorandom subset of each row's pixels, for fitting bases: at most a quarter of a row, within a memory budget."""
    budget = min(ram_mb * math.floor(2**20 / (12 * dims)), width * height)
    per_row = int(min(budget / height, width / 4))
    w = Window.partitionBy("dataset", "y").orderBy(F.xxhash64("x", "y", F.lit(seed)), "x")
    return pixels.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_row).drop("_k")


def covariance(pixels: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance / (n - 1)) of the rows' lists end to end."""
    shift = 127.5  # the middle of the values, so that little cancels
    return _moments(*gram(pixels, columns, shift), shift)


def _moments(n: float, total: np.ndarray, second: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    mean = total / max(n, 1)
    return mean + shift, (second - n * np.outer(mean, mean)) / max(n - 1, 1)


def pca_basis(pixels: DataFrame, n: int, columns: tuple[str, ...] = CHANNELS) -> tuple[np.ndarray, np.ndarray]:
    """(mean clamped to 0..255, n unit eigenvectors as rows) of the pixels' values over all lights and channels."""
    mean, cov = covariance(pixels, list(columns))
    return np.clip(mean, 0, 255), sorted_eigh(cov)[1][:, :n].T


def to_ycc_pixels(pixels: DataFrame) -> DataFrame:
    """The lists of r, g, b as luma and two differences (yl, co, cg)."""
    z = F.arrays_zip(*CHANNELS)
    co = lambda e: e["r"] - e["b"]
    t = lambda e: e["b"] + co(e) / 2
    cg = lambda e: e["g"] - t(e)
    return pixels.select("dataset", "x", "y", F.transform(z, lambda e: t(e) + cg(e) / 2).alias("yl"), F.transform(z, co).alias("co"), F.transform(z, cg).alias("cg"))


def pca_basis_ycc(pixels: DataFrame, planes: tuple[int, int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, eigenvectors) of luma and of the two differences, with so many planes each; one pass over the pixels."""
    shift, names = 127.5, ("yl", "co", "cg")
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("dataset"), F.col(c).alias("v")) for c in names))).alias("e")
    found = grams(to_ycc_pixels(pixels).select(parts).select("e.*"), ["v"], lambda _, v: v - shift)
    out = []
    for c, n in zip(names, planes, strict=True):
        mean, cov = _moments(*found.get(c, (0.0, np.zeros(0), np.zeros((0, 0)))), shift)
        out.append((mean, sorted_eigh(cov)[1][:, :n].T))
    return out


def ycc_plane_order(planes: tuple[int, int, int]) -> list[tuple[int, int]]:
    """(channel, plane) in file order: triples as long as the differences last, then the luma that is left."""
    y0, y1, _ = planes
    return [(c, p) for p in range(y1) for c in range(3)] + [(0, p) for p in range(y1, y0)]


def project(pixels: DataFrame, mean: np.ndarray, basis: np.ndarray, columns: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Coefficients (dataset, x, y, c) of pixels on a basis."""
    return pixels.select("dataset", "x", "y", matmul(list(columns), basis.T, mean).alias("c"))


def project_ycc(pixels: DataFrame, bases: list[tuple[np.ndarray, np.ndarray]], planes: tuple[int, int, int]) -> DataFrame:
    """Coefficients (dataset, x, y, c) on the bases of ``pca_basis_ycc``, in file order; all inside the pixel's row."""
    parts = [matmul([c], b.T, m).alias(c) for c, (m, b) in zip(("yl", "co", "cg"), bases, strict=True)]
    rows = to_ycc_pixels(pixels).select("dataset", "x", "y", *parts)
    return rows.select("dataset", "x", "y", F.array(*[F.get(("yl", "co", "cg")[c], F.lit(p)) for c, p in ycc_plane_order(planes)]).alias("c"))


def planes_long(coeff: DataFrame) -> DataFrame:
    """(dataset, plane, value) of all coefficients."""
    return coeff.select("dataset", F.posexplode("c").alias("plane", "value"))


def finalize_planes(ranges: DataFrame, *, common: bool = False, base: int = 0) -> DataFrame:
    """(dataset, plane, vmin, vmax, scale, bias) of ranges; ``common`` joins r, g, b of a term; the first ``base`` planes are bytes."""
    rows = ranges
    if common:
        w = Window.partitionBy("dataset", F.floor(F.col("plane") / 3))
        rows = rows.withColumns({"vmin": F.min("vmin").over(w), "vmax": F.max("vmax").over(w)})
    width = F.col("vmax") - F.col("vmin")
    plain = F.col("plane") < base
    return rows.withColumns({"scale": F.when(plain, 1.0).otherwise(width / 255), "bias": F.when(plain, 0.0).otherwise(-F.col("vmin") / width)})


def quantized(v: Column, scale: Column, bias: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.round(255 * (v / 255 / scale + bias), 9).cast("int"), F.lit(255)))


def dequantized(q: Column, scale: Column, bias: Column) -> Column:
    return 255 * (q / 255.0 - bias) * scale


def _with_planes(coeff: DataFrame, planes: DataFrame) -> DataFrame:
    """Coefficients with their dataset's scales and biases in plane order; planes are few."""
    lists = planes.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("plane", "scale", "bias"))).alias("_p"))
    return coeff.join(F.broadcast(lists), "dataset")


def quantize(coeff: DataFrame, planes: DataFrame) -> DataFrame:
    """(dataset, x, y, q): coefficients as bytes."""
    return _with_planes(coeff, planes).select("dataset", "x", "y", F.zip_with("c", "_p", lambda v, p: quantized(v, p["scale"], p["bias"])).alias("q"))


def dequantize(coded: DataFrame, planes: DataFrame) -> DataFrame:
    """(dataset, x, y, c): bytes as coefficients."""
    return _with_planes(coded, planes).select("dataset", "x", "y", F.zip_with("q", "_p", lambda v, p: dequantized(v, p["scale"], p["bias"])).alias("c"))


def merge_rtis(coded: DataFrame, planes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets of one kind on shared scales: (dataset, x, y, q) and (plane, scale, bias)."""
    from .aggregate import shared_ranges

    kinds = planes.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).select("n").distinct().limit(2).count()
    if kinds > 1:
        raise ValueError("datasets differ in their number of planes")
    shared = shared_ranges(planes)
    width = F.col("vmax") - F.col("vmin")
    shared = shared.select("plane", width.alias("scale"), (-F.col("vmin") / width).alias("bias"))
    both = planes.select("dataset", "plane", "scale", "bias").join(F.broadcast(shared.toDF("plane", "s", "b")), "plane")
    lists = both.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("plane", "scale", "bias", "s", "b"))).alias("_p"))
    again = lambda q, p: F.greatest(F.lit(0), F.least(F.round(255 * ((q / 255.0 - p["bias"]) * p["scale"] / p["s"] + p["b"]), 9).cast("int"), F.lit(255)))
    return coded.join(F.broadcast(lists), "dataset").select("dataset", "x", "y", F.zip_with("q", "_p", again).alias("q")), shared


def quantize_basis(basis: DataFrame) -> DataFrame:
    """Rows (dataset, plane, dim, value), plane 0 the mean, with their bytes ``q`` and the plane's range."""
    rng = basis.where("plane > 0").groupBy("dataset", "plane").agg((127 / F.max(F.abs("value"))).alias("range"))
    rows = basis.join(F.broadcast(rng), ["dataset", "plane"], "left")
    q = F.when(F.col("plane") == 0, F.round("value", 9)).otherwise(F.round(127 + F.col("range") * F.col("value"), 9)).cast("int")
    return rows.withColumn("q", q)


def legacy_to_planes(planes: DataFrame) -> DataFrame:
    """Rows (dataset, term, scale, bias) in the polynomial file order to internal planes, three channels each."""
    spark = planes.sparkSession
    order = spark.createDataFrame([(old, new) for new, old in enumerate(PTM_ORDER)], "term int, inner int")
    rows = planes.join(F.broadcast(order), "term").withColumn("channel", F.explode(F.array(*map(F.lit, range(3)))))
    return rows.select("dataset", (F.col("inner") * 3 + F.col("channel")).cast("int").alias("plane"), "scale", "bias")


def planes_to_legacy(planes: DataFrame) -> DataFrame:
    """Internal planes (common over channels) to file terms with biases as bytes."""
    spark = planes.sparkSession
    order = spark.createDataFrame([(old, new * 3) for new, old in enumerate(PTM_ORDER)], "term int, plane int")
    return planes.join(F.broadcast(order), "plane").select("dataset", "term", "scale", F.floor(255 * F.col("bias") + 0.5).cast("int").alias("bias"))
