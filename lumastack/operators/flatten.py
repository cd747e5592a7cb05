"""Removing low-frequency bending from normals and heights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import radial_bins, radial_line
from .grids import fft2, gaussian_blur

N = ("nx", "ny", "nz")


def _normalised(df: DataFrame) -> DataFrame:
    n = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return df.withColumns({c: F.col(c) / n for c in N})


def flatten_radial(normals: DataFrame, width: int, height: int, bin_size: float = 100.0) -> DataFrame:
    """Subtract the outward slope that a line over distance bins predicts."""
    line = radial_line(radial_bins(normals, width, height, bin_size), bin_size)
    x, y = F.col("x") - width / 2, height / 2 - F.col("y")
    d = F.sqrt(x * x + y * y)
    rows = normals.join(F.broadcast(line), "dataset").withColumn("_s", F.coalesce(F.col("m") * d + F.col("q"), F.lit(0.0)))
    rows = rows.withColumns({"nx": F.col("nx") - F.col("_s") * F.coalesce(F.try_divide(x, d), F.lit(0.0)), "ny": F.col("ny") - F.col("_s") * F.coalesce(F.try_divide(y, d), F.lit(0.0))})
    return _normalised(rows.drop("m", "q", "_s"))


def quadratic_fit(heights: DataFrame, width: int, height: int) -> DataFrame:
    """(dataset, k): the six coefficients of 1, x, y, xx, yy, xy over centred pixels, from moment sums."""
    u, v = (F.col("x") - width / 2) / width, (F.col("y") - height / 2) / width
    terms = [F.lit(1.0), u, v, u * u, v * v, u * v]
    sums = heights.groupBy("dataset").agg(*(F.sum(terms[i] * terms[j]).alias(f"a{i}{j}") for i in range(6) for j in range(i, 6)), *(F.sum(terms[i] * F.col("z")).alias(f"b{i}") for i in range(6)))
    out = []
    for r in sums.collect():  # a row a dataset
        a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
        out.append((r["dataset"], [float(c) for c in np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(6)]), rcond=None)[0]]))
    return heights.sparkSession.createDataFrame(out, "dataset string, k array<double>")


def flatten_quadratic(heights: DataFrame, width: int, height: int) -> DataFrame:
    """Heights less their quadratic fit."""
    u, v = (F.col("x") - width / 2) / width, (F.col("y") - height / 2) / width
    rows = heights.join(F.broadcast(quadratic_fit(heights, width, height)), "dataset")
    fit = sum((F.get("k", F.lit(i)) * t for i, t in enumerate([F.lit(1.0), u, v, u * u, v * v, u * v])), F.lit(0.0))
    return rows.withColumn("z", F.col("z") - fit).drop("k")


def flatten_blur(normals: DataFrame, sigma: float, compat: bool = False) -> DataFrame:
    """Slopes less their blur; ``compat`` subtracts the blurred slopes from the components instead."""
    slopes = normals.withColumns({"sx": F.col("nx") / F.col("nz"), "sy": F.col("ny") / F.col("nz")})
    low = gaussian_blur(slopes, ["sx", "sy"], sigma).withColumnsRenamed({"sx": "bx", "sy": "by"})
    rows = slopes.join(low, ["dataset", "x", "y"])
    of = (lambda n, s: F.col(n)) if compat else (lambda n, s: F.col(s))
    rows = rows.withColumns({"nx": of("nx", "sx") - F.col("bx"), "ny": of("ny", "sy") - F.col("by"), "nz": F.lit(1.0)})
    return _normalised(rows.drop("sx", "sy", "bx", "by"))


def mirrored(v: np.ndarray, part: float = 0.2) -> np.ndarray:
    """Lines lengthened on both sides by their mirror image."""
    n = v.shape[1]
    k = min(int(n * part), n - 1)
    return np.hstack([v[:, 1 : k + 1][:, ::-1], v, v[:, n - 1 - k : n - 1][:, ::-1]])


def flatten_fourier(normals: DataFrame, width: int, height: int, sigma: float, exponential: bool = True) -> DataFrame:
    """A Gaussian high-pass of n.x and n.y in frequency space, on a grid mirrored by a fifth; z follows from them.

    With ``exponential`` x and y are first stretched to angles and shrunk again afterwards.
    """
    t = F.acos(F.greatest(F.lit(-1.0), F.least(F.col("nz"), F.lit(1.0))))
    stretch = F.when(F.sin(t) > 1e-9, t / F.sin(t)).otherwise(1.0) if exponential else F.lit(1.0)
    rows = normals.select("dataset", "x", "y", (F.col("nx") * stretch).alias("ar"), F.lit(0.0).alias("ai"), (F.col("ny") * stretch).alias("br"), F.lit(0.0).alias("bi"))
    kx, ky = min(int(width * 0.2), width - 1), min(int(height * 0.2), height - 1)
    w, h = width + 2 * kx, height + 2 * ky

    def high_pass(z: np.ndarray, x: int) -> np.ndarray:
        fx = min(x, w - x)
        fy = np.minimum(np.arange(h), h - np.arange(h))
        return z * (1 - np.exp(-(fx * fx + fy * fy) / (2 * sigma * sigma)))

    spectrum = fft2(rows, [("ar", "ai"), ("br", "bi")], pad=lambda v, _: mirrored(v), finish=high_pass)
    back = fft2(spectrum, [("ar", "ai"), ("br", "bi")], inverse=True)
    inside = back.where((F.col("x") >= kx) & (F.col("x") < kx + width) & (F.col("y") >= ky) & (F.col("y") < ky + height))
    a = F.sqrt(F.col("ar") * F.col("ar") + F.col("br") * F.col("br"))
    shrink = F.when(a > 1e-9, F.sin(F.least(a, F.lit(math.pi / 2))) / a).otherwise(1.0) if exponential else F.lit(1.0)
    rows = inside.select("dataset", (F.col("x") - kx).cast("int").alias("x"), (F.col("y") - ky).cast("int").alias("y"), (F.col("ar") * shrink).alias("nx"), (F.col("br") * shrink).alias("ny"))
    return rows.withColumn("nz", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("nx") * F.col("nx") - F.col("ny") * F.col("ny"))))


def _slope_terms(n: int) -> list[tuple[int, int]]:
    """The exponents of a height model for n points, its constant aside: plane and quadric, quartic, with linear terms."""
    base = [(2, 0), (1, 1), (0, 2)]
    if n >= 7:
        base = [*base, (4, 0), (2, 2), (0, 4)]
    if n > 9:
        base = [*base, (1, 0), (0, 1)]
    return base


def point_model(points: list[tuple[float, ...]], width: int, height: int, heights: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(terms, coefficients) of picked points (x, y, nx, ny, nz) or (x, y, z), by least squares in centred coordinates / width."""
    p = np.array(points, float)
    terms = _slope_terms(len(p))
    u, v = (p[:, 0] - width / 2) / width, (height / 2 - p[:, 1]) / width
    if heights:
        a = np.column_stack([np.ones(len(p)), *(u**i * v**j for i, j in terms)])
        return terms, np.linalg.lstsq(a, p[:, 2], rcond=None)[0][1:]
    du = np.column_stack([i * u ** max(i - 1, 0) * v**j for i, j in terms])
    dv = np.column_stack([j * u**i * v ** max(j - 1, 0) for i, j in terms])
    return terms, np.linalg.lstsq(np.vstack([du, dv]), np.concatenate([-p[:, 2] / p[:, 4], -p[:, 3] / p[:, 4]]), rcond=None)[0]


def _at(width: int, height: int):
    return (F.col("x") - width / 2) / width, (height / 2 - F.col("y")) / width


def flatten_points_normals(normals: DataFrame, model: tuple[list[tuple[int, int]], np.ndarray], width: int, height: int) -> DataFrame:
    """Each normal turned by the rotation that takes the model's normal there to the viewing axis."""
    terms, k = model
    u, v = _at(width, height)
    power = lambda b, e: F.pow(b, F.lit(float(e))) if e else F.lit(1.0)
    du = sum((float(c) * i * power(u, i - 1) * power(v, j) for (i, j), c in zip(terms, k, strict=True) if i), F.lit(0.0))
    dv = sum((float(c) * j * power(u, i) * power(v, j - 1) for (i, j), c in zip(terms, k, strict=True) if j), F.lit(0.0))
    n = F.sqrt(du * du + dv * dv + 1)
    rows = normals.withColumns({"_a": -du / n, "_b": -dv / n, "_c": 1 / n})
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    x, y, z = F.col("nx"), F.col("ny"), F.col("nz")
    k1 = 1 / (1 + c)
    to = {"nx": x * (1 - a * a * k1) - y * a * b * k1 - z * a, "ny": -x * a * b * k1 + y * (1 - b * b * k1) - z * b, "nz": x * a + y * b + z * c}
    return rows.withColumns(to).drop("_a", "_b", "_c")


def flatten_points_heights(heights: DataFrame, model: tuple[list[tuple[int, int]], np.ndarray], width: int, height: int) -> DataFrame:
    """Heights less the model, with mean 0."""
    terms, k = model
    u, v = _at(width, height)
    power = lambda b, e: F.pow(b, F.lit(float(e))) if e else F.lit(1.0)
    rows = heights.withColumn("z", F.col("z") - sum((float(c) * power(u, i) * power(v, j) for (i, j), c in zip(terms, k, strict=True)), F.lit(0.0)))
    mean = rows.groupBy("dataset").agg(F.avg("z").alias("_m"))
    return rows.join(F.broadcast(mean), "dataset").withColumn("z", F.col("z") - F.col("_m")).drop("_m")
