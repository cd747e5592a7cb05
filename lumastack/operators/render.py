"""Re-illumination, quality, and what viewers derive."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import listed, sorted_eigh, stacked
from ..functions.color import ycbcr_to_rgb, ycc_to_rgb
from .blocks import shifted, stencil

CHANNELS = ("r", "g", "b")


def _byte(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.round(v, 9).cast("int"), F.lit(255)))


def light_rows(spark, weights: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """(light_id, w, m) of a few requested lights: term weights, and for PCA the mean's values."""
    rows = [(i, [float(v) for v in w], [float(v) for v in mean[i]] if mean is not None else None) for i, w in enumerate(weights)]
    return spark.createDataFrame(rows, "light_id int, w array<double>, m array<double>")


def illuminate(coeff: DataFrame, lights: DataFrame, colorspace: str = "rgb", k: int | None = None, base: int = 0) -> DataFrame:
    """(dataset, light_id, x, y, r, g, b) of coefficients (dataset, x, y, c) under every light of ``light_rows``.

    rgb: c holds r, g, b of each term; w is a weight a term. lrgb: c is the base colour and luma terms. ycc: luma terms, then
    Cb and Cr. mrgb: c holds PCA coefficients, w the basis values of the light, plane after plane with r, g, b each, m the
    mean; ``k`` planes are used. mycc: as mrgb in luma and differences, w a value for each plane in file order, ``base`` triples.
    The lights are few; pixels are not moved.
    """
    rows = coeff.crossJoin(F.broadcast(lights))
    total = lambda c, w: F.aggregate(F.zip_with(c, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    third = lambda a, i: F.filter(a, lambda _, j: j % 3 == i)
    if colorspace == "rgb":
        rgb = [total(third("c", i), "w") for i in range(3)]
    elif colorspace == "lrgb":
        luma = total(F.slice("c", F.lit(4), F.size("c") - 3), "w")
        rgb = [luma * F.get("c", F.lit(i)) / 255 for i in range(3)]
    elif colorspace == "ycc":
        n = F.size("c") - 2
        y = total(F.slice("c", F.lit(1), n), "w")
        rgb = [255 * v for v in ycbcr_to_rgb(y, F.get("c", n), F.get("c", n + 1))]
    elif colorspace == "mrgb":
        c = F.slice("c", F.lit(1), F.lit(k)) if k else F.col("c")
        rgb = [F.get("m", F.lit(i)) + total(c, F.slice(third("w", i), F.lit(1), F.size(c))) for i in range(3)]
    else:
        at = lambda i: total(F.filter("c", lambda _, j: F.when(j < 3 * base, j % 3 == i).otherwise(F.lit(i == 0))), F.filter("w", lambda _, j: F.when(j < 3 * base, j % 3 == i).otherwise(F.lit(i == 0))))
        rgb = ycc_to_rgb(*(F.get("m", F.lit(i)) + at(i) for i in range(3)))
    return rows.select("dataset", "light_id", "x", "y", *(_byte(v).alias(c) for v, c in zip(rgb, CHANNELS, strict=True)))


def _squares(samples: DataFrame, rendered: DataFrame) -> DataFrame:
    keys = ["dataset", "light_id", "x", "y"]
    r = rendered.select(*keys, *(F.col(c).alias("_" + c) for c in CHANNELS))
    d = sum(((F.col(c) - F.col("_" + c)) * (F.col(c) - F.col("_" + c)) for c in CHANNELS), F.lit(0.0))
    return samples.join(r, keys).select(*keys, d.alias("d2"))


def _psnr(mse: Column) -> Column:
    return F.when(mse > 0, 20 * F.log10(F.lit(255.0)) - 10 * F.log10(mse))


def reconstruction_error(samples: DataFrame, rendered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per light (dataset, light_id, mse, psnr, rmse) and overall (the mean over lights)."""
    light = _squares(samples, rendered).groupBy("dataset", "light_id").agg((F.avg("d2") / 3).alias("mse"))
    whole = light.groupBy("dataset").agg(F.avg("mse").alias("mse"))
    done = lambda df: df.withColumns({"psnr": _psnr(F.col("mse")), "rmse": F.sqrt("mse")})
    return done(light), done(whole)


def error_map(samples: DataFrame, rendered: DataFrame) -> DataFrame:
    """(dataset, x, y, error): the root mean square over the lights used and channels."""
    return _squares(samples, rendered).groupBy("dataset", "x", "y").agg(F.sqrt(F.sum("d2") / (3 * F.count(F.lit(1)))).alias("error"))


def _mapped_errors(rows: DataFrame, columns: list[str], errors_of: Callable[..., np.ndarray]) -> DataFrame:
    """(dataset, x, y, d2) by one map over the rows: a column function would be evaluated anew by every filter that Spark infers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d2 = listed(errors_of(*(stacked(batch.column(c)) for c in columns)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dataset", "x", "y")), d2], ["dataset", "x", "y", "d2"])

    kept = rows.select("dataset", "x", "y", *columns)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(task, ", ".join([*(f"{c} {kinds[c]}" for c in ("dataset", "x", "y")), "d2 array<double>"]))


def pixel_errors(rows: DataFrame, weights: np.ndarray, lights: list[int] | None = None, *, fit: np.ndarray | None = None) -> DataFrame:
    """(dataset, x, y, d2): squared errors of rgb renderings under each light, summed over the channels, inside the pixel's row.

    ``rows`` hold a pixel's values and its coefficients (x, y, r, g, b, c), ``weights`` the terms of each of ``lights``, which
    are the places of the values compared; nothing is joined or shuffled. With ``fit`` the coefficients are the values of
    r, g and b end to end times it, made on the way.
    """
    places = list(range(len(weights))) if lights is None else lights

    def errors(*v: np.ndarray) -> np.ndarray:
        c = np.hstack(v) @ fit if fit is not None else v[3]
        seen = np.stack([u[:, places] for u in v[:3]], axis=2)
        drawn = weights @ c.reshape(len(c), -1, 3)
        d = seen - np.clip(np.trunc(np.round(drawn, 9)), 0, 255)
        return (d * d).sum(axis=2)

    return _mapped_errors(rows, [*CHANNELS, *(["c"] if fit is None else [])], errors)


def light_errors(errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``reconstruction_error``, of the rows of ``pixel_errors``: only sums for each light are shuffled."""
    light = errors.select("dataset", F.posexplode("d2").alias("light_id", "d2")).groupBy("dataset", "light_id").agg((F.avg("d2") / 3).alias("mse"))
    whole = light.groupBy("dataset").agg(F.avg("mse").alias("mse"))
    done = lambda df: df.withColumns({"psnr": _psnr(F.col("mse")), "rmse": F.sqrt("mse")})
    return done(light), done(whole)


def pixel_error_map(errors: DataFrame) -> DataFrame:
    """As ``error_map``, of the rows of ``pixel_errors``; no shuffle."""
    return errors.select("dataset", "x", "y", F.sqrt(F.aggregate("d2", F.lit(0.0), lambda s, v: s + v) / (3 * F.size("d2"))).alias("error"))


def error_ramp(errors: DataFrame, low: float, high: float) -> DataFrame:
    """(dataset, x, y, r, g, b): errors from ``low`` to ``high`` in colours from blue over green to red."""
    t = F.floor(255 * F.greatest(F.lit(0.0), F.least((F.col("error") - low) / (high - low), F.lit(1.0)))).cast("int")
    cold, zero = t < 128, F.lit(0)
    rgb = {"r": F.when(cold, zero).otherwise(2 * t - 256), "g": F.when(cold, 2 * t).otherwise(511 - 2 * t), "b": F.when(cold, 255 - 2 * t).otherwise(zero)}
    return errors.select("dataset", "x", "y", *(v.cast("int").alias(c) for c, v in rgb.items()))


def leave_one_out(pixels: DataFrame, lights: np.ndarray, basis: str, n: int, k: int) -> DataFrame:
    """Fit without light ``k``, render it, and report: (dataset, type, colorspace, nplanes, k, elevation, lx, ly, mse, psnr, rmse)."""
    from .fit import pinv, weights_of

    rest = [i for i in range(len(lights)) if i != k]
    full = np.zeros((3 * len(lights), 3 * n))
    for c in range(3):  # the fit on the other lights, with no weight on light k
        full[np.ix_([c * len(lights) + i for i in rest], range(c, 3 * n, 3))] = pinv(weights_of(lights[rest], basis, n)).T
    whole = light_errors(pixel_errors(pixels, weights_of(lights[[k]], basis, n), [k], fit=full))[1]
    x, y = float(lights[k, 0]), float(lights[k, 1])
    told = {"type": F.lit(basis), "colorspace": F.lit("rgb"), "nplanes": F.lit(3 * n), "k": F.lit(k), "elevation": F.lit(math.asin(min(1.0, math.hypot(x, y)))), "lx": F.lit(x), "ly": F.lit(y)}
    return whole.withColumns(told)


def left_out(weights: np.ndarray) -> np.ndarray:
    """Lights x lights: what the fit on all other lights predicts for each, from the whole fit's projection.

    With H the projection and h its diagonal, light k is predicted by (H y - h y) / (1 - h). Where h is 1 nothing but the
    light itself holds a term; there the fit without it is solved.
    """
    whole = weights @ np.linalg.pinv(weights)
    out = np.zeros(whole.shape)
    for k, h in enumerate(np.diag(whole)):
        if h < 1 - 1e-9:
            out[k] = whole[k] / (1 - h)
        else:
            rest = np.arange(len(weights)) != k
            out[k, rest] = weights[k] @ np.linalg.pinv(weights[rest])
        out[k, k] = 0
    return out


def leave_each_out(pixels: DataFrame, lights: np.ndarray, basis: str, n: int) -> DataFrame:
    """``leave_one_out`` of every light k at once: one pass over the pixels, and sums for each light."""
    from .fit import weights_of

    every = left_out(weights_of(lights, basis, n))

    def errors(*v: np.ndarray) -> np.ndarray:
        seen = np.stack(v, axis=2)
        d = seen - np.clip(np.trunc(np.round(every @ seen, 9)), 0, 255)
        return (d * d).sum(axis=2)

    rows = light_errors(_mapped_errors(pixels, list(CHANNELS), errors))[0].withColumnRenamed("light_id", "k")
    facts = [(k, math.asin(min(1.0, math.hypot(x, y))), float(x), float(y)) for k, (x, y, _) in enumerate(lights.tolist())]
    told = pixels.sparkSession.createDataFrame(facts, "k int, elevation double, lx double, ly double")
    return rows.join(F.broadcast(told), "k").select("dataset", F.lit(basis).alias("type"), F.lit("rgb").alias("colorspace"), F.lit(3 * n).alias("nplanes"), "k", "elevation", "lx", "ly", "mse", "psnr", "rmse")


# Three lights 45 degrees up, at 30, 150 and 270 degrees.
THREE = np.array([[math.cos(math.radians(a)) * math.sqrt(0.5), math.sin(math.radians(a)) * math.sqrt(0.5), math.sqrt(0.5)] for a in (30, 150, 270)])


def normals_from_coefficients(coeff: DataFrame, weights: np.ndarray) -> DataFrame:
    """Normals of rgb coefficients by rendering three fixed lights (3 x terms ``weights``): (dataset, x, y, nx, ny, nz)."""
    inverse = np.linalg.inv(THREE)
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 3).cast("int") - 1), lambda p: F.get("c", 3 * p) + F.get("c", 3 * p + 1) + F.get("c", 3 * p + 2))
    rows = coeff.select("dataset", "x", "y", sums.alias("s"))
    shade = [F.aggregate(F.zip_with("s", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for w in weights]
    rows = rows.select("dataset", "x", "y", *(v.alias(f"i{i}") for i, v in enumerate(shade)))
    n = [sum((float(inverse[a, i]) * F.col(f"i{i}") for i in range(3)), F.lit(0.0)) for a in range(3)]
    size = F.nullif(F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]), F.lit(0.0))
    return rows.select("dataset", "x", "y", *(F.coalesce(F.try_divide(v, size), F.lit(d)).alias(k) for v, k, d in zip(n, ("nx", "ny", "nz"), (0.0, 0.0, 1.0), strict=True)))


def hillshade(heights: DataFrame, width: int, height: int, light: tuple[float, float, float], cell: float = 1.0) -> DataFrame:
    """(dataset, x, y, shade): Horn slopes of a height grid against a light; neighbours are clamped at the borders."""

    def kernel(values: dict[str, np.ndarray], known: np.ndarray) -> dict[str, np.ndarray]:
        z = np.where(known, values["z"], 0.0)  # a neighbour that is missing adds nothing
        at = lambda dx, dy: shifted(z, 1, dx, dy)
        gx = (at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)) / (8 * cell)
        gy = (at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)) / (8 * cell)
        return {"shade": (-gx * light[0] - gy * light[1] + light[2]) / np.sqrt(gx * gx + gy * gy + 1)}

    return stencil(heights, ["z"], width, height, 1, kernel, "shade double")


def dstretch_matrix(raster: DataFrame, width: int, height: int, min_samples: int) -> np.ndarray:
    """The decorrelating 3 x 3 transform of one dataset's strided samples."""
    across = math.ceil(math.sqrt(min_samples) * width / height)
    down = math.ceil(math.sqrt(min_samples) * height / width)
    sx, sy = max(1, width // across), max(1, height // down)
    names = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i:]]
    got = raster.where((F.col("x") % sx == 0) & (F.col("y") % sy == 0)).agg(*(F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(a + b) for a, b in names)).first()
    cov = np.array([[got["".join(sorted((a, b), key=CHANNELS.index))] or 0.0 for b in CHANNELS] for a in CHANNELS])
    values, vectors = sorted_eigh(cov)
    return np.diag(np.sqrt(np.diag(cov))) @ vectors @ np.diag(1 / np.sqrt(np.maximum(np.abs(values), 1e-300))) @ vectors.T


def dstretch(raster: DataFrame, width: int, height: int, min_samples: int = 1000) -> DataFrame:
    """Decorrelation stretch of one dataset: transformed, truncated, and each channel rescaled to 0..255."""
    t = dstretch_matrix(raster, width, height, min_samples)
    to = {c: F.round(sum((float(t[i, j]) * F.col(d) for j, d in enumerate(CHANNELS)), F.lit(0.0)), 9).cast("int") for i, c in enumerate(CHANNELS)}
    rows = raster.select("dataset", "x", "y", *(v.alias(c) for c, v in to.items()))
    ends = rows.groupBy("dataset").agg(*(F.min(c).alias("lo" + c) for c in CHANNELS), *(F.max(c).alias("hi" + c) for c in CHANNELS))
    rows = rows.join(F.broadcast(ends), "dataset")
    scaled = lambda c: F.coalesce(F.try_divide(255.0 * (F.col(c) - F.col("lo" + c)), F.col("hi" + c) - F.col("lo" + c)), F.lit(0.0))
    return rows.select("dataset", "x", "y", *(F.round(scaled(c), 9).cast("int").alias(c) for c in CHANNELS))


