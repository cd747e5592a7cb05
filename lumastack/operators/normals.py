"""Surface normals by closed forms and their checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SIZE, Axis, Block, bilinear, blockwise
from .prepare import relative_light
from .stack import attach_lights

N = ("nx", "ny", "nz")


def _unit(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    n = F.nullif(F.sqrt(x * x + y * y + z * z), F.lit(0.0))
    return F.try_divide(x, n), F.try_divide(y, n), F.try_divide(z, n)


def _solved(rows: DataFrame) -> DataFrame:
    """Normals of samples with a light (lx, ly, lz) and a gray value: nine moment sums a pixel, then a 3 x 3 solve."""
    c = F.col
    sums = {a + b: F.sum(c(a) * c(b)) for i, a in enumerate(("lx", "ly", "lz")) for b in ("lx", "ly", "lz")[i:]}
    sums |= {"b" + a: F.sum(c("gray") * c(a)) for a in ("lx", "ly", "lz")}
    m = rows.groupBy("dataset", "x", "y").agg(*(v.alias(k) for k, v in sums.items()))
    xx, xy, xz, yy, yz, zz = (c(k) for k in ("lxlx", "lxly", "lxlz", "lyly", "lylz", "lzlz"))
    bx, by, bz = c("blx"), c("bly"), c("blz")
    a, b, d = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    e, f, g = xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy
    det = xx * a + xy * b + xz * d
    sign = F.when(F.abs(det) < 1e-12, F.lit(None)).otherwise(F.signum(det))
    nx, ny, nz = _unit(sign * (a * bx + b * by + d * bz), sign * (b * bx + e * by + f * bz), sign * (d * bx + f * by + g * bz))
    return m.select("dataset", "x", "y", nx.alias("nx"), ny.alias("ny"), nz.alias("nz"))


def normals_l2(samples: DataFrame, lights: DataFrame) -> DataFrame:
    """Lambertian least squares straight from samples; a pixel without three independent lights has a null normal."""
    return _solved(attach_lights(samples, lights).withColumn("gray", (F.col("r") + F.col("g") + F.col("b")) / 3))


def normals_l2_positional(samples: DataFrame, lights: DataFrame, **geometry) -> DataFrame:
    """As ``normals_l2`` with lights at positions: each sample's light is the unit vector from its pixel."""
    rows = relative_light(samples, lights, **geometry)
    lx, ly, lz = _unit(F.col("rx"), F.col("ry"), F.col("rz"))
    return _solved(rows.withColumns({"lx": lx, "ly": ly, "lz": lz, "gray": (F.col("r") + F.col("g") + F.col("b")) / 3}))


def normals_weighted(samples: DataFrame, lights: DataFrame) -> DataFrame:
    """The mean light direction weighted by brightness, as 8-bit vectors."""
    rows = attach_lights(samples, lights)
    w = F.col("r") + F.col("g") + F.col("b")
    m = rows.groupBy("dataset", "x", "y").agg(*(F.sum(w * F.col(a)).alias(a) for a in ("lx", "ly", "lz")))
    unit = _unit(F.col("lx"), F.col("ly"), F.col("lz"))
    return m.select("dataset", "x", "y", *(F.floor(F.round(255 * (u + 1) / 2, 9)).cast("int").alias(c) for u, c in zip(unit, ("r", "g", "b"), strict=True)))


def fix_normals(normals: DataFrame, least: float = 0.001) -> DataFrame:
    """NaN or null x, y become 0; a z that is NaN, null or below ``least`` becomes it; only repaired rows are normalised."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    x, y = (F.when(bad(c), 0.0).otherwise(F.col(c)) for c in ("nx", "ny"))
    low = bad("nz") | (F.col("nz") < least)
    z = F.when(low, least).otherwise(F.col("nz"))
    rows = normals.withColumns({"_fix": bad("nx") | bad("ny") | low, "nx": x, "ny": y, "nz": z})
    unit = _unit(F.col("nx"), F.col("ny"), F.col("nz"))
    return rows.withColumns({c: F.when(F.col("_fix"), u).otherwise(F.col(c)) for c, u in zip(N, unit, strict=True)}).drop("_fix")


def encode_normals(normals: DataFrame, bits: int | None = 8) -> DataFrame:
    """Normals as r, g, b: 8 bits rounded, 16 bits truncated, or with ``bits=None`` in [0, 1]."""

    def of(c: str) -> Column:
        v = (F.col(c) + 1) / 2
        if bits is None:
            return v
        if bits == 16:
            return F.round(v * 65535, 9).cast("int")
        return F.greatest(F.lit(0), F.least(F.round(F.round(v * 255, 9)), F.lit(255))).cast("int")

    return normals.select("dataset", "x", "y", *(of(c).alias(k) for c, k in zip(N, ("r", "g", "b"), strict=True)))


def decode_normals(df: DataFrame, bits: int | None = 8) -> DataFrame:
    top = {8: 255.0, 16: 65535.0, None: 1.0}[bits]
    return df.select("dataset", "x", "y", *((F.col(k) / top * 2 - 1).alias(c) for c, k in zip(N, ("r", "g", "b"), strict=True)))


def angular_error(found: DataFrame, truth: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(dataset, x, y, degrees) between two fields; 0 outside the mask."""
    t = truth.select("dataset", "x", "y", *(F.col(c).alias("t" + c) for c in N))
    rows = found.join(t, ["dataset", "x", "y"])
    dot = sum((F.col(c) * F.col("t" + c) for c in N[1:]), F.col("nx") * F.col("tnx"))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(dot, F.lit(1.0)))))
    if mask is not None:
        rows = rows.join(mask.select("dataset", "x", "y", "mask"), ["dataset", "x", "y"], "left")
        angle = F.when(F.coalesce(F.col("mask"), F.lit(0)) != 0, angle).otherwise(0.0)
    return rows.select("dataset", "x", "y", angle.alias("degrees"))


def resize_grid(df: DataFrame, values: list[str], old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """A grid resampled bilinearly, corner on corner; a block of it is made of the sources that it covers."""
    rx, ry = (old[0] - 1) / max(new[0] - 1, 1), (old[1] - 1) / max(new[1] - 1, 1)

    def axis(n: int, m: int, r: float) -> Axis:
        used, first = np.zeros(m, bool), np.floor(np.arange(n) * r).astype(int)
        used[np.minimum(first, m - 1)] = used[np.minimum(first + 1, m - 1)] = True
        return Axis.reading(n, max(1, min(SIZE, int(SIZE / max(r, 1e-9)))), m, lambda a, b: (np.floor(a * r), np.floor(b * r) + 1), used)

    def kernel(block: Block) -> dict[str, object] | None:
        y, x = np.mgrid[block.y0 : block.y0 + block.h, block.x0 : block.x0 + block.w]
        got, hit = bilinear(block, x * rx, y * ry, *old, values)
        return block.pixels(got, hit)

    rows = df.select("dataset", "x", "y", *(F.col(v).cast("double").alias(v) for v in values))
    return blockwise(rows, values, axis(new[0], old[0], rx), axis(new[1], old[1], ry), kernel, "x int, y int, " + ", ".join(f"`{v}` double" for v in values))


def resize_normals(normals: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """A normal field resampled and repaired."""
    return fix_normals(resize_grid(normals, list(N), old, new))
