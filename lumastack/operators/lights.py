"""Light directions and positions from mirror spheres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import gray

THRESHOLDS = list(range(240, 100, -10))  # tried in this order


def fit_ellipse(border: DataFrame) -> DataFrame:
    """(dataset, sphere_id, n, cx, cy, major, minor, angle) of border points by the direct least-squares conic.

    Fewer than five points or a conic that is no ellipse give nulls, and callers fall back to the circle. Fifteen sums a
    sphere reach the small eigenproblem; border points never do.
    """
    x0, y0 = F.avg("x"), F.avg("y")
    mean = border.groupBy("dataset", "sphere_id").agg(x0.alias("x0"), y0.alias("y0"))
    rows = border.join(F.broadcast(mean), ["dataset", "sphere_id"])
    x, y = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    powers = [(i, j) for i in range(5) for j in range(5 - i)]
    sums = [F.sum(F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j)))).alias(f"s{i}{j}") for i, j in powers]
    moments = rows.groupBy("dataset", "sphere_id", "x0", "y0").agg(*sums)

    @F.pandas_udf("cx double, cy double, major double, minor double, angle double")
    def solve(m: pd.DataFrame) -> pd.DataFrame:
        out = [_conic({k: float(v) for k, v in row.items()}) for row in m.to_dict("records")]
        return pd.DataFrame(out, columns=["cx", "cy", "major", "minor", "angle"])

    got = moments.withColumn("e", solve(F.struct(*(f"s{i}{j}" for i, j in powers))))
    return got.select("dataset", "sphere_id", F.col("s00").cast("long").alias("n"), (F.col("e.cx") + F.col("x0")).alias("cx"), (F.col("e.cy") + F.col("y0")).alias("cy"), "e.major", "e.minor", "e.angle")


def _conic(s: dict[str, float]) -> tuple:
    none = (None,) * 5
    if s["s00"] < 5:
        return none
    g = lambda i, j: s[f"s{i}{j}"]
    quad = np.array([[g(4, 0), g(3, 1), g(2, 2)], [g(3, 1), g(2, 2), g(1, 3)], [g(2, 2), g(1, 3), g(0, 4)]])
    mixed = np.array([[g(3, 0), g(2, 1), g(2, 0)], [g(2, 1), g(1, 2), g(1, 1)], [g(1, 2), g(0, 3), g(0, 2)]])
    line = np.array([[g(2, 0), g(1, 1), g(1, 0)], [g(1, 1), g(0, 2), g(0, 1)], [g(1, 0), g(0, 1), g(0, 0)]])
    try:
        t = -np.linalg.solve(line, mixed.T)
        m = np.linalg.solve(np.array([[0, 0, 2.0], [0, -1.0, 0], [2.0, 0, 0]]), quad + mixed @ t)
        values, vectors = np.linalg.eig(m)
    except np.linalg.LinAlgError:
        return none
    vectors = vectors.real
    good = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 0)
    if not len(good):
        return none
    a, b, c = vectors[:, good[0]]
    d, e, f = t @ np.array([a, b, c])
    det = 4 * a * c - b * b
    cx, cy = (b * e - 2 * c * d) / det, (b * d - 2 * a * e) / det
    k = -(a * cx * cx + b * cx * cy + c * cy * cy + d * cx + e * cy + f)
    if k < 0:
        a, b, c, k = -a, -b, -c, -k
    eigen, axes = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]))
    if eigen[0] <= 0 or k <= 0:
        return none
    angle = math.degrees(math.atan2(axes[1, 0], axes[0, 0])) % 180
    return cx, cy, math.sqrt(k / eigen[0]), math.sqrt(k / eigen[1]), angle


def inner_rect(spheres: DataFrame) -> DataFrame:
    """The disc in which highlights are searched, radius * sin(50 degrees), and its integer bounding box."""
    r = F.col("radius") * math.sin(math.radians(50))
    box = {"left": F.floor(F.col("cx") - r), "top": F.floor(F.col("cy") - r), "right": F.ceil(F.col("cx") + r), "bottom": F.ceil(F.col("cy") + r)}
    return spheres.withColumns({"inner": r, **{k: v.cast("int") for k, v in box.items()}})


def disc_grays(samples: DataFrame, spheres: DataFrame) -> DataFrame:
    """(dataset, sphere_id, light_id, x, y, v): integer grays inside each sphere's search disc. Spheres are few."""
    discs = inner_rect(spheres).select("dataset", "sphere_id", "cx", "cy", "inner", "left", "top", "right", "bottom")
    rows = samples.join(F.broadcast(discs), "dataset")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    box = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    rows = rows.where(box & (dx * dx + dy * dy <= F.col("inner") * F.col("inner")))
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    return rows.select("dataset", "sphere_id", "light_id", "x", "y", gray(F.col("r"), F.col("g"), F.col("b"), "integer").alias("v"), area.alias("area"))


def detect_highlights(samples: DataFrame, spheres: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(dataset, sphere_id, light_id, hx, hy, threshold): the barycentre of the brightest spot of each sphere and image.

    The first of the thresholds 240, 230, ..., 110 that at least area / 200 pixels reach counts, else the lowest that any
    pixel reaches; with no gray of 127 or more the sphere is in shadow and the highlight (0, 0), as for skipped images.
    """
    grays = disc_grays(samples, spheres)
    level = F.greatest(F.lit(0), F.least(F.floor((F.col("v") - 110) / 10), F.lit(13))).cast("int")
    keys = ["dataset", "sphere_id", "light_id"]
    top = grays.groupBy(*keys).agg(F.max("v").alias("peak"), F.max("area").alias("area"))
    counted = grays.where("v >= 110").groupBy(*keys, level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    w = Window.partitionBy(*keys).orderBy(F.desc("level"))
    counted = counted.withColumns({k: F.sum(k).over(w) for k in ("n", "sx", "sy")}).join(top, keys)
    full = F.max(F.when(F.col("n") >= F.col("area") / 200, F.struct("level", "n", "sx", "sy")))
    best = counted.groupBy(*keys).agg(F.coalesce(full, F.min(F.struct("level", "n", "sx", "sy"))).alias("s"))
    rows = top.join(best, keys, "left")
    lit = (F.col("peak") >= 127) & F.col("s").isNotNull()
    if skipped is not None:
        rows = rows.join(F.broadcast(skipped.select("dataset", "light_id", F.lit(True).alias("gone"))), ["dataset", "light_id"], "left")
        lit = lit & F.col("gone").isNull()
    at = lambda k: F.when(lit, F.col(f"s.{k}") / F.col("s.n")).otherwise(0.0)
    return rows.select(*keys, at("sx").alias("hx"), at("sy").alias("hy"), F.when(lit, 110 + 10 * F.col("s.level")).otherwise(0).alias("threshold"))


def refine_highlights(samples: DataFrame, spheres: DataFrame, found: DataFrame, rounds: int = 6) -> DataFrame:
    """Highlights moved to gray-weighted barycentres in windows that halve down to 2% of the box; unlit ones stay."""
    keys = ["dataset", "sphere_id", "light_id"]
    width = inner_rect(spheres).select("dataset", "sphere_id", (F.col("right") - F.col("left")).alias("w"))
    start = found.join(F.broadcast(width), ["dataset", "sphere_id"])
    lit = disc_grays(samples, spheres).join(start.where("threshold > 0"), keys).where("v >= threshold").select(*keys, "x", "y", "v", "hx", "hy", "w", "threshold")

    def refine(p: pd.DataFrame) -> pd.DataFrame:  # the bright pixels of one sphere's disc
        hx, hy, w = float(p["hx"].iloc[0]), float(p["hy"].iloc[0]), float(p["w"].iloc[0])
        radius, least = math.ceil(w / 2), math.ceil(0.02 * w)
        x, y, v = (p[c].to_numpy(float) for c in ("x", "y", "v"))
        for _ in range(rounds):
            near = (np.abs(x - hx) <= radius) & (np.abs(y - hy) <= radius)
            if v[near].sum() == 0:
                break
            hx, hy = np.average(x[near], weights=v[near]), np.average(y[near], weights=v[near])
            if radius <= least:
                break
            radius = math.ceil(radius / 2)
        return p[[*keys, "threshold"]].iloc[:1].assign(hx=hx, hy=hy)[[*keys, "hx", "hy", "threshold"]]

    done = lit.groupBy(*keys).applyInPandas(refine, "dataset string, sphere_id int, light_id int, hx double, hy double, threshold int")
    return done.unionByName(found.where("threshold = 0").select(*keys, "hx", "hy", "threshold"))


def highlight_directions(highlights: DataFrame, spheres: DataFrame, *, width: int, height: int, focal_px: float = 0.0) -> DataFrame:
    """Light directions (lx, ly, lz), y up, mirrored at the sphere's surface, and the surface point (sx, sy, sz) in radii.

    Without a focal length the view is orthographic. With one, the sphere is the one whose outline is seen from the camera,
    and the nearest meeting of the pixel's ray with it is the mirror point. Missing highlights and those outside give zeros.
    """
    rows = highlights.join(F.broadcast(spheres.select("dataset", "sphere_id", "cx", "cy", "radius")), ["dataset", "sphere_id"])
    hx, hy = F.col("hx"), F.col("hy")
    if focal_px:
        f = F.lit(float(focal_px))
        px, py = F.col("cx") - width / 2, height / 2 - F.col("cy")
        d = F.sqrt(px * px + py * py)
        # the outline's ends along the radial line give the cone around the sphere, whose centre lies on the bisector
        a1, a2 = F.atan2(d - F.col("radius"), f), F.atan2(d + F.col("radius"), f)
        mid, half = (a1 + a2) / 2, (a2 - a1) / 2
        ux, uy = F.when(d > 0, px / d).otherwise(1.0), F.when(d > 0, py / d).otherwise(0.0)
        cx, cy, cz = F.sin(mid) * ux, F.sin(mid) * uy, -F.cos(mid)  # the centre at distance 1, the camera at the origin
        radius = F.sin(half)
        rx, ry, rz = hx - width / 2, height / 2 - hy, -f
        n = F.sqrt(rx * rx + ry * ry + rz * rz)
        rx, ry, rz = rx / n, ry / n, rz / n
        b = rx * cx + ry * cy + rz * cz
        disc = b * b - (1 - radius * radius)
        t = b - F.sqrt(F.greatest(disc, F.lit(0.0)))
        nx, ny, nz = (t * rx - cx) / radius, (t * ry - cy) / radius, (t * rz - cz) / radius
        inside, vx, vy, vz = disc >= 0, -rx, -ry, -rz
    else:
        nx, ny = (hx - F.col("cx")) / F.col("radius"), (F.col("cy") - hy) / F.col("radius")
        rest = 1 - nx * nx - ny * ny
        nz, inside = F.sqrt(F.greatest(rest, F.lit(0.0))), rest >= 0
        vx, vy, vz = F.lit(0.0), F.lit(0.0), F.lit(1.0)
    good = inside & ((hx != 0) | (hy != 0))
    k = 2 * (nx * vx + ny * vy + nz * vz)
    of = lambda v: F.when(good, v).otherwise(0.0)
    return rows.select("dataset", "sphere_id", "light_id", of(k * nx - vx).alias("lx"), of(k * ny - vy).alias("ly"), of(k * nz - vz).alias("lz"), of(nx).alias("sx"), of(ny).alias("sy"), of(nz).alias("sz"))


def combine_directions(directions: DataFrame) -> DataFrame:
    from .aggregate import average_directions

    return average_directions(directions)


def _there() -> Column:
    return (F.col("lx") != 0) | (F.col("ly") != 0) | (F.col("lz") != 0)


def sphere_positions(lights: DataFrame, diameter: float, offset: float) -> DataFrame:
    """Positions on a spherical dome; zero directions stay zero."""
    z = F.col("lz") * diameter / 2 + offset
    return lights.withColumns({"px": F.col("lx") * diameter / 2, "py": F.col("ly") * diameter / 2, "pz": F.when(_there(), z).otherwise(0.0)})


def dome_intersections(rays: DataFrame, diameter: float, offset: float) -> DataFrame:
    """Per light the mean over spheres of where rays (ox, oy, oz; lx, ly, lz) meet the dome."""
    r = diameter / 2
    ox, oy, oz = F.col("ox"), F.col("oy"), F.col("oz") - offset
    b = ox * F.col("lx") + oy * F.col("ly") + oz * F.col("lz")
    t = -b + F.sqrt(F.greatest(b * b - (ox * ox + oy * oy + oz * oz - r * r), F.lit(0.0)))
    rows = rays.where(_there()).withColumns({"px": ox + t * F.col("lx"), "py": oy + t * F.col("ly"), "pz": F.col("oz") + t * F.col("lz")})
    return rows.groupBy("dataset", "light_id").agg(*(F.avg(c).alias(c) for c in ("px", "py", "pz")))


def parallax_positions(rays: DataFrame, pixel: float = 1.0) -> DataFrame:
    """Per light the point nearest to its spheres' rays, in mm.

    Radii more than a tenth off the median radius (element n / 2) are scaled to it, and points below the plane are flipped.
    """
    u = [F.col(c) for c in ("lx", "ly", "lz")]
    o = [F.col(c) for c in ("ox", "oy", "oz")]
    proj = [[(1.0 if i == j else 0.0) - u[i] * u[j] for j in range(3)] for i in range(3)]
    aggs = {f"a{i}{j}": F.sum(proj[i][j]) for i in range(3) for j in range(i, 3)} | {f"b{i}": F.sum(proj[i][0] * o[0] + proj[i][1] * o[1] + proj[i][2] * o[2]) for i in range(3)}
    s = rays.where(_there()).groupBy("dataset", "light_id").agg(*(v.alias(k) for k, v in aggs.items()))
    c = lambda i, j: F.col(f"a{min(i, j)}{max(i, j)}") + (1e-9 if i == j else 0.0)
    b = [F.col(f"b{i}") for i in range(3)]
    det3 = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    a = [[c(i, j) for j in range(3)] for i in range(3)]
    det = F.nullif(det3(a), F.lit(0.0))
    solved = [F.try_divide(det3([[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]), det) for k in range(3)]
    rows = s.select("dataset", "light_id", *(v.alias(k) for v, k in zip(solved, ("px", "py", "pz"), strict=True)))
    rows = rows.withColumn("radius", F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")))
    w = Window.partitionBy("dataset")
    rows = rows.withColumn("k", F.row_number().over(w.orderBy("radius")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("mid", F.max(F.when(F.col("k") == F.floor(F.col("n") / 2), F.col("radius"))).over(w))
    gain = F.when(F.abs(F.col("radius") - F.col("mid")) > 0.1 * F.col("mid"), F.try_divide(F.col("mid"), F.col("radius"))).otherwise(1.0) * F.when(F.col("pz") < 0, -1.0).otherwise(1.0) * pixel
    return rows.select("dataset", "light_id", *((F.col(k) * gain).alias(k) for k in ("px", "py", "pz")))
